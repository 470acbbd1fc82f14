"""Secret scan: fixed patterns, and a likelihood ratio of character Markov models for other random strings.

All of it is one projection of built-in functions: no Python on the executors, no shuffle, no broadcast.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .markov import Ratio, fit

#: kind -> (pattern, group whose length counts, least length), in the order of the kinds.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    # the maximal runs of [0-9a-f]+ that have 32 or more
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
METHOD = "markov"
KINDS = (*BASE, METHOD)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: The characters of the strings that the models judge: whole runs, and the pieces of a run between = and /.
RUN, PIECE = "[A-Za-z0-9+/_=-]", "[A-Za-z0-9+_-]"
#: A string must be e ** 8 times likelier as a random one (in thousandths of a nat): there are that many more names.
MIN_SCORE = 8_000

_WORDS = (
    "account action address admin alert archive array async author backup balance batch begin block board body branch "
    "browser buffer build button cache call card category change channel chart check child class client cluster code "
    "column command comment commit company config connection content context control copy count country create current "
    "customer data date debug default delete description detail device dialog direction document domain download driver "
    "editor element email enable engine entry error event example export factory feature field file filter first folder "
    "format frame function gateway global graph group handler header height history image import index input instance "
    "interface internal invoice item job label language last layout length level library license limit line link list "
    "local location logger login manager map market master member memory menu message method model module monitor name "
    "network number object offset open option order output package page panel parent parser partition path payment people "
    "person picture player point policy port position price process product profile project property provider public "
    "query queue quote random range record region release remote report request resource response result return review"
).split()


def labelled_samples(n: int = 2400, seed: int = 7) -> tuple[list[str], list[str]]:
    """``n`` random strings of the usual encodings, and ``n`` ordinary identifiers, both of 6 to some 64 characters:
    words in the usual spellings, abbreviated ones, paths, plain and long words, versions, dates, numbers and rules of
    punctuation."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    codes = ("0123456789abcdef", lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-", upper + "234567", lower + digits)
    yes = ["".join(rng.choices(codes[i % len(codes)], k=rng.randint(6, 64))) for i in range(n)]
    vowels, consonants, no = "aeiou", "bcdfghklmnprstvwz", []
    syllables = lambda k: "".join(rng.choice(consonants) + rng.choice(vowels) + rng.choice(("", rng.choice(consonants))) for _ in range(k))
    brief = lambda w: rng.choice((w[:3], w[:4], "".join(c for c in w if c not in vowels)[:5]))
    initials = lambda: "".join(w[0] for w in rng.choices(_WORDS, k=rng.randint(2, 4)))
    for i in range(n):
        words = rng.choices(_WORDS, k=rng.randint(1, 8))
        no.append(
            (
                lambda: "_".join(words),
                lambda: words[0] + "".join(w.title() for w in words[1:]),
                lambda: "-".join(words),
                lambda: "/".join(words),
                lambda: "_".join(words).upper(),
                lambda: "".join(words[:3]),
                lambda: "/".join(words[:3]) + "/" + "-".join(words[3:]) + f"-{rng.randint(1, 9999)}",
                lambda: syllables(rng.randint(3, 12)),
                lambda: "".join(rng.choices(digits, k=rng.randint(6, 40))),
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{words[0]}_{rng.randint(100, 99999)}",
                lambda: rng.choice("-=_/+") * rng.randint(6, 60),
                lambda: "_".join(words[:3]) + f"_v{rng.randint(1, 30)}_{rng.randint(0, 99)}",
                lambda: words[0].title() + str(rng.randint(1, 9999)) + rng.choice(("", rng.choice(words).title(), rng.choice(words))),
                lambda: f"{words[0]}-{rng.randint(0, 30)}-{rng.randint(0, 9)}-{rng.choice(('rc', 'beta', 'x86_64', 'amd64', 'linux', 'v'))}{rng.randint(1, 20)}",
                lambda: syllables(rng.randint(2, 7)).title() + rng.choice(("", "-" + syllables(3).title(), "s")),
                lambda: f"{rng.choice(words)}={rng.choice(words)}",
                lambda: "_".join(rng.choice((w, brief(w), initials())) for w in words).upper() + rng.choice(("", "", str(rng.randint(1, 99)))),
                lambda: "_".join(rng.choice((w, brief(w), initials())) for w in words).upper(),
                lambda: "".join(rng.choice((w.title(), w.title(), brief(w).title(), initials().upper())) for w in words[:5]),
                lambda: rng.choice(("_", "")) + "_".join(rng.choice((w, brief(w), initials())) for w in words) + rng.choice(("", "", str(rng.randint(1, 99)))),
            )[i % 20]()
        )
    return yes, [x for x in no if len(x) >= 6]


@cache
def model() -> Ratio:
    """The default ratio of order 1, trained once a process from the labelled samples."""
    return fit(*labelled_samples(), ALPHABET, 1)


@cache
def least_length(ratio: Ratio) -> int:
    """The length from which strings are judged, calibrated on samples of their own: the least at which ``ratio`` takes
    nine of ten random strings of every encoding. Shorter ones can't be told from names, whatever is cut off."""
    rng = random.Random(23)
    codes = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:52] + "234567", ALPHABET[:26] + ALPHABET[52:62])
    for n in range(6, 64):
        if all(sum(taken(ratio, "".join(rng.choices(code, k=n))) for _ in range(300)) >= 270 for code in codes):
            return n
    return 64


def taken(ratio: Ratio, text: str) -> bool:
    """Whether the models call a string random."""
    score = ratio.score(text)
    return score >= ratio.threshold * len(text) and score >= MIN_SCORE


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of every element and all before it, in as many rounds as the size has bits: a round joins each
    element with the one 1, 2, 4, ... places before. Appending to an array element by element would copy it each time."""
    shifts = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), 1, F.length(F.bin(F.size(values) - 1)))
    return F.aggregate(shifts, values, lambda a, far: F.transform(a, lambda x, i: F.when(i >= far, join(x, F.get(a, i - far))).otherwise(x)))


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e, hit>>: code points of the pattern's matches whose group is long enough, and the matches.

    Splitting at the pattern gives the gaps between its matches, so running sums of gaps and matches are the
    positions. Texts without a match, nearly all, cost one search.
    """
    none = F.array().cast("array<struct<s:int,e:int,hit:string>>")

    def spans(hits: Column) -> Column:
        sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        gaps = F.slice(F.split(text, pattern), 1, F.size(hits))
        lengths = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: F.length(x["gap"]) + F.length(x["hit"]))
        ends = let(lengths, lambda n: _running(n, lambda a, b: a + b))
        rows = F.filter(F.arrays_zip(ends.alias("e"), hits.alias("hit"), sizes.alias("size")), lambda x: F.length(x["size"]) >= least)
        return F.transform(rows, lambda x: F.struct((x["e"] - F.length(x["hit"])).alias("s"), x["e"].alias("e"), x["hit"].alias("hit")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that touch none of ``others`` (both array<struct<s, e>>), by one sort of all: of the others that
    start no later none ends after a span's start, and of the rest none starts before its end."""
    mark = lambda x, other: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(other).alias("other"))

    def kept(all_: Column) -> Column:
        reach = let(F.transform(all_, lambda x: F.when(x["other"], x["e"]).otherwise(0)), lambda a: _running(a, F.greatest))
        starts = F.transform(F.reverse(all_), lambda x: F.when(x["other"], x["s"]).otherwise(2**31 - 1))
        next_ = F.reverse(let(starts, lambda a: _running(a, F.least)))
        rows = F.arrays_zip(all_.alias("x"), reach.alias("reach"), next_.alias("next"))
        clear = F.filter(rows, lambda r: ~r["x"]["other"] & (r["reach"] <= r["x"]["s"]) & (r["next"] >= r["x"]["e"]))
        return F.transform(clear, lambda r: F.struct(r["x"]["s"].alias("s"), r["x"]["e"].alias("e")))

    every = F.array_sort(F.concat(F.transform(spans, lambda x: mark(x, False)), F.transform(others, lambda x: mark(x, True))))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(every, kept)).otherwise(spans)


def _likely(text: Column, letters: str, ratio: Ratio) -> Column:
    """array<struct<s, e>> of the maximal stretches of ``letters`` that the models call random."""
    least = least_length(ratio)
    # looking behind saves a new try at every place inside a word
    pattern = f"(?<!{letters}){letters}{{{least},}}+"
    ok = lambda run: let(ratio.column(run), lambda x: (x >= ratio.threshold * F.length(run)) & (x >= MIN_SCORE))
    return _bare(F.filter(_found(text, pattern, 0, least), lambda x: ok(x["hit"])))


def scan(docs: DataFrame, text: str = "text", into: str = "secrets", ratio: Ratio | None = None) -> DataFrame:
    """``docs`` with ``into`` (replaced if there): array<struct<kind, start, end>> of the secrets in the
    whole text, code points, end exclusive, by start and then by kind in the order of KINDS.

    Matches of BASE are leftmost and don't overlap within a kind. The models add the runs of RUN that they call random
    and that touch no base span, and of other runs the pieces between = and / for which both hold. A null or empty text
    has no secrets; very long ones are read whole, in time about proportional to their length; repeated rows are
    scanned each; an empty table gives an empty result; other columns, whatever their names, pass through.
    """
    ratio = ratio or model()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # where nothing stands between pieces, they are the runs
    pieces = F.when(body.contains("=") | body.contains("/"), _likely(body, PIECE, ratio)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    base = docs.withColumns({f"_tessera_{k}": _bare(_found(body, *v)) for k, v in BASE.items()} | {"_tessera_runs": _likely(body, RUN, ratio), "_tessera_pieces": pieces})
    known = F.concat(*[F.col(f"_tessera_{k}") for k in BASE])
    runs = base.withColumn("_tessera_runs", _apart(F.col("_tessera_runs"), known))
    found = runs.withColumn(f"_tessera_{METHOD}", F.concat("_tessera_runs", _apart(F.col("_tessera_pieces"), F.concat(known, "_tessera_runs"))))

    def ranked(kind: str, rank: int) -> Column:
        return F.transform(F.col(f"_tessera_{kind}"), lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end")))

    every = F.array_sort(F.concat(*[ranked(k, i) for i, k in enumerate(KINDS)]))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(every, lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"], x["end"]))
    return found.withColumn(into, named).drop(*[f"_tessera_{k}" for k in (*KINDS, "runs", "pieces")])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def sql(table: str = "documents", ratio: Ratio | None = None) -> str:
    """The digests of the scan for DuckDB."""
    ratio = ratio or model()

    def found(pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""(select coalesce(list(struct_pack(s := s, e := e) order by s), []) from (
            select cast(list_sum(g[1:i]) + coalesce(list_sum(h[1:i - 1]), 0) as integer) as s,
                   cast(list_sum(g[1:i]) + list_sum(h[1:i]) as integer) as e, z[i] as n
            from (select g, h, z, unnest(range(1, len(h) + 1)) as i from (
              select list_transform(string_split_regex(body, '{p}'), lambda x: length(x)) as g,
                     list_transform(regexp_extract_all(body, '{p}', 0), lambda x: length(x)) as h,
                     list_transform(regexp_extract_all(body, '{p}', {group}), lambda x: length(x)) as z))) where n >= {least})"""

    least, score = least_length(ratio), ratio.sql("run")
    touches = lambda others: f"len(list_filter({others}, lambda y: s < y.e and y.s < e)) = 0"
    likely = lambda kind: f"""(select rn, s, e, assign, access, hex from (select *, {score} as score from (
        select rn, x.s as s, x.e as e, substr(body, x.s + 1, x.e - x.s) as run, assign, access, hex
        from (select rn, body, assign, access, hex, unnest({kind}) as x from base))) where score >= {ratio.threshold} * length(run) and score >= {MIN_SCORE})"""  # noqa: E731
    return f"""
    with rows as (select *, row_number() over () as rn, coalesce(text, '') as body from {table}),
    base as (select *, {", ".join(f"{found(*v)} as {k}" for k, v in BASE.items())},
             {found(f"{RUN}{{{least},}}", 0, least)} as runs, {found(f"{PIECE}{{{least},}}", 0, least)} as pieces from rows),
    whole as (select rn, s, e from {likely("runs")} where {touches("list_concat(assign, access, hex)")}),
    part as (select rn, s, e, assign, access, hex, w from {likely("pieces")} left join (select rn, list(struct_pack(s := s, e := e)) as w from whole group by rn) using (rn)),
    added as (
      select * from whole union all
      select rn, s, e from part where {touches("list_concat(assign, access, hex, coalesce(w, []))")}),
    spans as (
      {" union all ".join(f"select rn, x.s as s, {i} as k, '{k}' as kind, x.e as e from (select rn, unnest({k}) as x from base)" for i, k in enumerate(BASE))}
      union all select rn, s, {len(BASE)}, '{METHOD}', e from added),
    texts as (
      select rn, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {len(BASE)}) as base_spans,
             string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as all_spans from spans group by rn)
    select doc_id, cast(len(assign) as bigint) as n_assign, cast(len(access) as bigint) as n_access, cast(len(hex) as bigint) as n_hex,
           sha256(coalesce(base_spans, '')) as base_sha256, coalesce(all_spans, '') as spans
    from base left join texts using (rn)"""
