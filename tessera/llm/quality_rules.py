"""Quality rules: a table of thresholds compiled into one Spark projection.

Every rule bounds a ratio of two counts of a text. The counts come from built-in functions, so the whole
table is one projection of JVM expressions without user functions, a shuffle or a broadcast; a filter on it
is decided row by row and scales with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * over / under <= high``; integers, so that every engine decides alike. None: no bound."""

    name: str
    over: str
    under: str
    low: int | None = None
    high: int | None = None


#: Counts: n_words, word_chars, n_symbols, n_stop_words, n_lines (with a word), n_dup_lines, n_bullet_lines,
#: n_cut_lines (ending in an ellipsis), n_repeat_words.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
)

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "le la les de des du un une et est que qui dans en pour pas sur par au avec ce il elle "
    "der die das und ist von den zu mit sich auf für im dem nicht ein eine als auch es werden "
    "el los las y que del se por con para una su al lo como más"
).split()

MIN_WORDS = 50
REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_cut_lines")


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    A window is the XXH64 of its three words' XXH64. Texts whose windows all differ are settled by a hash set;
    the others sort (window, position) once, so the work is n log n in any text.
    """
    empty = F.array().cast("array<bigint>")
    windows = F.when(
        F.size(hashes) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(hashes) - 2), lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1))),
    ).otherwise(empty)

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(
            ordered,
            lambda o: F.transform(
                F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"])),
                lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
            ),
        )
        return F.size(F.array_distinct(F.flatten(found)))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def counts(text: Column) -> Column:
    """A struct of COUNTS (bigint) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        number = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
            "n_repeat_words": let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        }
        by_line = {
            "n_lines": lambda x: F.size(x),
            "n_dup_lines": lambda x: F.size(x) - F.size(F.array_distinct(x)),
            "n_bullet_lines": lambda x: F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•·]"))),
            "n_cut_lines": lambda x: F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        }
        return let(lines, lambda x: F.struct(*[(number[c] if c in number else by_line[c](x)).cast("bigint").alias(c) for c in COUNTS]))

    return let(words, of)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])


def _broken(q: Column, rule: Rule) -> Column:
    value, unit = q[rule.over] * 1000, q[rule.under]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low * unit)
    if rule.high is not None:
        out = out | (value > rule.high * unit)
    return out


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there): the counts, base_failed, failed (names of
    the broken rules in the table's order, comma-joined) and kept (neither).

    A null or empty text has no words and isn't kept. Repeated rows are judged each; other columns, of any
    name, pass through; an empty table gives an empty result.
    """
    counted = docs.withColumn(into, counts(F.col(f"`{text}`")))
    q = F.col(f"`{into}`")
    failed = F.concat_ws(",", *[F.when(_broken(q, r), F.lit(r.name)) for r in rules])
    judged = counted.withColumn(into, F.struct(*[q[c].alias(c) for c in COUNTS], base_failed(q).alias("base_failed"), failed.alias("failed")))
    return judged.withColumn(into, F.struct(f"`{into}`.*", (~q["base_failed"] & (q["failed"] == "")).alias("kept")))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass; the columns stay as they are."""
    mark = "_tessera_quality"
    return judge(docs, text, mark, rules).where(F.col(mark)["kept"]).drop(mark)


def sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same projection for DuckDB: every column of ``table``, the counts, base_failed, failed and kept."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def broken(r: Rule) -> str:
        low = f"1000 * {r.over} < {r.low} * {r.under}" if r.low is not None else "false"
        high = f"1000 * {r.over} > {r.high} * {r.under}" if r.high is not None else "false"
        return f"case when {low} or {high} then '{r.name}' end"

    return f"""
    with rows as (select *, row_number() over () as rn, coalesce(text, '') as body from {table}),
    split as (
      select *, list_filter(string_split_regex(body, '{SPACE}+'), lambda x: x <> '') as w,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ln
      from rows),
    windows as (
      select rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
      from (select rn, w, unnest(range(1, len(w) - 1)) as i from split)),
    twice as (select rn, win from windows group by rn, win having count(*) > 1),
    covered as (
      select rn, count(distinct p) as n from (
        select rn, unnest([i, i + 1, i + 2]) as p from windows join twice using (rn, win)) group by rn),
    counted as (
      select split.*, cast(len(w) as bigint) as n_words,
             cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
             cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines,
             cast(coalesce(n, 0) as bigint) as n_repeat_words,
             cast(len(ln) as bigint) as n_lines,
             cast(len(list_filter(w, lambda x: lower(x) in ({stop}))) as bigint) as n_stop_words,
             cast(len(list_filter(ln, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•·]'))) as bigint) as n_bullet_lines,
             cast(len(list_filter(ln, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) as bigint) as n_cut_lines
      from split left join covered using (rn)),
    ruled as (
      select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
             concat_ws(',', {", ".join(broken(r) for r in rules)}) as failed
      from counted)
    select * exclude (rn, body, w, ln), not base_failed and failed = '' as kept from ruled"""
