"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text parses a text into the longest phrases which that text
holds. The fewer phrases a symbol a language needs, the closer it is. Symbols are bytes of UTF-8, so that no
letter of any script is folded into another. Automata are dense transition tables, and whole batches of
segments step through them together, one vectorised look-up a symbol and language; phrases cross the ends of
segments. Training reads a bounded sample of labelled pieces; predicting is a map over the documents without a
shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bounds of the training sample. Labelled texts are cut into pieces of PIECE characters, and of each language's
#: pieces those of the least hash serve, at most PIECES of them and ALL_PIECES of all languages together (but one each).
PIECE, PIECES, ALL_PIECES = 1_000, 24, 1_536
#: Pieces of fewer characters serve only where a language has no other.
SHORTEST = 100
#: More labels than this are an error, as every one needs an automaton.
LANGUAGES = 4_096
#: So many symbols of a text are stepped through at once; phrases go on into the next segment.
SEGMENT = 256
#: Segments that step together.
LANES = 1 << 14
SLICE = 2_000_000


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters.table


def cleaned(text: str) -> bytes:
    """A text's letters in lower case as UTF-8; every run of others is one space."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[found]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, found, 32)[keep].astype("<u4").tobytes().decode("utf-32-le").encode()


def automaton(sample: list[int], size: int) -> np.ndarray:
    """The suffix automaton of a sample as a table for ``phrases``.

    Entry ``state * (size + 1) + symbol`` is twice the next state's row, plus 1 if a phrase ended: there the
    symbol starts the next phrase. Symbol ``size`` is padding, which changes nothing.
    """
    link, length, follow = [-1], [0], [{}]
    last = 0
    for c in sample:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = clone
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
        last = now
    width, alone = size + 1, len(follow)
    # a symbol that the sample lacks is a phrase of its own: the state behind all others
    start = np.full(width, alone, dtype=np.int64)
    for c, to in follow[0].items():
        start[c] = to
    # no way on: the phrase ends, and the symbol starts the next one; at the start of a text none ends
    table = np.tile(start * width * 2 + 1, (len(follow) + 1, 1))
    table[0] -= 1
    for state, ways in enumerate(follow):
        table[state, list(ways.keys())] = np.fromiter(ways.values(), dtype=np.int64, count=len(ways)) * width * 2
    table[:, size] = np.arange(len(follow) + 1) * width * 2
    return table.astype(np.int32).ravel()


def by_step(rows: np.ndarray) -> np.ndarray:
    """Rows of symbols as columns, for ``phrases``."""
    return np.ascontiguousarray(rows.T).astype(np.int32)


def phrases(steps: np.ndarray, first: np.ndarray, table: np.ndarray, before: int = 0) -> tuple[np.ndarray, int]:
    """How many phrases end in every row of symbols (``steps`` is by_step of the rows), and the state after the last row.

    The rows are consecutive segments of texts, ``first`` marks those that start one, and ``before`` is the state in
    which a first row that starts none begins. All rows step together from the root; then those whose text was in another
    state go again from there, until they meet the states of before, which most do after a phrase or two, and so on
    until no row's last state changes.
    """
    n = steps.shape[1]
    path = np.empty(steps.shape, dtype=np.int32)
    state, ended = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for at, column in enumerate(steps):
        state += column
        state = table.take(state)
        path[at] = state
        ended += state & 1
        state >>= 1
    last = state.copy()
    todo = np.flatnonzero(~first)
    while len(todo):
        live, state = todo, np.where(todo > 0, last[todo - 1], before)
        for at in range(len(steps)):
            if not len(live):
                break
            new = table.take(state + steps[at, live])
            old = path[at, live]
            ended[live] += (new & 1) - (old & 1)
            path[at, live] = new
            apart = new >> 1 != old >> 1
            live, state = live[apart], (new >> 1)[apart]
        last[live] = state
        todo = live[live + 1 < n] + 1
        todo = todo[~first[todo]]
    return ended, int(last[-1])


class Model:
    """Languages in order, and what parses with them; built once a process from the sample it is sent."""

    built: dict[str, Model] = {}

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        texts = [b" ".join(map(cleaned, sample[lang])) for lang in self.languages]
        known = sorted(set(b"".join(texts)))
        #: Bytes that no sample has share a symbol that no automaton has either.
        self.map = np.full(256, len(known), dtype=np.uint8)
        self.map[known] = np.arange(len(known))
        self.size = len(known) + 1
        self.tables = [automaton(self.symbols(t).tolist(), self.size) for t in texts]

    def symbols(self, text: bytes) -> np.ndarray:
        return self.map[np.frombuffer(text, dtype=np.uint8)]

    @classmethod
    def of(cls, sample: dict[str, list[str]]) -> Model:
        key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
        if key not in cls.built:
            cls.built.clear()
            cls.built[key] = cls(sample)
        return cls.built[key]

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Phrases a symbol, by text and language."""
        counts = np.array([-(-len(t) // SEGMENT) for t in texts])
        total = np.ones((len(texts), len(self.languages)))  # the phrase that a text ends in
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.zeros(len(owner), dtype=bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        states = [0] * len(self.languages)
        padded = b"".join(t + bytes(-len(t) % SEGMENT) for t in texts)
        for at in range(0, len(owner), LANES):
            part = owner[at : at + LANES]
            rows = self.symbols(padded[at * SEGMENT : (at + len(part)) * SEGMENT]).reshape(-1, SEGMENT)
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True))
            for row in ends:  # behind a text's end; where a text goes on in the next lanes, its row is full
                left = counts[part[row]] * SEGMENT - len(texts[part[row]])
                if left and (at + row + 1 == len(owner) or owner[at + row + 1] != part[row]):
                    rows[row, SEGMENT - left :] = self.size
            steps = by_step(rows)
            for k, table in enumerate(self.tables):
                ended, states[k] = phrases(steps, first[at : at + LANES], table, states[k])
                total[:, k] += np.bincount(part, weights=ended, minlength=len(texts))
        return total / np.maximum(1, [[len(t)] for t in texts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        at = 0
        while at < len(known):
            to, held, found = at, 0, []
            while to < len(known) and (to == at or held < SLICE):
                found.append(cleaned(texts[known[to]]))
                held += len(found[-1])
                to += 1
            for i, row in zip(known[at:to], self.costs(found), strict=True):
                best = int(row.argmin())
                others = np.delete(row, best)
                second = float(others.min()) if len(others) else 1.0
                out[i] = (self.languages[best], second / (second + float(row[best])) if second else 0.5)
            at = to
        return out


def sample(docs: DataFrame, keep: Column, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The training sample: of every language pieces of the rows for which ``keep`` holds and text and language are
    there, different ones of the least hash, at most PIECES a language and ALL_PIECES in all, but one at least; pieces of
    fewer than SHORTEST characters only after all others. Whole texts are cut, so every part of a text may serve.

    One pass counts the different pieces of each language (about); the next keeps those under a hash that leaves a few
    more than are needed, so that copies of a piece meet before they are shuffled and a hot text is one row.
    """
    t, l = F.col(f"`{text}`"), F.col(f"`{lang}`")  # noqa: E741
    cut = F.when(F.length(t) <= PIECE, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    rows = docs.where(keep & t.isNotNull() & l.isNotNull()).select(l.alias("lang"), F.explode(cut).alias("text"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("hash"), (F.length("text") < SHORTEST).alias("odd"))
    there = F.approx_count_distinct(F.when(~F.col("odd"), F.col("hash"))).alias("n")
    counted = rows.groupBy("lang").agg(there).limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")
    if not counted:
        return {}
    each = max(1, min(PIECES, ALL_PIECES // len(counted)))
    # 4 * each different pieces are expected under the bound; where there are too few, all serve
    bounds = [(r["lang"], 2.0 if r["n"] < 8 * each else 4.0 * each / r["n"]) for r in counted]
    near = rows.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound double")), "lang")
    near = near.where((F.col("bound") > 1) | ~F.col("odd") & ((F.col("hash") / 2.0**64 + 0.5) < F.col("bound"))).dropDuplicates(["lang", "hash"])
    order = Window.partitionBy("lang").orderBy("odd", "hash", "text")
    out: dict[str, list[str]] = {}
    for r in near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).orderBy("lang", "n").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: v for k, v in out.items() if any(c.isalpha() for x in v for c in x)}


def predictor(trained: dict[str, list[str]]):
    """A function from a text column to struct<lang_pred, score>.

    score is the runner-up's cost over the sum of both, 0.5 for a tie and near 1 for a clear case; a text that
    is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(Model.of(trained).predict(list(text)), columns=["lang_pred", "score"])

    return lambda text: predict(text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` (replaced if there): held_out, lang_pred, score of the whole text.

    Rows that aren't held out and have text and lang are learned from; only the text decides a prediction. Of
    languages that need equally many phrases, the first by name wins. Very long texts are parsed whole. Repeated rows
    get the same result; an empty table gives an empty result; other columns, whatever their names, pass through.
    """
    out = held_out(F.col(f"`{doc_id}`"))
    predict = predictor(sample(docs, ~out, text, lang))
    found = docs.withColumn(into, predict(F.col(f"`{text}`")))
    return found.withColumn(into, F.struct(out.alias("held_out"), F.col(f"`{into}`")["lang_pred"].alias("lang_pred"), F.col(f"`{into}`")["score"].alias("score")))
