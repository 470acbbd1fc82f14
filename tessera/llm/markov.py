"""Character Markov models: counted and smoothed on the driver from small labelled samples, scored by Spark.

A pair of models becomes one dense table of integer log-likelihood differences (thousandths of a nat), so a
score is a sum of array look-ups inside one JVM projection, the same in every engine, and what goes to the
executors has the fixed size (symbols + 1) ** (order + 1).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


SCALE = 1000


class CharModel:
    """A variable-order model with Witten-Bell smoothing: a context that the sample holds ``n`` times with
    ``t`` different successors lends ``t / (n + t)`` to the context that is one symbol shorter, down to the
    uniform distribution. An unseen context lends everything."""

    def __init__(self, sample: Iterable[list[int]], size: int, order: int):
        self.size, self.order = size, order
        self.seen: dict[tuple[int, ...], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for symbols in sample:
            padded = [0] * order + symbols
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.seen[tuple(padded[i - k : i])][padded[i]] += 1

    def row(self, context: tuple[int, ...]) -> list[float]:
        """The probability of every symbol after ``context``."""
        below = self.row(context[1:]) if context else [1 / self.size] * self.size
        found = self.seen.get(context)
        if not found:
            return below
        n, t = sum(found.values()), len(found)
        return [(found.get(s, 0) + t * below[s]) / (n + t) for s in range(self.size)]


@dataclass(frozen=True)
class Ratio:
    """Scores how much more likely ``yes`` strings are than ``no`` strings.

    alphabet: the symbols; any other character is symbol 0, which also stands before the start. order: the
    length of the context. table: by context and symbol. threshold: a string is taken if
    ``score >= threshold * length``, both in thousandths of a nat.
    """

    alphabet: str
    order: int
    table: tuple[int, ...]
    threshold: int = 0

    def symbols(self, text: str) -> list[int]:
        return [self.alphabet.find(c) + 1 for c in text]

    def score(self, text: str) -> int:
        size, total, context = len(self.alphabet) + 1, 0, 0
        for s in self.symbols(text):
            total += self.table[context * size + s]
            context = (context * size + s) % size**self.order
        return total

    def column(self, text: Column) -> Column:
        """``score`` as a Spark expression (bigint)."""
        size = len(self.alphabet) + 1
        ids = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(self.alphabet), c))
        # one literal: folded once, not thousands of expressions
        table = F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<int>")
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("context"))

        def step(state: Column, s: Column) -> Column:
            at = state["context"] * size + s
            return F.struct((state["total"] + F.get(table, at)).alias("total"), (at % size**self.order).cast("int").alias("context"))

        return F.aggregate(ids, start, step, lambda state: state["total"])

    def sql(self, text: str) -> str:
        """``score`` for DuckDB, of the SQL expression ``text``; only for the orders 1 and 2."""
        size = len(self.alphabet) + 1
        ids = f"list_transform(string_split({text}, ''), lambda c: strpos('{self.alphabet}', c))"
        before = " + ".join(f"(case when i > {k} then ids[i - {k}] else 0 end) * {size**k}" for k in range(1, self.order + 1))
        table = f"cast(string_split('{','.join(map(str, self.table))}', ',') as integer[])"
        return f"""(select cast(coalesce(sum(tb[ids[i] + {before} + 1]), 0) as bigint)
            from (select ids, tb, unnest(range(1, len(ids) + 1)) as i
                  from (select case when {text} = '' then cast([] as bigint[]) else {ids} end as ids, {table} as tb)))"""


def fit(yes: list[str], no: list[str], alphabet: str, order: int, cost: int = 1) -> Ratio:
    """Fits both models on all samples and sets the threshold on a held-out split.

    Odd samples calibrate a ratio fitted on even ones: the threshold is the middle of the best stretch of
    length-normalised scores, where a ``no`` string taken costs ``cost`` times a ``yes`` string missed.
    """

    def ratio(a: list[str], b: list[str]) -> Ratio:
        size = len(alphabet) + 1
        plain = Ratio(alphabet, order, ())
        m, n = (CharModel([plain.symbols(x) for x in s], size, order) for s in (a, b))
        table = []
        for at in range(size**order):
            context = tuple(at // size**k % size for k in reversed(range(order)))
            table += [round(SCALE * math.log(p / q)) for p, q in zip(m.row(context), n.row(context), strict=True)]
        return Ratio(alphabet, order, tuple(table))

    half = ratio(yes[::2], no[::2])
    a = sorted(half.score(x) / len(x) for x in yes[1::2])
    b = sorted(half.score(x) / len(x) for x in no[1::2])
    cuts = sorted({*a, *b})
    errors = [(sum(x < c for x in a) / len(a) + cost * sum(x >= c for x in b) / len(b), -c) for c in cuts]
    cut = -min(errors)[1]
    below = [c for c in cuts if c < cut]
    full = ratio(yes, no)
    return Ratio(full.alphabet, full.order, full.table, round((cut + (below[-1] if below else cut)) / 2))


