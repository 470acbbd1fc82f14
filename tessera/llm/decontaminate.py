"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e is split into e + 1 pieces: wherever it occurs with at most e edits, one
piece occurs exactly. Piece hits are found by one vectorised look-up of 12-byte windows over whole batches of
text, and each is verified by Myers' bit-parallel edit distance around the place it implies. Items too short for
a window are looked up as they are, between the ends of words. Documents are
scanned where they lie, without a shuffle; items go along in blocks of bounded size, so a large benchmark
costs more passes and never more memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_names

#: Every piece has at least so many bytes, and the index holds so many of each; from 8 to 16.
PIECE = 12
#: One edit is allowed for each so many bytes of an item.
BYTES_AN_EDIT = 12
#: Items sent to tasks at once, in bytes of their texts.
BLOCK_BYTES = 8_000_000
SLICE = 4_000_000
#: ``text`` names an item without an id.
HITS = "array<struct<item_id: bigint, distance: int, start: int, end: int, text: string>>"

_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_OTHER = re.compile(r"[^\w\x00-\x7f]|[\x80-\x9f]")
_BITS = 22
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str) -> bytes:
    """Lower case, and every run of what is no letter, mark or digit as one space; UTF-8."""
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())


def budget(item: bytes) -> int:
    """The edits allowed: one a BYTES_AN_EDIT bytes, as long as every piece keeps PIECE bytes."""
    return max(0, min(len(item) // BYTES_AN_EDIT, len(item) // PIECE - 1))


def pieces(item: bytes) -> list[int]:
    """Where the budget + 1 pieces of an item start."""
    n = budget(item) + 1
    return [i * len(item) // n for i in range(n)]


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a stretch of ``text``, and where that stretch ends first.

    Myers' bit-parallel recurrence, with the column of differences in two integers of len(pattern) bits.
    """
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = items
        names = [i if i is not None else xxhash.xxh3_128_hexdigest(item) for i, item in items]
        numbers = {name: n for n, name in enumerate(dict.fromkeys(names))}
        #: Which items count as one: those that share an id, and those without one whose texts are equal.
        self.one = [numbers[name] for name in names]
        self.named = [(i, None) if i is not None else (None, name) for (i, _), name in zip(items, names, strict=True)]
        self.pieces: dict[tuple[int, int], bytes] = {}
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, item) in enumerate(items):
            starts = pieces(item) if len(item) >= PIECE else []
            for at, to in zip(starts, [*starts[1:], len(item)], strict=False):
                self.pieces[i, at] = item[at:to]
                found[self._hash(item[at : at + PIECE])[0].item()].append((i, at))
        brief: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (_, item) in enumerate(items):
            if 0 < len(item) < PIECE:
                brief[len(item)][item].append(i)
        #: By length, the items of fewer than PIECE bytes in order, and which items each is.
        self.brief = {n: (np.array(sorted(of), dtype=f"S{n}"), [of[x] for x in sorted(of)]) for n, of in brief.items()}
        self.hashes = np.array(sorted(found), dtype=np.uint64)
        self.at = [found[int(h)] for h in self.hashes]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - _BITS)] = True

    @staticmethod
    def _hash(flat: bytes) -> np.ndarray:
        """A hash of the PIECE bytes at every position: of their first and last eight."""
        word = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat, strides=(1,))
        mixed = word[: len(flat) - PIECE + 1] * _K1
        mixed ^= word[PIECE - 8 :] * _K2
        mixed ^= mixed >> np.uint64(32)
        mixed *= _K1
        return mixed

    def hits(self, flat: bytes) -> Iterator[tuple[int, int, int]]:
        """(position, item, offset of the piece in the item) of every window of ``flat`` equal to a piece."""
        if not len(self.hashes):
            return
        for base in range(0, len(flat) - PIECE + 1, SLICE):  # one document may be longer than a slice
            mixed = self._hash(flat[base : base + SLICE + PIECE - 1])
            places = np.flatnonzero(self.filter[mixed >> np.uint64(64 - _BITS)])
            which = np.searchsorted(self.hashes, mixed[places])
            which[which == len(self.hashes)] = 0
            exact = self.hashes[which] == mixed[places]
            for p, k in zip((places[exact] + base).tolist(), which[exact].tolist(), strict=True):
                for i, at in self.at[k]:
                    piece = self.pieces[i, at]
                    if flat[p : p + len(piece)] == piece:
                        yield p, i, at

    def brief_hits(self, flat: bytes, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, position) of the first place of every item of fewer than PIECE bytes that is whole words
        of a document; ``edges`` are where the documents start in ``flat``."""
        if not self.brief:
            return
        ends = np.isin(np.frombuffer(b"\n" + flat + b"\n", dtype=np.uint8), (10, 32))
        starts = np.flatnonzero(ends[:-1])
        for n, (texts, which) in self.brief.items():
            at = starts[starts + n <= len(flat)]
            at = at[ends[at + n + 1]]
            if not len(at):
                continue
            found = np.ndarray(len(flat) - n + 1, dtype=f"S{n}", buffer=flat, strides=(1,))[at]
            k = np.searchsorted(texts, found)
            k[k == len(texts)] = 0
            exact = texts[k] == found
            at, k = at[exact], k[exact]
            docs = np.searchsorted(edges, at, "right") - 1
            _, first = np.unique(docs * len(texts) + k, return_index=True)
            for doc, place, x in zip(docs[first].tolist(), at[first].tolist(), k[first].tolist(), strict=True):
                for i in which[x]:
                    yield doc, i, place

    def verify(self, flat: bytes, lo: int, hi: int, p: int, i: int, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of item ``i`` around a piece hit in the document flat[lo:hi]."""
        item = self.items[i][1]
        e, begin = budget(item), p - at
        if begin >= lo and flat[begin : begin + len(item)] == item:
            return 0, begin - lo, begin - lo + len(item)
        # a stretch of the item beside the piece, first: nearly all chance hits end here
        near = min(64, len(item))
        cut = min(max(0, at + PIECE // 2 - near // 2), len(item) - near)
        if myers(item[cut : cut + near], flat[max(lo, begin + cut - e) : min(hi, begin + cut + near + e)])[0] > e:
            return None
        start, stop = max(lo, begin - e), min(hi, begin + len(item) + e)
        d, end = myers(item, flat[start:stop])
        if d > e:
            return None
        # the longest start that reaches this distance: the reversed problem, anchored at the end
        back, length = myers(item[::-1], flat[start : start + end][::-1])
        return d, start + end - (length if back == d else len(item)) - lo, start + end - lo


def _by_id(row: tuple) -> tuple:
    """Orders rows by their id, null last."""
    return row[0] is None, row[0] or 0, row[1:]


def search(index: Index, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int, str | None]]]:
    """For each text the (item_id, distance, start, end, text) of the items in it, each id once at its best place;
    positions are bytes of the normalised text. ``text`` is None but for items without an id, which it names."""
    out: list[list[tuple[int | None, int, int, int, str | None]]] = [[] for _ in texts]
    todo: list[tuple[int, bytes]] = []

    def flush() -> None:
        starts, at = [], 0
        for _, body in todo:
            starts.append(at)
            at += len(body) + 1
        flat = b"\n".join(body for _, body in todo)
        edges = np.array([*starts, at])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        name: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()

        def put(doc: int, i: int, got: tuple[int, int, int]) -> None:
            one = index.one[i]
            name[one] = i
            if (doc, one) not in best or got < best[doc, one]:
                best[doc, one] = got

        for p, i, off in index.hits(flat):
            doc = int(np.searchsorted(edges, p, "right")) - 1
            lo, had = int(edges[doc]), best.get((doc, index.one[i]))
            if had and had[0] == 0 and had[1] < p - off - lo or (doc, i, p - off) in tried:
                continue
            tried.add((doc, i, p - off))
            got = index.verify(flat, lo, int(edges[doc + 1]) - 1, p, i, off)
            if got:
                put(doc, i, got)
        for doc, i, p in index.brief_hits(flat, edges[:-1]):
            begin = p - int(edges[doc])
            put(doc, i, (0, begin, begin + len(index.items[i][1])))
        for (doc, one), got in best.items():
            ident, text = index.named[name[one]]
            out[todo[doc][0]].append((ident, *got, text))
        todo.clear()

    held = 0
    for n, text in enumerate(texts):
        if text:
            body = normalise(text)
            todo.append((n, body))
            held += len(body)
            if held > SLICE:
                flush()
                held = 0
    if todo:
        flush()
    return [sorted(x, key=_by_id) for x in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark dealt by hash to blocks of about BLOCK_BYTES; only its size is fetched here."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def _searcher(block: DataFrame):
    index = Index(sorted({(r["i"], normalise(r["t"])) for r in block.collect()}, key=_by_id))

    @F.pandas_udf(HITS)
    def found(text: pd.Series) -> pd.Series:
        names = ("item_id", "distance", "start", "end", "text")
        return pd.Series([[dict(zip(names, hit, strict=True)) for hit in hits] for hits in search(index, list(text))], dtype=object)

    return found


def leaks(docs: DataFrame, benchmark: DataFrame, keys: list[Column], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(keys, item_id, distance, start, end): the items of ``benchmark`` in the column ``text`` of every row.

    An item is in a text if, both normalised, some stretch of the text is within the item's error budget of
    it; one of fewer than PIECE normalised bytes, if it is whole words of the text. Null texts hold nothing, and
    items that are null or normalise to nothing are in no text; an empty table of either gives no rows. Items that share
    an id count as that id: one row a document, the place of the least distance, and of these the first. An item without
    an id has a null item_id in the hits; such items count as one if their normalised texts are equal. Repeated rows
    come back each; very long texts are searched whole. A key that has the name of a hit's column comes back as ``doc_``
    and its name.

    One block is searched within the plan. Of several, each is a pass of its own over the texts, whose hits are
    written before the next block is fetched, so neither the driver nor a task ever holds two; the rows are the same.
    """
    of_hit = ["item_id", "distance", "start", "end"]
    names = docs.select(*keys).columns
    mine = [f"_tessera_{k}" for k in range(len(names))]
    named = [F.col(c).alias(f"doc_{n}" if n in of_hit else n) for c, n in zip(mine, names, strict=True)]
    body = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("_tessera_body")

    def found(block: DataFrame, *more: Column) -> DataFrame:
        hits = docs.select(*[k.alias(c) for k, c in zip(keys, mine, strict=True)], *more, _searcher(block)(F.col(f"`{text}`")).alias("_tessera_hits"))
        return hits.select(*hits.columns[:-1], F.inline("_tessera_hits"))

    blocks = _blocks(benchmark, item_id, item_text)
    if len(blocks) == 1:
        return found(blocks[0]).select(*named, *of_hit)
    # rows of equal keys and text have equal hits, and come back as often as they are there
    scratch, by = Scratch(docs.sparkSession, "leaks"), [*mine, "_tessera_body", "item_id", "text"]
    best = F.min(F.struct("distance", "start", "end")).alias("best")
    passes = [scratch.keep(found(block, body).groupBy(*by).agg(best, F.count("*").alias("n"))) for block in blocks]
    met = reduce(DataFrame.unionByName, passes).groupBy(*by).agg(F.min("best").alias("best"), F.max("n").alias("n"))
    return met.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select(*named, "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item; columns stay as they are, and repeated rows stay repeated. One
    block is a filter; the hits of several passes meet the rows by id (null: one like any other) and text. Null and
    empty texts hold nothing and stay."""
    blocks = _blocks(benchmark, item_id, item_text)
    if len(blocks) == 1:
        return docs.where(F.size(_searcher(blocks[0])(F.col(f"`{text}`"))) == 0)
    names = ["_tessera_id", "_tessera_body"]
    keys = [key.alias(name) for key, name in zip(row_names(docs, text, doc_id), names, strict=True)]
    found = leaks(docs, benchmark, keys, text, item_id, item_text).select(*names).distinct()
    return docs.withColumns(dict(zip(names, row_names(docs, text, doc_id), strict=True))).join(found, names, "left_anti").drop(*names)
