"""SimHash near-dedup with pivot distance tables.

Pivots: the Hamming distances of every fingerprint to many reference fingerprints are its coordinates, computed once
a fingerprint and carried along. By the triangle inequality, two fingerprints at distance d differ by at most d in each
coordinate, so a pair with a larger coordinate difference is discarded unseen; the survivors are verified.

The tables can discard pairs but not list them below the square of the rows, so pairs are looked for in
buckets only:

- ``links``: fingerprints cut into ``BLOCKS`` blocks. Two that differ in r bits agree on all but r blocks, so
  every choice of BLOCKS - r blocks is a table of buckets, and no pair is lost. With 6 blocks and r = 2, 15
  tables; a bucket holds different fingerprints that share at least 42 bits, so at most 2**22 of them.
- ``near_duplicates``: minwise bands of the shingles, because a similarity of 0.8 is up to a third of the
  bits, beyond exact blocks; the pairs are verified by the exact similarity of their shingles.

A bucket gives links that join classes, never those inside a class. Copies are one fingerprint or one word
sequence before any of this, so a text that a third of all rows hold costs one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_names
from .components import components

SEED = 42
BLOCKS = 6
CHUNK = 1 << 16
#: The reference fingerprints; eight distances are one bigint of the table.
PIVOTS = np.random.default_rng(20).integers(0, 2**64, 16, dtype=np.uint64)
#: From so many fingerprints on, a bucket is searched by the bits in which its members can differ.
DENSE = 4096

BANDS, ROWS = 16, 4
#: Largest Hamming distance of 64 bits at which a leader takes a member. At a similarity of 0.8 a bit differs
#: with probability 0.15: 9.7 bits, standard deviation 2.9. What it leaves is held against the whole bucket later.
NEAR_BITS = 22
#: So many leaders of a bucket take members.
LEADERS = 1024
#: The links that these many bands propose are verified first; those of the others only where they would join
#: two classes.
FIRST = 4
#: So many members of a bucket, about, are held against its strays by one task.
SALTED = 4096
#: Bits of the parities of a shingle set.
PARITIES = 1024


def _shingle_hashes(raw: bytes, words: int) -> Iterator[np.ndarray]:
    """Chunks of the XXH64 of a text's shingles, repeats included; nothing if it has no word."""
    found = raw.lower().split()
    if not found:
        return
    flat, n = b" ".join(found), len(found)
    if n <= words:
        yield np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    del found
    digest = xxhash.xxh64_intdigest
    for at in range(0, n - words + 1, CHUNK):
        to = min(at + CHUNK, n - words + 1)
        yield np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)], dtype=np.uint64)


_PLACE = np.arange(8, dtype=np.uint16) << 8
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, by way of how often each byte occurs at each place."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    return (seen.reshape(8, 256) @ _BYTE_BITS).ravel()


def simhash(raw: bytes, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if more than half of the shingles have it."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in _shingle_hashes(raw, words):
        counts += _bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprint(words: int):
    @F.pandas_udf("bigint")
    def fingerprint(text: pd.Series) -> pd.Series:
        return text.map(lambda raw: simhash(raw, words))

    return fingerprint


def fingerprint(text: Column, words: int = 3) -> Column:
    """The SimHash of a text column: A-Z lower-cased, words of anything but space and U+0009 to U+000D,
    shingles of ``words`` words joined by a space, fewer words as one shingle. No words, or null: zero."""
    return _fingerprint(words)(F.coalesce(text, F.lit("")).cast("binary"))


def coordinates(fp: Column) -> list[Column]:
    """The pivot table's entry of a fingerprint column: bigints of eight distances each."""

    def packed(some: np.ndarray) -> Column:
        far = [F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("bigint") for p in some.view(np.int64)]
        return reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(far)])

    return [packed(PIVOTS[i : i + 8]) for i in range(0, len(PIVOTS), 8)]


COORDINATES = [f"c{i}" for i in range(len(PIVOTS) // 8)]


def unpacked(columns: list[np.ndarray]) -> np.ndarray:
    """The distances in arrays of ``coordinates``: one row a pivot."""
    return np.ascontiguousarray(np.stack(columns, axis=1)).view(np.uint8).reshape(len(columns[0]), -1).T.astype(np.int16)


def distances(fps: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """The pivot table of fingerprints: one row a pivot."""
    return np.bitwise_count(fps[None, :] ^ pivots[:, None]).astype(np.int16)


def near(fps: np.ndarray, one: np.uint64, table: np.ndarray, of_one: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``fps`` lie within ``bits`` of ``one``: the first pivots discard, then all, then the distance decides."""
    left = np.arange(len(fps))
    for some in (slice(0, 4), slice(4, None)):
        apart = np.abs(table[some][:, left] - of_one[some, None]).max(axis=0, initial=0)
        left = left[apart <= bits]
    return left[np.bitwise_count(fps[left] ^ one) <= bits]


def forest(fps: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indices, of the links among different fingerprints with this pivot table.

    Breadth first, and what is reached leaves the table: a bucket whose members are all close costs one row
    of comparisons, not the square.
    """
    if len(fps) == 2:
        close = np.abs(table[:, 0] - table[:, 1]).max() <= bits and np.bitwise_count(fps[0] ^ fps[1]) <= bits
        return [(0, 1)] if close else []
    out: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(fps[rest], fps[x], table[:, rest], table[:, x], bits)
            if len(hit):
                reached = rest[hit]
                out += [(x, int(y)) for y in reached]
                queue += reached.tolist()
                rest = np.delete(rest, hit)
    return out


def dense_forest(fps: np.ndarray, free: list[int], bits: int) -> list[tuple[int, int]]:
    """The same for a large bucket, whose members differ in the ``free`` bits only: every fingerprint looks up those
    that differ from it in one to ``bits`` of them, so the time is the members times a constant, never the square."""
    order = np.argsort(fps)
    known = fps[order]
    root = np.arange(len(fps))
    flips = [sum(1 << b for b in some) for k in range(1, bits + 1) for some in combinations(free, k)]
    while True:
        before = root.copy()
        for flip in flips:
            other = known ^ np.uint64(flip)
            at = np.searchsorted(known, other)
            at[at == len(known)] = 0
            met = np.flatnonzero(known[at] == other)
            a, b = root[met], root[at[met]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, hi, lo)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return [(int(order[r]), int(order[i])) for i, r in enumerate(root.tolist()) if r != i]


def _masks(bits: int, blocks: int = BLOCKS) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(parts[i] for i in keep) for keep in combinations(range(blocks), blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(batches: Iterator[pa.RecordBatch], key: list[str], rest: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of two or more rows with equal ``key`` in sorted batches, as arrays of the ``rest`` columns."""
    held: list[np.ndarray] | None = None

    def runs(cols: list[np.ndarray], last: bool):
        keys, values = cols[: len(key)], cols[len(key) :]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(keys[0])]))
        full = edges if last else edges[:-1]
        for i in np.flatnonzero(np.diff(full) > 1):
            yield tuple(v[full[i] : full[i + 1]] for v in values)
        return [] if last else [c[edges[-2] :] for c in cols]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in key + rest]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        held = yield from runs(cols, False)
    if held:
        yield from runs(held, True)


def links(fps: DataFrame, bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) that join the same classes as the pairs of different ``fp`` (bigint) that differ in at most ``bits`` bits:
    a spanning forest of the pairs, or in a bucket of DENSE fingerprints and more, of each class's members and its first."""
    unsigned = _masks(bits, blocks)
    masks = [_signed(m) for m in unsigned]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    once = fps.select("fp").distinct().select("fp", *[c.alias(n) for n, c in zip(COORDINATES, coordinates(F.col("fp")), strict=True)])
    rows = once.select("fp", *COORDINATES, F.inline(keys)).repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for t, fp, *cs in _bucketed(batches, ["t", "k"], ["t", "fp", *COORDINATES]):
            some = fp.view(np.uint64)
            if len(fp) < DENSE:
                found = forest(some, unpacked(cs), bits)
            else:
                found = dense_forest(some, [i for i in range(64) if not unsigned[int(t[0])] >> i & 1], bits)
            a += [int(fp[i]) for i, _ in found]
            b += [int(fp[j]) for _, j in found]
            if len(a) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(find, "a bigint, b bigint")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row a row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the least doc_id reachable, the
    own one included. Null and wordless texts have fingerprint zero and link like any other; a null id takes
    part and is never the least, so a component of null ids only has none. Repeated rows come back each, very long
    texts are read whole, an empty table gives an empty result, and other columns don't matter, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`"), words).alias("fp")))
    each = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(marked, bits), scratch)
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near duplicates on word shingles -------------------------------------------------------------------------


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(64)
    return rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


_MULTIPLY, _ADD = _mixers()


def _sketch(raw: bytes, words: int) -> tuple[bytes, int, bytes]:
    """Of a text: the 128-bit hash of its word sequence, the fingerprint of its different shingles (``simhash``
    counts repeats, by which texts of nearly the same set can be far apart), and a hash for each minwise band."""
    parts = list(_shingle_hashes(raw, words))
    h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    fp = int(np.packbits(_bit_counts(h) * 2 > len(h), bitorder="little").view(np.int64)[0])
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    h = h ^ (h >> np.uint64(29))
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    bands = np.array([xxhash.xxh3_64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], dtype=np.uint64)
    return xxhash.xxh3_128_digest(b" ".join(raw.lower().split())), fp, bands.tobytes()


def _sketches(words: int):
    @F.pandas_udf("words binary, fp bigint, bands array<bigint>")
    def sketches(text: pd.Series) -> pd.DataFrame:
        found = [_sketch(raw, words) for raw in text]
        return pd.DataFrame({"words": [a for a, _, _ in found], "fp": [b for _, b, _ in found], "bands": [np.frombuffer(c, dtype=np.int64) for _, _, c in found]})

    return sketches


def _shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    parts = list(_shingle_hashes(raw, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _parity(shingles: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether an odd number of the shingles falls to each. Sets that differ in d shingles differ
    in d bits at most."""
    odd = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _shingle_sets(words: int):
    @F.pandas_udf("n int, parity array<bigint>, s binary")
    def sets(text: pd.Series) -> pd.DataFrame:
        found = [_shingle_set(raw, words) for raw in text]
        return pd.DataFrame({"n": pd.Series(map(len, found), dtype="int32"), "parity": pd.Series(map(_parity, found), dtype=object), "s": pd.Series([x.tobytes() for x in found], dtype=object)})

    return sets


def _jaccard_at_least(similarity: float):
    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        def test(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                return False
            common = len(np.intersect1d(p, q, assume_unique=True))
            return common >= similarity * (len(p) + len(q) - common)

        return pd.Series([test(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return enough


_FOUND = "band int, k bigint, rank bigint, fp bigint, rep bigint, leader bigint"


def _leaders(band, k, rank, fp, rep) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, k, rank): a row of a bucket joins the bucket's first leader within NEAR_BITS, or
    leads, as long as there are no more than LEADERS; what is left is linked by ``_strays`` if at all. The links come back
    as (band, rep, leader), the leaders with their bucket and a null leader."""
    new = (band[1:] != band[:-1]) | (k[1:] != k[:-1])
    edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(k)]))
    leads, member, leader, by = np.ones(len(k), dtype=bool), [], [], []
    for i in np.flatnonzero(np.diff(edges) > 1):
        rest = np.arange(edges[i], edges[i + 1])
        fps = fp.view(np.uint64)
        table, base, n = distances(fps[rest]), rest[0], 0
        while len(rest) > 1:
            n += 1
            if n > LEADERS:
                leads[rest] = False
                break
            lead, rest = rest[0], rest[1:]
            hit = near(fps[rest], fps[lead], table[:, rest - base], table[:, lead - base], NEAR_BITS)
            leads[rest[hit]] = False
            member.append(rep[rest[hit]])
            leader.append(np.full(len(hit), rep[lead]))
            by.append(np.full(len(hit), band[lead]))
            rest = np.delete(rest, hit)
    schema = pa.schema([("band", pa.int32()), *[(c, pa.int64()) for c in ("k", "rank", "fp", "rep", "leader")]])
    yield pa.RecordBatch.from_arrays([pa.array(x[leads]) for x in (band, k, rank, fp, rep)] + [pa.nulls(int(leads.sum()), pa.int64())], schema=schema)
    if member:
        got, n = np.concatenate(member), sum(map(len, member))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(by)), *[pa.nulls(n, pa.int64())] * 3, pa.array(got), pa.array(np.concatenate(leader))], schema=schema)


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of a bucket that a third of all rows fall into, each batch leaves a leader or two."""
    for batch in batches:
        if batch.num_rows:
            rep = np.repeat(batch.column(0).to_numpy(), BANDS)
            fp = np.repeat(batch.column(1).to_numpy(), BANDS)
            k = batch.column(2).flatten().to_numpy()
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            with np.errstate(over="ignore"):
                rank = ((rep.view(np.uint64) ^ _ADD[band]) * _MULTIPLY[band] >> np.uint64(1)).view(np.int64)
            order = np.lexsort((rank, k, band))
            yield from _leaders(*(x[order] for x in (band, k, rank, fp, rep)))


def _across_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After it: buckets stream by; the leaders of the bucket at a batch's end go on to the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(c).to_numpy() for c in ("band", "k", "rank", "fp", "rep")]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            found = list(_leaders(*cols))
            yield from found[1:]
            last = found[0]
            at = [last.column(i).to_numpy() for i in range(5)]
            same = (at[0] == at[0][-1]) & (at[1] == at[1][-1])
            held = [x[same] for x in at]


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, body, cls), one row a row of ``docs``: id and body are its row_names, cls names its class of near duplicates.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles (as 64-bit hashes) is at least
    ``similarity``; texts of the same words (by a 128-bit hash) are one. Similar pairs share one of 16 minwise bands with
    probability 0.9998 at 0.8 and more above it. A proposed link counts if the exact similarity reaches the bound. First,
    each bucket proposes links from members to leaders only, with leaders chosen anew in every band: one a member and band,
    however large a class is. Then ``_strays`` proposes whatever may still join two classes, so the classes are those of
    all pairs that share a bucket, and how rows are batched and which rows lead changes nothing.

    Null and empty texts have no words and are copies of each other; an empty table gives an empty result.
    """
    marked, named = _named(docs, text, doc_id, words, similarity)
    return marked.select("id", "body", "words").join(named.select("words", "cls"), "words").select("id", "body", "cls")


def _named(docs: DataFrame, text: str, doc_id: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, body, words) of every row, and (words, r, cls) of every word sequence, r the least (id, body) that has it."""
    scratch = Scratch(docs.sparkSession, "near")
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    ident, key = row_names(docs, text, doc_id)
    marked = docs.select(ident.alias("id"), key.alias("body"), _sketches(words)(body).alias("s"))
    marked = scratch.keep(marked.select("id", "body", "s.*"))
    # copies meet here only, and each task sends one row a word sequence; its number in the written table is its name
    each = marked.groupBy("words").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("id", "body")).alias("r"))
    each = scratch.keep(each.withColumn("sketch", F.monotonically_increasing_id()))
    # the buckets of two or more, and what is needed of their members, once
    rows = each.select("sketch", F.explode("bands").alias("k"))
    members = scratch.keep(rows.join(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k"))
    wanted = each.select("sketch", "r.*").join(members.select("sketch").distinct(), "sketch")
    texts = docs.select(ident.alias("id"), key.alias("body"), body.alias("raw")).join(wanted, ["id", "body"]).dropDuplicates(["sketch"])
    sets = scratch.keep(texts.select("sketch", _shingle_sets(words)("raw").alias("m")).select("sketch", "m.*"))

    within = scratch.keep(each.join(members.select("sketch").distinct(), "sketch", "left_semi").select("sketch", "fp", "bands").mapInArrow(_within_batches, _FOUND))
    heads = within.where("leader is null").select("band", "k", "rank", "fp", "rep").repartition("band", "k").sortWithinPartitions("band", "k", "rank")
    proposed = within.where("leader is not null").select("band", "rep", "leader").unionByName(heads.mapInArrow(_across_batches, _FOUND).select("band", "rep", "leader"))
    pairs = scratch.keep(proposed.where("leader is not null").groupBy(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).agg(F.min("band").alias("band")))

    def verified(some: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("sketch").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        return some.select("a", "b").join(one, "a").join(two, "b").where(_jaccard_at_least(similarity)("sa", "sb")).select("a", "b")

    found = scratch.keep(verified(pairs.where(F.col("band") < FIRST)))
    cls = scratch.keep(components(found, scratch))
    of = lambda c: cls.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    rest = pairs.where(F.col("band") >= FIRST).join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = scratch.keep(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    edges = scratch.keep(cls.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(apart)))
    cls = scratch.keep(components(edges, scratch))
    rooted = members.join(cls.withColumnRenamed("node", "sketch"), "sketch", "left").select("k", "sketch", F.coalesce("root", "sketch").alias("cls"))
    left = scratch.keep(_strays(rooted, pairs, lambda some: sets.select("sketch", "n", "parity").join(some, "sketch"), similarity, scratch))
    edges = cls.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(left))
    roots = components(edges, scratch).withColumnRenamed("node", "sketch")
    return marked.select("id", "body", "words"), each.join(roots, "sketch", "left").select("words", "r", F.coalesce("root", "sketch").alias("cls"))


def _strays(members: DataFrame, tried: DataFrame, marks: Callable[[DataFrame], DataFrame], similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sketches that share a bucket, are of two classes, were not tried, and may be similar by the
    sizes and parities of their sets.

    ``members``: (k, sketch, cls) of the buckets of two and more; ``marks`` gives sketch, n and parity of some
    sketches. Two classes of a bucket meet only where a stray takes part, a member outside the bucket's largest
    class; so the strays of a bucket, not its members, are held against the whole bucket, and one pass is enough.
    Large buckets are dealt over salts. Sets of n and m shingles that are similar enough differ in at most
    (n + m) (1 - similarity) / (1 + similarity) shingles, each of which flips one bit of the parities, so more
    differing bits discard a pair for certain; nothing else does.
    """
    mixed = members.groupBy("k").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    salts = mixed.select("k", F.ceil(F.col("n") / SALTED).alias("salts"))
    held = scratch.keep(members.join(salts, "k").withColumn("salt", F.pmod(F.xxhash64("sketch"), "salts")))
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    sizes = held.groupBy("k", "salts", "cls").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("k", "salts").agg(F.max(F.struct("n", "cls")).getField("cls").alias("largest")).select("k", each, "largest")
    held = scratch.keep(held.join(largest, ["k", "salt"]).join(marks(held.select("sketch").distinct()), "sketch"))
    mine = ["sketch", "cls", "n", "parity"]
    strays = held.where("cls <> largest").select("k", each, *[F.col(c).alias(f"s_{c}") for c in mine])
    salted = held.select("k", "salt", *mine)
    most = (F.col("n") + F.col("s_n")) * F.lit(1 - similarity) + F.lit(1e-6)
    fit = F.least("n", "s_n") >= F.greatest("n", "s_n") * F.lit(similarity) - F.lit(1e-6)
    for n in (2, PARITIES // 64):  # the first two words discard most pairs
        apart = sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("s_parity")[i])) for i in range(n))
        fit &= apart * F.lit(1 + similarity) <= most
    met = salted.join(strays, (salted["k"] == strays["k"]) & (salted["salt"] == strays["salt"]) & (F.col("cls") != F.col("s_cls")) & fit)
    return met.select(F.greatest("sketch", "s_sketch").alias("a"), F.least("sketch", "s_sketch").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near duplicates the one with the least doc_id. A null
    id comes last; of rows that share the id, the least MD5 of the text stays, and one of equal rows. Texts
    without words, null ones too, are copies of each other. Very long texts are compared whole; an empty table gives an
    empty result; columns stay as they are, whatever their names."""
    _, named = _named(docs, text, doc_id, words, similarity)
    first = named.groupBy("cls").agg(F.min("r").alias("r")).select(F.col("r.id").alias("_tessera_id"), F.col("r.body").alias("_tessera_body"))
    ident, key = row_names(docs, text, doc_id)
    keys = ["_tessera_id", "_tessera_body"]
    left = docs.withColumns({"_tessera_id": ident, "_tessera_body": key}).join(first, keys, "left_semi")
    numbered = left.withColumn("_tessera_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_tessera_body")))
    return numbered.where("_tessera_n = 1").drop(*keys, "_tessera_n")
