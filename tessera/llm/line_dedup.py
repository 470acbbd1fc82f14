"""Line dedup: every line key stays in the smallest document that holds it.

Line hashes are range-partitioned by (hash, document, position) and sorted within partitions. Each task
streams its range once: of a run of equal hashes, the rows of the first document stay and all others go. A
key that holds a third of all rows spans many ranges; only the first document of a range's first run is
open, and at most two rows a range (its open and its last run) settle that afterwards. What comes back is a
compressed keep bitmap for each document that loses lines, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_keys

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
_LINES = "h1 bigint, h2 bigint, doc bigint, body bigint, pos int"
_MARKS = "kind int, h1 bigint, h2 bigint, doc bigint, body bigint, pos int"
GONE, OPEN, LAST = 0, 1, 2


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "body", "pos"]
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[bytes] = []
            at: list[int] = []
            owner: list[int] = []

            def flush() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
                rows = np.asarray(owner, dtype=np.int64)
                full = pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.asarray(at, dtype=np.int32))], names
                )
                out.clear(), at.clear(), owner.clear()
                return full

            for row, raw in enumerate(batch.column(2)):
                for pos, line in enumerate(raw.as_py().split(b"\n")):
                    line = line.strip(WHITE)
                    # a code point has at most 4 bytes
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
                        out.append(digest(line.lower()))
                        at.append(pos)
                        owner.append(row)
                if len(out) >= 200_000:
                    yield flush()
            if out:
                yield flush()

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int, int] | None = None  # hash of the row before
    first_doc, runs = 0, 0
    names = ["kind", "h1", "h2", "doc", "body", "pos"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, doc, body, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.empty(n, dtype=bool)
        new[0] = last != (int(h1[0]), int(h2[0]))
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        owner = np.where(start >= 0, doc[np.maximum(start, 0)], first_doc)
        gone = doc != owner
        is_open = ~gone & (runs + np.cumsum(new) == 1)
        last, first_doc, runs = (int(h1[-1]), int(h2[-1])), int(owner[-1]), runs + int(new.sum())
        for kind, rows in ((GONE, gone), (OPEN, is_open)):
            if rows.any():
                k = int(rows.sum())
                hashes = [np.zeros(k, np.int64)] * 2 if kind == GONE else [h1[rows], h2[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(k, kind, np.int32), *hashes, doc[rows], body[rows], pos[rows])], names)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip((LAST, *last, first_doc, 0, 0), (pa.int32(), *[pa.int64()] * 4, pa.int32()), strict=True)], names)


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, body, pos) of every line that goes: doc and body are the row_keys."""
    doc, body = row_keys(docs, text, doc_id)
    lines = docs.select(doc.alias("doc"), body.alias("body"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("raw"))
    ranged = lines.mapInArrow(_hash_lines(min_chars), _LINES).repartitionByRange("h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos")
    marks = Scratch(docs.sparkSession, "lines").keep(ranged.mapInArrow(_first_occurrences, _MARKS))
    # at most two rows a range, so small however the keys fall
    owners = marks.where(F.col("kind") > GONE).groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    late = marks.where(F.col("kind") == OPEN).join(owners, ["h1", "h2"]).where("doc > owner")
    return marks.where(F.col("kind") == GONE).select("doc", "body", "pos").unionByName(late.select("doc", "body", "pos"))


def _pack(positions: pd.Series) -> pd.Series:
    def pack(gone) -> bytes:
        keep = np.ones(-(-(int(max(gone)) + 1) // 8) * 8, dtype=bool)
        keep[np.asarray(gone)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return positions.map(pack)


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, body, n_dropped, keep) of each document that loses lines.

    keep: zlib of packed bits, most significant first, one a line up to the last line that goes; lines
    beyond the end stay.
    """
    by_doc = dropped_lines(docs, text, doc_id, min_chars).groupBy("doc", "body").agg(F.collect_set("pos").alias("gone"))
    return by_doc.select("doc", "body", F.size("gone").cast("bigint").alias("n_dropped"), F.pandas_udf(_pack, "binary")("gone").alias("keep"))


def _apply(text: pd.Series, keep: pd.Series) -> pd.Series:
    def left(body: str | None, packed: bytes | None) -> str | None:
        if packed is None:
            return None
        lines = body.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
        return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])

    return pd.Series([left(a, b) for a, b in zip(text, keep, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the lines that stay, joined by a line feed, as ``text``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that two or more documents hold lose all their lines except in the smallest
    doc_id holding the key. A null text is one empty line and comes back empty; rows with a null id are one
    document after all others; rows that share an id are one document. ``n_lines`` and ``n_dropped`` name
    columns (replaced if there) for the lines before and those that went. Other columns pass through.
    """
    doc, body = row_keys(docs, text, doc_id)
    marked = docs.withColumns({text: F.coalesce(F.col(f"`{text}`"), F.lit("")), "_tessera_doc": doc, "_tessera_body": body})
    bits = keep_bitmaps(docs, text, doc_id, min_chars).select(*[F.col(a).alias(f"_tessera_{a}") for a in ("doc", "body", "n_dropped", "keep")])
    joined = marked.join(bits, ["_tessera_doc", "_tessera_body"], "left")
    old, keep = F.col(f"`{text}`"), F.col("_tessera_keep")
    new = {text: F.coalesce(F.pandas_udf(_apply, "string")(F.when(keep.isNotNull(), old), keep), old)}
    if n_lines:
        new[n_lines] = (F.length(old) - F.length(F.replace(old, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    if n_dropped:
        new[n_dropped] = F.coalesce("_tessera_n_dropped", F.lit(0)).cast("bigint")
    return joined.withColumns(new).drop("_tessera_doc", "_tessera_body", "_tessera_n_dropped", "_tessera_keep")


def sql(table: str = "documents", min_chars: int = MIN_CHARS) -> str:
    """The digests of ``dedup_lines`` for DuckDB."""
    return f"""
    with rows as (select *, row_number() over () as rn, string_split(coalesce(text, ''), chr(10)) as ln from {table}),
    lines as (
      select rn, doc_id, i, ln[i] as line,
             translate(regexp_replace(ln[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from (select rn, doc_id, ln, unnest(range(1, len(ln) + 1)) as i from rows)),
    held as (select key, min(doc_id) as owner from lines where length(key) >= {min_chars} group by key having count(distinct doc_id) > 1),
    kept as (select rn, i, line, owner is null or owner = lines.doc_id as stays from lines left join held using (key))
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (stays), '')) as kept_sha256
    from kept join rows using (rn) group by rn"""
