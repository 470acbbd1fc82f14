import hashlib
import random

import pytest

from tessera.llm import line_dedup
from tessera.llm.common import NO_ID


def brute(docs):
    """(text that stays, lines before, lines dropped) of each (doc_id, text), in order."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(NO_ID if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (NO_ID if i is None else i)]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def run(spark, docs, **conf):
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(docs)], "n int, doc_id bigint, text string")
    got = line_dedup.dedup_lines(df, n_lines="n_lines", n_dropped="n_dropped").orderBy("n").collect()
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in got]


def test_odd_texts(spark):
    docs = [
        (5, "A shared line here\nown\n"), (3, "  a SHARED line here\t\nanother of its own"), (9, None), (8, ""), (7, "short\nshort"), (6, "short"),
        (None, "a shared line here\nnull id line of text"), (None, "null id line of text"), (3, "a shared line here\nrepeated id"), (5, "A shared line here\nown\n"),
        (11, "ünïcödé li\nünïcödé l"), (12, "ünïcödé li\nünïcödé l"), (13, "a shared line here\n" * 30), (14, "\x1fA shared line here"), (2, "x\r\nÀ shared line here"),
    ]
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora_with_a_hot_line(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {k} of the pool" for k in range(60)]
    docs = [(i, "\n".join(["the hot line of all"] * rng.randint(0, 2) + rng.choices(pool, k=rng.randint(0, 30)) + [f"own line of {i}"])) for i in rng.sample(range(4000), 500)]
    assert run(spark, docs) == brute(docs)


def test_a_key_that_spans_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = [(i, "the only line there is\n" * 3) for i in range(400)]
        assert run(spark, docs) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some line of text", "a", 5), (2, "some line of text", "b", 6)], "doc_id bigint, text string, keep string, n_dropped int")
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "some line of text", "a", 5), (2, "", "b", 6)]


def test_digest(spark, tiny):
    from tessera.llm.queries import op4_line_dedup

    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (t, n, k) in zip(docs, brute(docs), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in op4_line_dedup(spark, tiny).collect()} == want
