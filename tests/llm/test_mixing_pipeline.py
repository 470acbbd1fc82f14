import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing


def draws(rows, seed=mixing.SEED):
    """{(doc_id, source): count} by plain inversion."""
    chars = {}
    for _, text, source in rows:
        chars[source] = chars.get(source, 0) + len(text or "")
    live = [s for s, n in chars.items() if n]
    out = {}
    for i, text, source in rows:
        mean = sum(chars.values()) / len(live) / chars[source] if chars[source] else 0.0
        parts = max(1, math.ceil(mean / mixing.PART))
        n = 0
        for part in range(1, parts + 1):
            name = i if i is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
            u = int(hashlib.md5(f"{seed}:{part}:{name}".encode()).hexdigest()[:13], 16) / 2**52
            m, k = mean / parts, 0
            p = math.exp(-m)
            total = p
            while total <= u and k < m + 12 * math.sqrt(m) + 24:
                k += 1
                p *= m / k
                total += p
            n += k
        out[i, source] = n
    return out


def test_counts_equal_plain_inversion(spark):
    rows = [(i, "x" * (i % 50 + 1), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(1000, "tiny", "rare"), (1001, "", "empty"), (1002, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy", F.lit("old"))
    got = mixing.mix(df).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("c"), F.count_distinct("mix_key").alias("k")).collect()
    want = {k: v for k, v in draws(rows).items() if v}
    assert {(r["doc_id"], r["source"]): r["n"] for r in got} == want and all(r["n"] == r["c"] == r["k"] for r in got)
    assert want[1000, "rare"] > mixing.PART
    assert mixing.mix(df.where("false")).count() == 0


def test_shares_meet_the_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text of ten").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"big": 1.0, "small": 3.0, "absent": 5.0}).groupBy("source").count().collect()}
    assert got["big"] == pytest.approx(5_000, rel=0.05) and got["small"] == pytest.approx(15_000, rel=0.05)
    assert mixing.mix(df, {"big": 1.0}).where("source = 'small'").count() == 0


def test_a_minute_source_is_drawn_by_many_tasks(spark):
    rows = [(1, "x", "minute"), (2, "y" * 2_000_000, "large")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(2))
    got = mixed.where("source = 'minute'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    n = sum(r["count"] for r in got)
    assert n == draws(rows)[1, "minute"] and abs(n - 1_000_000) < 5_000
    assert len(got) > 1 and max(r["count"] for r in got) < 0.6 * n


def test_a_mean_beyond_the_limit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST", 500.0)
    df = spark.createDataFrame([(1, "x", "minute"), (2, "y" * 2_000, "large")], "doc_id bigint, text string, source string")
    with pytest.raises(Exception, match="too few characters for the target of source minute"):
        mixing.mix(df)


def test_null_ids_and_repeated_rows_are_dealt_apart(spark):
    rows = [(None, f"text number {i}", "a") for i in range(300)] + [(7, "one text, many rows", "a")] * 300 + [(None, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        mixed = mixing.mix(df, {"a": 1.0}).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(setting, before)
    n = {t: draws([(None, t, "a")])[None, "a"] for _, t, _ in rows[:300]}  # one source: every mean is 1
    got = [r["text"] for r in mixed if r["doc_id"] is None and r["text"]]
    assert {t: got.count(t) for t in n} == n and 100 < len(set(got)) < 260
    same = [r["p"] for r in mixed if r["doc_id"] == 7]
    assert len(same) % 300 == 0 and (not same or len(set(same)) > 1)


def test_order_is_global_and_repeatable(spark):
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    parts = mixing.mix(df).select("doc_id", "mix_key", F.spark_partition_id().alias("p")).collect()
    for p in {r["p"] for r in parts}:
        keys = [r["mix_key"] for r in parts if r["p"] == p]
        assert keys == sorted(keys)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "copy", "mix_key").collect())) == sorted(map(tuple, mixing.mix(df).select("doc_id", "copy", "mix_key").collect()))


def stages_in_python(rows, bench):
    """The stages over [(doc_id, text, source)], by brute force."""
    from tests.llm.test_decontaminate import edit
    from tests.llm.test_line_dedup import brute
    from tests.llm.test_native import count
    from tests.llm.test_simhash import jaccard, roots

    from tessera.llm import decontaminate, quality_rules

    def good(text):
        q = count(text) | {"n_bullet_lines": 0, "n_cut_lines": 0}
        if q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"]:
            return False
        return all((r.low is None or 1000 * q[r.over] >= r.low * q[r.under]) and (r.high is None or 1000 * q[r.over] <= r.high * q[r.under]) for r in quality_rules.RULES)

    yield (rows := [r for r in rows if good(r[1])])
    yield (rows := [(i, t, s) for (i, _, s), (t, _, _) in zip(rows, brute([r[:2] for r in rows]), strict=True)])
    rows = sorted(rows)
    found = roots(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    yield (rows := [r for k, r in enumerate(rows) if found[k] == k])
    items = [decontaminate.normalise(t) for t in bench]
    yield (rows := [r for r in rows if not any(edit(x, decontaminate.normalise(r[1])) <= decontaminate.budget(x) for x in items)])
    yield draws(rows)


def test_stages_equal_brute_force(spark, tmp_path):
    import random

    rng = random.Random(6)
    words = [w + c for w in "alpha beta gamma delta omega sigma kappa theta".split() for c in "abcdefghij"]
    body = lambda n: " ".join("the" if k % 8 == 0 else rng.choice(words) for k in range(n))
    item = body(14)
    texts = [body(rng.choice((30, 60, 90))) for _ in range(24)]
    texts += ["a line that many share, yes\n" + t for t in texts[5:12]] + [t.replace(" ", "  ") for t in texts[3:6]] + [texts[7] + " extra", body(60) + " " + item.upper() + "! " + body(5), "spam spam spam " * 40, None, ""]
    texts += [" ".join(w + "###" for w in body(60).split())]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    d = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = list(stages_in_python(rows, [item]))
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, steps, strict=True)):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{k}")
        out = spark.read.parquet(f"{d}/out{k}")
        if k < 4:
            assert out.columns == docs.columns, name
            assert sorted((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == sorted(want), name
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    got = {(r["doc_id"], r["source"]): r["count"] for r in docs.groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in steps[-1].items() if v} and len(steps[3]) < len(steps[2]) < len(steps[1]) < len(rows)
    ran = corpus_pipeline.run(spark, d)
    assert ran.count() == docs.count()


def test_stages_on_an_empty_table_and_more_columns(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 int, kept string, cls int, hits int, sketch int, mean int"
    docs = spark.createDataFrame([(None, None, None, None, None, 1, "k", 2, 3, 4, 5)], schema)
    for rows in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, d)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 1, k


def test_names_of_the_queries():
    from tessera.llm.queries import QUERIES

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))
    assert np.all([len(n) > 4 for n in QUERIES])
