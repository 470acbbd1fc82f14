import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import Scratch
from tessera.llm.components import components


def fingerprint(text, k=3):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d", "ÀÉ\u00a0x \u2003y z w", "w " * 200_000, "the cat sat on the mat " * 7])
def test_fingerprint(text):
    assert simhash.simhash((text or "").encode(), 3) % 2**64 == fingerprint(text)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("select xxhash64('a b c') as h").first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def near_fingerprints(rng, n):
    out = []
    for _ in range(n // 5):
        x = rng.getrandbits(64)
        for _ in range(5):
            out.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    return out


def test_links_lose_no_pair(spark):
    fps = sorted(set(near_fingerprints(random.Random(2), 600)))
    want = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    edges = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in edges)
    at = {x: i for i, x in enumerate(fps)}
    joined = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    assert roots(len(fps), lambda i, j: (i, j) in joined) == want


def test_pivots_discard_no_close_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps[1::3] = fps[::3] ^ np.uint64(5)
    table = simhash.distances(fps)
    for i in range(0, 300, 7):
        want = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
        assert simhash.near(fps, fps[i], table, table[:, i], 2).tolist() == want.tolist()


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1300)]
    df = spark.createDataFrame([*chain, *hub, (3, 3), (100, 101), (5000, 4000)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(1000, 1300))}, 4000: 4000, 5000: 4000}
    assert components(df.where("false"), Scratch(spark, "t")).count() == 0


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choices(words, k=rng.choice((0, 1, 2, 3, 30, 400)))) for _ in range(60)]
    texts = base + [b + " x" for b in base[:20]] + base[:10] + [None, "", " ", b"\xc3\xa9".decode()] + [base[5].upper()]
    ids = rng.sample(range(10_000), len(texts) - 1) + [None]
    fps = [fingerprint(t) for t in texts]
    found = roots(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for i, r in zip(ids, found, strict=True):
        least[r] = min(least.get(r, 1 << 62), 1 << 62 if i is None else i)
    want = sorted((i, f, least[r]) for i, f, r in zip(ids, fps, found, strict=True) if i is not None)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, fp string, component_id int")
    got = simhash.classes(df).collect()
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(texts)
    assert simhash.classes(df.where("false")).count() == 0


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y)) if x or y else 1.0


def test_keep_one_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            changed = list(words)
            for _ in range(rng.choice((0, 1, 2, 3))):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    texts += [texts[0].replace(" ", "\n"), texts[1].upper(), "", None, "two words", "two words"]
    ids = rng.sample(range(1000), len(texts))
    found = roots(len(texts), lambda i, j: jaccard(texts[i] or "", texts[j] or "") >= 0.8)
    want = sorted(min(i for i, r in zip(ids, found, strict=True) if r == root) for root in set(found))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, cls string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_families_alike_only_here_and_there_equal_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):  # windows over one sequence: near their neighbours, not near a leader
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words[i : i + 150]) for i in range(0, 250, rng.choice((10, 12, 14, 16)))]
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(200), n):
            words[at] = f"w{rng.randrange(10**6)}"
        return words

    for _ in range(150):  # twins, below the bound to all other texts of their buckets
        twin = changed(base, 4)
        texts += [" ".join(twin), " ".join(changed(twin, 2))]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    found = roots(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = [i for i, r in enumerate(found) if i == r]
    assert len(want) < 250
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for rows in ("7", "10000"):
            spark.conf.set(setting, rows)
            assert sorted(r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()) == want
    finally:
        spark.conf.set(setting, before)


def test_passages_repeated_inside_a_text_equal_brute_force(spark):
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for times in (20, 40) * 12:  # a passage many times against once: nearly the same set of shingles
        body, passage = new(500), new(16)
        texts += [" ".join(body + passage * times), " ".join(body + passage)]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    found = roots(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = [i for i, r in enumerate(found) if i == r]
    assert len(want) == 24
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()) == want


def test_short_similar_texts_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(10)
    rows = []
    while len(rows) < 12:  # 5 shingles and 4 of them: a similarity of 0.8
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(9))
        less = text.rsplit(" ", 1)[0]
        if ((simhash.simhash(text.encode(), 5) ^ simhash.simhash(less.encode(), 5)) % 2**64).bit_count() > simhash.NEAR_BITS + (len(rows) < 2):
            if set(np.frombuffer(simhash._sketch(text.encode(), 5)[2], dtype=np.int64).tolist()) & set(np.frombuffer(simhash._sketch(less.encode(), 5)[2], dtype=np.int64).tolist()):
                rows += [(len(rows), text), (len(rows) + 1, less)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(0, 12, 2))


def test_more_leaders_than_take_members_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(120), n):
            words[at] = f"w{rng.randrange(10**6)}"
        return words

    texts = []
    for _ in range(60):
        twin = changed(base, 6)
        texts += [" ".join(twin), " ".join(changed(twin, 1))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    found = roots(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = [i for i, r in enumerate(found) if i == r]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "LEADERS", 1)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()) == want


def test_parities_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(8)
    for n in (0, 1, 30, 3000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.union1d(x[: n // 2], rng.integers(0, 2**64, n // 3, dtype=np.uint64))
        bits = int(np.bitwise_count((simhash._parity(x) ^ simhash._parity(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y)) and bits % 2 == len(np.setxor1d(x, y)) % 2


def test_strays_meet_their_whole_bucket_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SALTED", 2)
    members = [(7, s, 1) for s in range(1, 8)] + [(100 + s, s, 1) for s in range(1, 8)] + [(7, 20, 20), (120, 20, 20), (7, 21, 21), (8, 22, 22)]
    df = spark.createDataFrame(members, "k bigint, sketch bigint, cls bigint")
    tried = spark.createDataFrame([(20, 3)], "a bigint, b bigint")
    odd = lambda s: [(1 << 23) - 1 if s == 5 else 0] + [0] * 14 + [(1 << 30) - 1 if s == 4 else 0]  # 23 and 30 bits
    size = lambda s: 79 if s == 21 else 100
    marks = lambda named: spark.createDataFrame([(s, size(s), odd(s)) for (s,) in {(m[1],) for m in members}], "sketch bigint, n int, parity array<bigint>").join(named, "sketch")
    got = sorted(tuple(r) for r in simhash._strays(df, tried, marks, 0.8, Scratch(spark, "t")).collect())
    assert got == [(20, b) for b in (1, 2, 6, 7)]


def test_dense_buckets_join_the_same_classes(spark, monkeypatch):
    rng = random.Random(5)
    free = [*range(0, 11), *range(21, 32)]
    fps = {0}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        for _ in range(rng.choice((1, 2, 3, 4))):
            x ^= 1 << rng.choice(free)
        fps.add(x)
    fps = sorted(fps)
    some = np.array(fps, dtype=np.uint64)
    joined = {frozenset(x) for x in simhash.dense_forest(some, free, 2)} | {frozenset((i, i)) for i in range(300)}
    want = roots(300, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert roots(300, lambda i, j: frozenset((i, j)) in joined) == want
    plain = {frozenset(x) for x in simhash.forest(some, simhash.distances(some), 2)}
    assert roots(300, lambda i, j: frozenset((i, j)) in plain) == want
    monkeypatch.setattr(simhash, "DENSE", 3)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components(simhash.links(df), Scratch(spark, "t")).collect()}
    assert [got.get(x, x) for x in fps] == [fps[r] for r in want]


def test_coordinates_are_the_distances_to_the_pivots(spark):
    fps = np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").coalesce(1)
    rows = df.select(*simhash.coordinates(F.col("fp"))).collect()
    columns = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(len(simhash.COORDINATES))]
    assert np.array_equal(simhash.unpacked(columns), simhash.distances(fps))


def test_keep_one_of_equal_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (4, "same text here"), (None, "other")], "doc_id bigint, text string")
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str) == [(False, 4, "same text here"), (True, None, "other")]
    assert simhash.keep_one(df.where("false")).count() == 0


def test_recall_on_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))})
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else False
    found = roots(len(texts), lambda i, j: close(sets[i], sets[j]))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows)).select("doc_id").collect()}
    want = {rows[i]["doc_id"] for i, r in enumerate(found) if i == r}
    assert kept == want
