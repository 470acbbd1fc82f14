import random

from pyspark.sql import functions as F

from tessera.llm import decontaminate as d


def edit(pattern, text):
    """Least distance of the pattern to a stretch of the text, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choices(b"abc ", k=rng.randint(1, 90)))
        t = bytes(rng.choices(b"abc ", k=rng.randint(0, 120)))
        best, end = d.myers(p, t)
        assert best == edit(p, t) and (best == len(p) or edit(p, t[:end]) == best)


def edited(rng, item, k):
    x = list(item)
    for _ in range(k):
        at = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[at] = rng.choice("qzj")
        elif kind == 1:
            del x[at]
        else:
            x.insert(at, rng.choice("qzj"))
    return "".join(x)


def test_search_equals_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 30)))) for i in range(25)] + [(25, "tiny")]
    texts = []
    for k in range(80):
        around = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(2)]
        i = rng.randrange(25)
        texts.append(around[0] + " " + edited(rng, items[i][1], rng.randint(0, 12)) + " " + around[1] if k % 4 else around[0])
    index = d.Index([(i, d.normalise(t)) for i, t in items])
    for text, hits in zip(texts, d.search(index, texts), strict=True):
        body = d.normalise(text)
        want = {i: edit(d.normalise(t), body) for i, t in items if len(d.normalise(t)) >= d.PIECE}
        want = {i: e for i, e in want.items() if e <= d.budget(d.normalise(items[i][1]))}
        assert {h[0] for h in hits} == set(want)
        for i, e, lo, hi, _ in hits:
            assert e == want[i] and edit(d.normalise(items[i][1]), body[lo:hi]) == e


def test_normalise_and_odd_texts():
    assert d.normalise("  Ärger,\n“quoted”—X_1\x00 ") == "ärger quoted x 1".encode()
    index = d.Index([(1, d.normalise("an item of some length, with words")), (2, b""), (3, b"short")])
    texts = [None, "", "x", "AN ITEM -- of some\nlength with   words!", "an item of some length with words " * 3, "\ud800"]
    got = d.search(index, texts)
    assert [bool(x) for x in got] == [False, False, False, True, True, False] and got[3][0][:2] == (1, 0) and len(got[4]) == 1
    assert d.search(d.Index([]), texts) == [[]] * 6


def test_blocks_cover_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    items = [(i, f"benchmark item number {i} has these words {i * 7919}") for i in range(12)] + [(None, "no id at all but long enough"), (50, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "see benchmark item number 3 has these words 23757 ok", 9), (2, "clean", 9), (None, None, 9), (1, "see benchmark item number 3 has these words 23757 ok", 9)], "doc_id bigint, text string, hits int")
    assert len(d._blocks(bench, "item_id", "text")) > 5
    got = d.leaks(docs, bench, [F.col("doc_id")]).collect()
    assert [r["doc_id"] for r in got if r["item_id"] == 3 and r["distance"] == 0] == [1, 1] and {r["doc_id"] for r in got} == {1}
    kept = d.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 2").collect()))
    # one block or many, the hits are the same
    monkeypatch.setattr(d, "BLOCK_BYTES", 8_000_000)
    assert sorted(d.leaks(docs, bench, [F.col("doc_id")]).collect()) == sorted(got) and d.drop_leaks(docs, bench).count() == 2
    assert d.drop_leaks(docs, bench.where("false")).count() == 4 and d.drop_leaks(docs.where("false"), bench).count() == 0


def test_planted_items_are_found(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    texts = {r["item_id"]: d.normalise(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if t in d.normalise(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench, [F.col("doc_id")]).collect()}
    assert want <= got and want


def test_short_items_equal_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(40)]
    items = sorted({d.normalise(" ".join(rng.choices(words, k=rng.randint(1, 3)))) for _ in range(60)})
    items = [x for x in items if len(x) < d.PIECE]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + ["a", "", None, "aé" * 9]
    index = d.Index(list(enumerate(items)))
    found = d.search(index, texts)
    assert sum(map(len, found)) > 100
    for text, hits in zip(texts, found, strict=True):
        body = b" " + d.normalise(text or "") + b" "
        places = [(i, body.find(b" " + x + b" "), len(x)) for i, x in enumerate(items)]
        assert sorted(hits) == [(i, 0, at, at + n, None) for i, at, n in places if at >= 0]


def test_items_without_an_id_and_short_items_are_searched(spark, monkeypatch):
    items = [(None, "an item without any id that is long"), (None, "and another one without an id"), (1, "Short."), (2, "of it"), (3, ""), (4, "?")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ["see an item without any id that is long, and another one without an id", "a short word", "shorter words", "words of items", "all of it", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for size in (8_000_000, 40):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = [(r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in d.leaks(docs, bench, [F.col("doc_id")]).collect()]
        assert sorted(got, key=str) == [(0, None, 0, 4, 39), (0, None, 0, 40, 69), (1, 1, 0, 2, 7), (4, 2, 0, 4, 9)]
        assert sorted(r["doc_id"] for r in d.drop_leaks(docs, bench).collect()) == [2, 3, 5]


def test_rows_do_not_depend_on_the_block_size(spark, monkeypatch):
    items = [(7, "One item, of some length."), (7, "one ITEM of some -- length"), (7, "a wholly different text of the item"), (7, "of it"), (None, "An item without an id"), (None, "an item, without an id!"), (8, "one item of some length")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    both = "x a wholly different text of the item, one item of some length; of it"
    rows = [(1, both, 5), (1, both, 5), (2, "an item without an id", 6), (None, "one item of some lengthy", 7), (3, "nothing", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, distance int")
    keys = [F.col("doc_id"), F.col("distance"), F.col("text").alias("start")]
    got = {}
    for size in (8_000_000, 60):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        found = d.leaks(docs, bench, keys)
        assert found.columns == ["doc_id", "doc_distance", "doc_start", "item_id", "distance", "start", "end"]
        got[size] = sorted(map(tuple, found.collect()), key=str)
        assert [r["doc_id"] for r in d.drop_leaks(docs, bench).collect()] == [3]
    assert got[8_000_000] == got[60]
    assert [(r[0], *r[3:]) for r in got[60]].count((1, 7, 0, 2, 37)) == 2 and len(got[60]) == 7


def test_long_texts_are_searched_whole(monkeypatch):
    item = "the item that stands somewhere in a very long text"
    index = d.Index([(1, d.normalise(item))])
    monkeypatch.setattr(d, "SLICE", 1000)
    rng = random.Random(4)
    for at in (0, 950, 990, 1000, 4999, 20_000):
        text = "".join(rng.choices("qxz ", k=at)) + " " + item + " " + "".join(rng.choices("qxz ", k=3000))
        ((hit,),) = d.search(index, [text])
        assert hit[:2] == (1, 0) and d.normalise(text)[hit[2] : hit[3]] == d.normalise(item)
