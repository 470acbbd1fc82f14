"""Quality rules, secrets and URL filter against plain Python, and that their plans hold no Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules, secrets, url_filter
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a", "x y z w x y z", "The the THE\n\nThe the THE\n x", "#$ % & | <b> *", "é\u00a0è ü\u2003ß", "- item\n- item\n• other...\nend…", "w " * 5000,
    " ".join(f"word{i}" for i in range(60)), "the of and " * 30, "line\r\nline\rline\x0b\x0cz",
]


def count(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_lines": len(lines), "n_stop_words": sum(x.lower() in set(quality_rules.STOP_WORDS) for x in w),
    }


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string")
    for r in quality_rules.judge(df).collect():
        q, want = r["quality"], count(TEXTS[r["doc_id"]])
        assert {k: q[k] for k in want} == want, TEXTS[r["doc_id"]]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert q["base_failed"] == failed and (not q["kept"] if failed else q["kept"] == (q["failed"] == ""))
    kept = quality_rules.keep_good(df.withColumn("quality", F.lit(1)))
    assert kept.columns == [*df.columns, "quality"] and kept.count() == 0 and quality_rules.judge(df.where("false")).count() == 0


def test_quality_of_repeated_and_very_long_rows(spark):
    long = " ".join(f"word{i} of the text" for i in range(120_000)) + "\n" + "the line of it\n" * 20_000
    texts = [long, long, "a few words", "a few words"]
    got = quality_rules.judge(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r, t in zip(got, texts, strict=True):
        want = count(t)
        assert {k: r["quality"][k] for k in want} == want
    assert got[0]["quality"] == got[1]["quality"] and got[2]["quality"] == got[3]["quality"]


def test_clean_documents_pass_and_junk_fails(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    judged = quality_rules.judge(docs, into="q").select("quality", "toxic", "q.base_failed", "q.kept").collect()
    clean = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in judged if r["quality"] == 0 and not r["base_failed"]]
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) <= 0.5 * len(junk)


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", m.start(), m.end())] * (len(m[1]) >= 8)
    for kind, pattern, n in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= n]
    return out


def random_texts():
    rng = random.Random(9)
    parts = ["token = \"", "password:", "API_KEY='", "apikey=", "secret", "passwd =", "short", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "é", " ", "  ", "=", "\"", "\n", "wJalrXUtnFEMIK7MDENGbPxRfiCYz9", "tokenaß", "𝔘", "aVeryOrdinaryIdentifierOfWords"]
    return [None, "", *["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(150)]]


def all_spans(text):
    model, order = secrets.model(), {k: i for i, k in enumerate(secrets.KINDS)}
    least = secrets.least_length(model)
    base = base_spans(text)
    apart = lambda found, others: [(a, b) for a, b in found if not any(a < e and c < b for c, e in others)]
    likely = lambda letters: [m.span() for m in re.finditer(f"{letters}{{{least},}}", text) if secrets.taken(model, m[0])]
    known = [x[1:] for x in base]
    runs = apart(likely(secrets.RUN), known)
    added = runs + apart(likely(secrets.PIECE), known + runs)
    return sorted(base + [("markov", *x) for x in added], key=lambda x: (x[1], order[x[0]]))


def test_base_spans_and_random_runs(spark):
    texts = random_texts() + ["client_credential_value=kJ8sPq2LmN0xYvTz/other/path", "kJ8sPq2LmN0xYvTz", "x" * 100_000, "a/" * 50_000 + "Zq7RtY2wXp9LbV"]
    schema = "doc_id bigint, text string, secrets int, kind int, s int, e int, hit int"
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0) for i, t in enumerate(texts)] * 2, schema)
    got = secrets.scan(df).orderBy("doc_id").collect()
    assert len(got) == 2 * len(texts) and secrets.scan(df.where("false")).count() == 0 and sorted(secrets.scan(df).columns) == sorted(df.columns)
    for r in got:
        assert [(x["kind"], x["start"], x["end"]) for x in r["secrets"]] == all_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]][:200]
    assert any(x["kind"] == "markov" for r in got if r["doc_id"] == len(texts) - 4 for x in r["secrets"])


def test_a_text_of_many_hits_takes_time_in_proportion(spark):
    import time

    rng = random.Random(3)
    one = lambda: "token: " + "".join(rng.choices("abcdef0123456789", k=8)) + " " + "".join(rng.choices(secrets.ALPHABET[:62], k=20)) + "\n"
    text = "".join(one() for _ in range(32_000))  # 1 MB of hits
    df = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    found = secrets.scan(df).select("secrets").first()[0]
    assert time.time() - began < 30
    assert sum(x["kind"] == "assign" for x in found) == 32_000 and sum(x["kind"] == "markov" for x in found) > 30_000
    assert all(a["start"] <= b["start"] for a, b in zip(found, found[1:]))


def test_model_tells_secrets_from_identifiers():
    yes, no = secrets.labelled_samples(1600, 1234)
    m = secrets.model()
    n = secrets.least_length(m)
    assert n <= 16
    yes, no = [x for x in yes if len(x) >= n], [x for x in no if len(x) >= n]
    assert sum(secrets.taken(m, x) for x in yes) >= 0.98 * len(yes)
    assert sum(secrets.taken(m, x) for x in no) <= 0.01 * len(no)
    ordinary = "internationalization Geschwindigkeitsbegrenzung photosynthesis CamelCaseIdentifierName x86_64-linux-gnu HTTPServerConnection 2024-01-15T12-30 4111111111111111 iPhone14ProMaxCase"
    assert not any(secrets.taken(m, x) for x in ordinary.split())


def other_secrets(rng, n):
    """Tokens of formats that the module's samples don't hold."""
    import base64
    import uuid

    alnum, digits = secrets.ALPHABET[:62], "0123456789"
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    base58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    return {
        "forty of base 64": [base64.b64encode(rng.randbytes(30)).decode() for _ in range(n)],
        "prefixed": [rng.choice(("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-")) + some(alnum, 30) for _ in range(n)],
        "token parts": ["eyJhbGciOiJIUzI1NiJ9-" + base64.urlsafe_b64encode(rng.randbytes(32)).decode().rstrip("=") for _ in range(n)],
        "upper hex": [rng.randbytes(16).hex().upper() for _ in range(n)],
        "base 58": [some(base58, 51) for _ in range(n)],
        "uuid": [str(uuid.UUID(bytes=rng.randbytes(16))) for _ in range(n)],
        "numbered": [f"{some(digits, 11)}-{some(alnum, 24)}" for _ in range(n)],
    }


def test_model_on_formats_and_names_outside_its_samples():
    import importlib
    import pkgutil
    import sys

    m = secrets.model()
    for kind, found in other_secrets(random.Random(77), 300).items():
        assert sum(secrets.taken(m, x) for x in found) >= 0.85 * len(found), kind
    names = set()
    for x in pkgutil.iter_modules():  # what the standard library calls things
        if x.name in sys.stdlib_module_names and not x.name.startswith(("_", "this", "antigravity", "idlelib", "turtle", "tkinter", "test")):
            try:
                module = importlib.import_module(x.name)
            except ImportError:
                continue
            names |= {n for n in dir(module) if len(n) >= secrets.least_length(m)}
            names |= {n for c in vars(module).values() if isinstance(c, type) for n in dir(c) if len(n) >= secrets.least_length(m)}
    wrong = [n for n in names if secrets.taken(m, n)]
    assert len(names) > 1000 and len(wrong) <= 0.01 * len(names), wrong


def test_digest_of_no_spans(spark, tiny):
    r = QUERIES["op2_secrets"](spark, tiny).where("spans = ''").first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == (0, 0, 0)


URLS = {
    "https://a.com/en/x": ("a.com", "/en/x", "com/en/", "block"), "https://EXAMPLE.com/en/77?q": ("example.com", "/en/77", "example.com/en/7", "allow"), "http://x.example.com/en/6": ("x.example.com", "/en/6", "com/en/", "block"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "http://net/de/": ("net", "/de/", "net/de/", "allow"), "http://example.net/de/8#x": ("example.net", "/de/8", "example.net/de/8", "block"),
    "http://example.net/DE/8": ("example.net", "/DE/8", None, "allow"), "http://b.org/es/1": ("b.org", "/es/1", "org/es/", "block"), "ftp://h?x/y": ("h", "", None, "allow"), "http://a://b/c": ("a:", "//b/c", None, "allow"),
    "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://\n.org/es/1": ("\n.org", "/es/1", "org/es/", "block"), "http://orgx/es/": ("orgx", "/es/", None, "allow"),
}


def test_url_rules(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS)] + [(99, None, "old")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, url_verdict string")).collect()}
    for i, (u, want) in enumerate(URLS.items()):
        v = got[i]["url_verdict"]
        assert (v["host"], v["path"], v["rule"]) == want[:3], u
        assert want[2] is None or v["verdict"] == want[3], u
    assert tuple(got[99]["url_verdict"]) == ("", "", None, "allow")


#: Well-known ordinary sites that are in no list of the module.
ORDINARY = """www.mayoclinic.org weather.gov www.khanacademy.org imdb.com/title/tt0111161/ www.tripadvisor.com/Hotels duckduckgo.com/?q=tea www.ikea.com/se/sv/ www.lego.com craigslist.org
medium.com/@someone/a-story-of-tea-0a1b2c quora.com/What-is-tea www.allrecipes.com/recipe/10813/best-chocolate-chip-cookies/ www.goodreads.com/book/show/2657 etsy.com/listing/123 zoom.us dropbox.com
www.cnn.com/2021/05/03/world/story/index.html npr.org cnbc.com bloomberg.com ft.com lefigaro.fr liberation.fr sueddeutsche.de tagesschau.de heise.de elmundo.es lavanguardia.com repubblica.it
nih.gov cdc.gov who.int europa.eu un.org loc.gov usgs.gov epa.gov census.gov gov.uk/browse/benefits nhs.uk mit.edu columbia.edu yale.edu ucl.ac.uk imperial.ac.uk kcl.ac.uk
perl.org php.net ruby-lang.org haskell.org scala-lang.org kotlinlang.org openjdk.org gnu.org fsf.org eff.org w3.org ietf.org iso.org ieee.org acm.org aps.org rsc.org plos.org
nytimes.com/crosswords chess.com lichess.org boardgamegeek.com ravelry.com instructables.com hackaday.com makezine.com digikey.com mouser.com sparknotes.com cliffsnotes.com
www.penisland.example scunthorpe.example www.python.org adafruit.com www.essex.ac.uk/about www.amazon.de/gp/product/0000 en.wikipedia.org/wiki/Casino""".split()


def test_url_model():
    m = url_filter.model()
    folded = lambda x: re.sub("[0-9]", "0", x.lower())
    blocked = lambda x: m.score(folded(x)) >= max(m.threshold * len(x), url_filter.MIN_SCORE)
    yes, no = url_filter.labelled_urls(1000, 77)
    assert sum(map(blocked, yes)) >= 0.4 * len(yes) and sum(map(blocked, no)) <= 0.005 * len(no)
    assert [x for x in ORDINARY if blocked(x)] == []


def test_no_word_of_the_lists_names_a_host_of_the_tables():
    import duckdb

    urls = [r[0] for r in duckdb.execute("select url from '/root/testdata/sf0.1/pages.parquet' where url is not null").fetchall()]
    names = {w for u in urls for w in re.split("[.-]", re.sub("^.*?://|[/?#].*", "", u))} - {"www", "m", "blog", "example", "com", "org", "net"}
    assert names and not names & {*url_filter._REJECTED, *url_filter._SITES, *url_filter._WORDS}


def test_a_ratio_learned_from_a_table(spark):
    rng = random.Random(4)
    yes, no = url_filter.labelled_urls(900, 5)
    rows = [(f"https://{u}", kind) for us, kind in ((yes, True), (no, False)) for u in us[:700]]
    rows += [rows[0]] * 500 + [(None, True), ("http://x", None), ("", False)]
    rng.shuffle(rows)
    ratio = url_filter.learn(spark.createDataFrame(rows, "url string, rejected boolean"), sample=650)
    held = [(i, f"http://{u}") for i, u in enumerate(yes[700:] + no[700:])]
    got = url_filter.judge(spark.createDataFrame(held, "page_id bigint, url string"), rules=(), ratio=ratio).collect()
    blocked = {r["page_id"] for r in got if r["url_verdict"]["verdict"] == "block"}
    assert len([i for i in blocked if i < 200]) >= 80 and len([i for i in blocked if i >= 200]) <= 2
    with pytest.raises(ValueError):
        url_filter.learn(spark.createDataFrame([("http://x", True)], "url string, rejected boolean"))


def test_odd_urls(spark):
    urls = [None, "", "no scheme at all", "http://" + "a" * 1_000_000 + ".org/es/", "http://h/" + "x/" * 200_000, "http://b.org/es/1", "http://b.org/es/1"]
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, verdict string")
    got = [tuple(r["url_verdict"]) for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == ("", "", None, "allow") and got[2][:3] == ("", "", None)
    assert got[3][2:] == ("org/es/", "block") and got[4][2] is None and got[5] == got[6] == ("b.org", "/es/1", "org/es/", "block")
    assert url_filter.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op2_secrets", "op6_quality_rules", "op10_url_filter"])
def test_plans_hold_no_python(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
