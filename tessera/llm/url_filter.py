"""URL filter: host and path rules, and for other URLs a ratio of character language models.

One projection of built-in functions over the URL column; nothing is shuffled, and the rules and the model
table that go with the plan don't grow with the data.
"""

from __future__ import annotations

import random
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let
from .markov import Ratio, fit

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/_?=&%"
ORDER = 2
#: An address must also be e ** 20 times likelier as a rejected one (thousandths of a nat): the mean over a short
#: address varies more than that over the long ones that calibrate the threshold.
MIN_SCORE = 20_000

# Two general lists: what blocklists by category hold, and names and words of ordinary sites. No word is taken from the
# hosts of the synthetic tables, so what the models make of those is a held-out figure.
_REJECTED = (
    "roulette blackjack baccarat jackpot lottery bingo poker wager gambler gambling bookmaker sportsbook slotmachine highroller "
    "viagra cialis levitra xanax tramadol valium steroids weightloss painkiller nootropic enlargement erectile hairloss "
    "porn xxx nude naked erotic fetish escorts milf webcamgirls hentai hotgirls sexchat hookup swingers lingerie "
    "payday loans lender refinance debtrelief quickcash getrich millionaire forex binaryoptions bitcoin cryptodoubler moneymaker "
    "warez torrents crack keygen serials nulled cracked hacked cheats aimbot freebies coupons giveaway sweepstakes "
    "replica rolex louisvuitton handbags knockoff sneakers discount clearance outlet wholesale dropship "
    "backlinks linkbuilding seoboost followers likes traffic clickbait popunder adserver doubleclick banner tracker pixel affiliate "
    "phishing malware spyware scareware ransom botnet trojan keylogger paypalverify accountlogin passwordreset bankverify "
    "horoscope psychic fortune miracle detox belly abs singles mailorder brides"
).split()
_SITES = (
    "wikipedia wikimedia wiktionary archive gutenberg britannica nature science springer elsevier jstor arxiv nasa noaa "
    "bbc reuters guardian nytimes washingtonpost lemonde spiegel zeit faz elpais corriere asahi aljazeera economist "
    "github gitlab stackoverflow debian ubuntu fedora gentoo freebsd kernel apache mozilla eclipse python rust golang nodejs postgresql sqlite "
    "google microsoft apple ibm intel oracle adobe amazon ebay paypal netflix spotify youtube twitter linkedin reddit pinterest flickr tumblr "
    "oxford cambridge harvard stanford princeton berkeley ethz heidelberg sorbonne tsinghua uchicago essex sussex middlesex wessex "
    "adafruit arduino raspberrypi sparkfun analog expertsexchange therapist documenta titan circus massachusetts "
    "smithsonian louvre rijksmuseum tate moma metmuseum royalsociety redcross unesco unicef oecd worldbank who imf"
).split()
_WORDS = (
    "news blog history library museum school college university research journal garden kitchen travel weather city council river "
    "mountain forest music theatre cinema doctor hospital clinic nurse health food recipe bread cheese coffee wine house street market "
    "station bridge winter summer morning evening paper writer reader teacher student course lesson exam software hardware engine "
    "physics chemistry biology planet ocean island harbour village country people culture language grammar poetry novel story chapter "
    "author editor press radio film photo camera painting drawing craft knitting running cycling football cricket tennis chess puzzle "
    "family children parents friends community church open source code data project tools forum help support about contact "
    "parliament justice law police fire rail bus airport hotel insurance bank pension energy solar water recycling farmer wildlife birds "
    "dogs horses maps guide review shop books print fashion shoes watch analysis class basic adapter textile cocktail assembly expert"
).split()


def labelled_urls(n: int = 2400, seed: int = 11, part: int | None = None) -> tuple[list[str], list[str]]:
    """``n`` rejected and ``n`` accepted addresses, by turns from the even and the odd words of the lists, or from those
    of one ``part`` only. Both kinds get the same subdomains, domains, paths and parameters, and differ in their words."""
    rng = random.Random(seed)
    subdomains = ("", "", "", "www.", "www.", "m.", "blog.", "docs.", "en.", "shop.", "news.", "static.", "forum.", "mail.", "cdn0.")
    domains = "com com com com org org net net edu gov io info co.uk ac.uk de fr es it nl eu ca com.au co.jp tv me dev app biz".split()
    path_words = "index article page post item about archive category tag search product view topic wiki docs download user images static feed".split()

    def address(names: list[str], words: list[str]) -> str:
        name = rng.choice(("", "", "-")).join(rng.sample(names, rng.choice((1, 1, 2))))
        word = lambda: rng.choice((rng.choice(words), rng.choice(path_words)))
        number = lambda: "0" * rng.randint(1, 6)
        path = "".join("/" + rng.choice((word, word, number, lambda: f"{word()}-{word()}", lambda: f"{word()}_{number()}"))() for _ in range(rng.randint(0, 4)))
        path += rng.choice(("", "", "/", ".html", ".php", ".htm"))
        query = rng.choice(("", "", "", f"?id={number()}", f"?page={number()}&sort={rng.choice(path_words)}", f"?q={rng.choice(words)}", "?utm_source=" + rng.choice(path_words), f"?lang=en&ref={number()}"))
        return rng.choice(subdomains) + name + "." + rng.choice(domains) + path + query

    def one(k: int, rejected: bool) -> str:
        half = k % 2 if part is None else part
        if rejected:
            return address(_REJECTED[half::2], _REJECTED[half::2])
        sites, words = _SITES[half::2], _WORDS[half::2]
        return address(sites if k % 3 == 0 else words, words)

    return [one(k, True) for k in range(n)], [one(k, False) for k in range(n)]


@cache
def model() -> Ratio:
    """The default ratio: calibrated on addresses whose words the calibrated models have not seen, where a false block
    costs as much as 30 missed ones, and then trained on all."""
    return fit(*labelled_urls(), ALPHABET, ORDER, cost=30)


def learn(labelled: DataFrame, url: str = "url", rejected: str = "rejected", sample: int = 4000, cost: int = 30) -> Ratio:
    """The ratio of a table of URLs with a boolean ``rejected``: at most ``sample`` different addresses of each kind, those
    of the least hash; half of them calibrate the threshold. Rows that lack either column are passed over, and an address
    with both labels counts as both. Tables without both kinds are an error."""
    shown = address_of(F.col(f"`{url}`"))
    rows = labelled.select(F.regexp_replace(ascii_lower(shown), "[0-9]", "0").alias("address"), F.col(f"`{rejected}`").alias("rejected")).where("address <> '' and rejected is not null")

    def some(kind: bool) -> list[str]:
        found = rows.where(F.col("rejected") == kind).select("address").distinct()
        return [r["address"] for r in found.orderBy(F.xxhash64("address"), "address").limit(sample).collect()]

    yes, no = some(True), some(False)
    if min(len(yes), len(no)) < 2:
        raise ValueError("the ratio needs rejected and accepted URLs")
    return fit(yes, no, ALPHABET, ORDER, cost)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What follows the first ://, or all of it."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")


def _ordered(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def judge(pages: DataFrame, url: str = "url", into: str = "url_verdict", rules=RULES, ratio: Ratio | None = None) -> DataFrame:
    """``pages`` with a struct ``into`` (replaced if there): host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with its path; the longest rule wins, and the
    rule's text is host and path. Without a rule the models decide: the address (the whole URL after the scheme,
    all of it if there is none; lower case, digits as 0) is blocked if its log-likelihood ratio reaches the calibrated
    threshold a character. A null or empty URL has no address and is allowed; one without :// has an empty host and
    path and no rule. Very long URLs are scored whole; repeated rows are judged each; an empty table gives an empty
    result; other columns, whatever their names, pass through.
    """
    ratio = ratio or model()
    col = F.col(f"`{url}`")
    parts = pages.withColumn(into, F.struct(host_of(col).alias("host"), path_of(col).alias("path")))
    host, path = F.col(f"`{into}`")["host"], F.col(f"`{into}`")["path"]
    rule, verdict = F.lit(None).cast("string"), None
    for kind, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)) if verdict is None else F.when(fits, F.lit(kind)).otherwise(verdict)
    address = F.regexp_replace(ascii_lower(address_of(col)), "[0-9]", "0")
    taken = lambda a: let(ratio.column(a), lambda x: (x >= ratio.threshold * F.length(a)) & (x >= MIN_SCORE))
    guess = let(address, lambda a: F.when((a != "") & taken(a), "block").otherwise("allow"))
    verdict = guess if verdict is None else F.coalesce(verdict, guess)
    return parts.withColumn(into, F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict")))


def sql(table: str = "pages", rules=RULES, ratio: Ratio | None = None) -> str:
    ratio = ratio or model()
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", k, h + p) for k, h, p in _ordered(rules)]
    by_rule = " ".join(f"when {f} then '{name}'" for f, _, name in fits)
    by_kind = " ".join(f"when {f} then '{k}'" for f, k, _ in fits)
    return f"""
    with parts as (
      select page_id, coalesce(url, '') as url,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from {table}),
    named as (select *, translate(regexp_replace(regexp_replace(url, '(?s)^.*?://', ''), '[0-9]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as address from parts),
    scored as (select *, {ratio.sql("address")} as score from named)
    select page_id, host, path, case {by_rule} end as rule,
           case {by_kind} when address <> '' and score >= {ratio.threshold} * length(address) and score >= {MIN_SCORE} then 'block' else 'allow' end as verdict
    from scored"""
