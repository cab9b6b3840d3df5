"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams of both.

All of it is DataFrame expressions: n-grams are hashed inside the row, so judging is one narrow pass without a shuffle,
whatever the number of urls of a host. Training reads only the small labelled table (a local relation); each gradient
step is one job over it, and only the dims-sized weights live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_BAD = (
    "royal-casino.test casino-royal.example.org bigcasino.test online-casino.example bets-today.example.org sportbets.example.org best-bets.test "
    "betting-tips.example discount-pills.test buy-pills.example.org pills-online.test viagra-shop.example adult-x.example.com adult-cams.example.org "
    "xxx-videos.test porn-tube.example freeporn.example.org sexy-chat.test ads-network.example.org adserver.example.org track-clicks.test click-ads.example "
    "popup-ads.example.net banner-ads.example tracker.example.org payday-loan.example.com quick-loans.example.org easy-loan.test replica-watch.example "
    "cheap-watches.example.org warez-zone.example.com keygen-crack.example.org torrent-free.test cracked-apps.example poker-win.example.net slots-jackpot.example "
    "win-prize.example.com free-money.example.org get-rich-fast.test crypto-giveaway.example lottery-win.example.org miracle-diet.example.com weight-loss-pills.test "
    "spam-links.example link-farm.example.org seo-backlinks.test hot-singles.example escort-girls.example.org dating-adult.test casino.example.net bets.example.net"
).split()
_GOOD = (
    "www.library.example.org news.example.com blog.example.org docs.example.net university.example.edu museum.example.org weather.example.com science.example.net "
    "recipes.example.org gardening.example.com history.example.net travel.example.org m.gazette.example.com north-coast.example.org stories.example.net "
    "village-news.example.com www.teaching.example.org reading.example.net writing.example.com nation.example.org station.example.com m.edition.example.net "
    "blog.creation.example.org school.example.edu parliament.example.org hospital.example.net health.example.org music.example.com theatre.example.net "
    "the-river.example.org mountain.example.com ocean.example.net forum.example.org wiki.example.net archive.example.org software.example.com python.example.org "
    "math.example.net physics.example.org chemistry.example.com biology.example.net economics.example.org law.example.com city-council.example.net "
    "football-club.example.org chess.example.net painting.example.com poetry.example.org philosophy.example.net language.example.com crafts.example.org opera.example.net"
).split()
_TAILS = ("/", "/en/1234", "/de/77.html", "/fr/901/", "/es/5310?page=2&ref=x", "/index.html#top", "")
#: (url, 1 for block): hosts from everyday spam and everyday reading, each under two of the tails, which so carry no label.
LABELLED_URLS = tuple(
    (f"http{'s' * (i % 2)}://{host}{_TAILS[(i + k) % len(_TAILS)]}", y)
    for hosts, y in ((_BAD, 1), (_GOOD, 0)) for i, host in enumerate(hosts) for k in (0, 3)
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host_: Column, path_: Column, dims: int) -> Column:
    """Hashed character n-grams (3 and 4 of the host between ^ and $, 3 of the path), kept apart by part and length."""

    def of(text: Column, part: str, n: int) -> Column:
        # the signs are split once, so that a gram costs the same wherever in the text it is
        gram = lambda signs, i: F.concat(*[F.get(signs, i + k) for k in range(n)])
        at = lambda signs: F.transform(F.sequence(F.lit(0), F.size(signs) - n), lambda i: F.pmod(F.xxhash64(F.lit(f"{part}{n}"), gram(signs, i)), F.lit(dims)).cast("int"))
        each = F.get(F.transform(F.array(F.split(text, "")), at), F.lit(0))
        return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<int>"))

    shown = F.concat(F.lit("^"), host_, F.lit("$"))
    return F.concat(of(shown, "h", 3), of(shown, "h", 4), of(path_, "p", 3))


def _probability(found: Column, weights: list[float]) -> Column:
    table_ = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.get(table_, g))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + F.lit(weights[-1]))))


def train(spark: SparkSession, labelled: DataFrame | None = None, dims: int = 4096, steps: int = 30, rate: float = 0.5, l2: float = 1e-4) -> list[float]:
    """dims weights and a bias, by adaptive gradient steps on the whole labelled table (url, label), which must be small.

    Rows with a null url or label take no part; an empty table leaves all weights 0, which blocks nothing.
    """
    if labelled is None:
        labelled = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in LABELLED_URLS) + " AS t(url, label)")
    rows = labelled.where("url is not null and label in (0, 1)").select(grams(host(F.col("url")), path(F.col("url")), dims).alias("g"), F.col("label").cast("double").alias("y")).coalesce(1)
    weights, seen = [0.0] * (dims + 1), [1e-8] * (dims + 1)
    for _ in range(steps):
        wrong = rows.select("g", (F.col("y") - _probability(F.col("g"), weights)).alias("r"))
        found = wrong.select(F.explode(F.concat("g", F.array(F.lit(dims)))).alias("k"), "r", F.sqrt(F.greatest(F.size("g"), F.lit(1))).alias("n"))  # the bias counts as one more gram
        up = found.groupBy("k").agg(F.sum(F.when(F.col("k") == dims, F.col("r")).otherwise(F.col("r") / F.col("n"))).alias("up"))
        for k, x in up.collect():  # dims + 1 rows at most
            x -= l2 * weights[k]
            seen[k] += x * x
            weights[k] += rate * x / math.sqrt(seen[k])
    return weights


def judge(pages: DataFrame, weights: list[float], rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of each row.

    The longest rule that fits decides (ties: the longer host, then the smaller text); without one, the model's
    probability does. Null and malformed urls have empty host and path, so no evidence: they get the bias's verdict.
    Repeated rows are judged alike, and columns other than page_id and url are not read.
    """
    df = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule = (F if rule is None else rule).when(fits, text)
        verdict = (F if verdict is None else verdict).when(fits, action)
    dims = len(weights) - 1
    df = df.withColumn("p_block", _probability(grams(F.col("host"), F.col("path"), dims), weights))
    model = F.when(F.col("p_block") > threshold, "block").otherwise("allow")
    return df.select("page_id", "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), (verdict.otherwise(model) if verdict is not None else model).alias("verdict"), "p_block")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(spark))
