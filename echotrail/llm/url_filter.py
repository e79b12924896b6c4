"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model learns from a small labelled table of URLs (columns url and label, 1 = block); the table here holds made-up
names under reserved domains and can be replaced by a caller's. Character n-grams of 3 to 5 of the host, marked at both
ends, and of the path's words are hashed into a fixed number of buckets. Everything is DataFrame work: the pages are
read once, without a shuffle, and only the URL column of theirs.

Null URLs and those without `://` have an empty host and path; no rule fits them and the model judges the bare ends.
Repeated rows get equal verdicts. An empty training table allows everything that no rule blocks. Of two rules of equal
length the first in the list counts. Other columns are passed through.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.llm.common import ascii_lower, let

#: (verdict, host, path) of the rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]
BUCKETS, SIZES, THRESHOLD = 1 << 18, (3, 4, 5), 0.25

BLOCKED = """casino-royal.test/play poker-win.test/table online-casino.test/en/bonus casinoslots.test/slots win-big.test/jackpot
free-bets.test/bet betting-tips.test/odds sports-bets.test/live bets24.test/en/12 free-casino.test/en/88 winner-casino.test/win
cheap-pills.test/buy pills-online.test/order pharmacy-cheap.test/pills viagra-pills.test/en/5 cheap-meds.test/en/31 buy-pills.test/en/9
adult-videos.test/watch adult-cams.test/live xxx-adult.test/en/17 adult-x.test/fr/2 porn-tube.test/xxx sex-chat.test/adult
ads-server.test/ads ads-track.test/pixel adtrack.test/track click-ads.test/click track-ads.test/en/404 popup-ads.test/banner
spam-links.test/links spam-farm.test/en/7 link-farm.test/spam seo-spam.test/en/63 spamfarm.test/es/4 farm-links.test/de/90
free-money.test/cash get-rich.test/money payday-loans.test/loan cheap-loans.test/apply free-gifts.test/win lottery-win.test/claim
warez-free.test/crack torrent-free.test/warez crack-keys.test/keygen cheap-replica.test/watches replica-bags.test/cheap""".split()
ALLOWED = """city-library.test/en/books museum.test/visit garden.test/en/12 weather.test/today science-news.test/en/451
recipes.test/soup school.test/fr/classes university.test/en/courses history.test/es/2 travel.test/de/71 docs.tools.test/guide
music.test/en/8 art-gallery.test/en/33 forum.cycling.test/thread football.test/en/120 theatre.test/fr/66 nature.test/en/17
cooking.test/es/5 maps.test/route translate.test/de/9 photos.test/album wiki.test/en/page math.test/lesson chess.test/en/63
thinking.test/en/88 thread.test/en/31 nation.test/en/4 tion.test/fr/404 theory.test/en/90 other.test/es/7 ther.test/en/2
thing.test/en/55 hearing.test/de/23 station.test/en/619 thesis.test/fr/148 shoes.test/en/71 rivers.test/en/176 trees.test/es/8
ocean.test/en/680 teaching.test/en/853 physics.test/en/960 health.test/en/474 hospital.test/de/612 kids.test/en/328
gov-info.test/en/334 parliament.test/fr/65 bank-holidays.test/en/217 open-data.test/en/762 research.test/es/785 parks.test/en/922
writing.test/en/414 reading.test/fr/25 farming-history.test/en/40 trackandfield.test/en/18 winter.test/en/77 bettina.test/de/3""".split()
#: Dealt in turn to both lists, so that none of them tells a class.
NEUTRAL = ("en/12", "", "fr/5", "es/31/", "index.html", "de/404", "en/88.html")
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), (".example.com/", ".example.net/", ".example.org/", ".test/", ".example.com/")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule); null if none does."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    choice = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, start in reversed(ranked):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        choice = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(choice)
    return choice


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host and of the path, each marked with where it stands."""
    def of(text: Column, mark: str) -> Column:
        return F.concat(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
                                      lambda k, n=n: F.concat(F.lit(mark), F.substr(text, k, F.lit(n)))) for n in SIZES])

    return F.concat(let(F.concat(F.lit("^"), host, F.lit("$")), lambda t: of(t, "h")),
                    let(F.concat(F.lower(F.regexp_replace(path, "[0-9]+", "0")), F.lit("$")), lambda t: of(t, "p")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table of this module."""
    whole = []
    for label, urls in ((1, BLOCKED), (0, ALLOWED)):
        for k, u in enumerate(urls):
            host, path = u.split(".test/")
            for j, path in enumerate([path, NEUTRAL[k % len(NEUTRAL)], NEUTRAL[(k + 3) % len(NEUTRAL)]]):
                whole.append((f"http://{PREFIXES[(k + j) % len(PREFIXES)]}{host}{SUFFIXES[(k + j) % len(SUFFIXES)]}{path}", label))
    rows = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for u, label in whole]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def hashed(frame: DataFrame) -> DataFrame:
    """Adds the vector __features of hashed n-grams of __host and __path."""
    table = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features")
    return table.transform(frame.withColumn("__grams", grams(F.col("__host"), F.col("__path")))).drop("__grams")


def fit(labelled: DataFrame):
    """A model of block probability, or None without both labels."""
    host, path = host_path(F.col("url"))
    rows = hashed(labelled.where("label is not null").select(host.alias("__host"), path.alias("__path"), F.col("label").cast("double").alias("label")))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.002, maxIter=100, predictionCol="__predicted",
                              probabilityCol="__chance", rawPredictionCol="__raw").fit(rows)


def judge(pages: DataFrame, model, keep: list[str], rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns with host, path, rule, score (block probability) and verdict."""
    host, path = host_path(F.col("url"))
    rows = hashed(pages.select(*keep, host.alias("__host"), path.alias("__path")))
    scored = rows.withColumn("__score", F.lit(0.0)) if model is None else model.transform(rows).withColumn(
        "__score", F.element_at(vector_to_array("__chance"), 2))
    return (scored.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
            .select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
                    F.col("__score").alias("score"),
                    F.coalesce("__rule.verdict", F.when(F.col("__score") >= threshold, "block").otherwise("allow")).alias("verdict")))
