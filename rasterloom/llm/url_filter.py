"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted with Spark ML on the small labelled table below; scoring is a chain of column expressions and the
fitted model's transform. Rules are a handful of rows, compared as column expressions.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, rule): a host and its subdomains, and how the path starts.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES, GRAMS = 1 << 14, (3, 4, 5)

#: The labelled URLs follow a rule, not a list of hosts: a topic word stands alone or beside a filler word in a host or a path.
BLOCKED = "casino poker slots bets betting wager jackpot lottery roulette pills viagra pharma meds steroids spam linkfarm ads adserver adclick banner tracker tracking popunder clickbait freemoney moneyfast payday loans replica knockoff keygen warez cracked phishing malware spyware adult xxx camgirls escorts".split()
ALLOWED = "news daily blog wiki docs manual library museum science history garden recipes weather sports travel school university research journal health city council music film books art forum photos maps code data help about nature ocean theatre market kitchen therapy thinking nation station ontario reading window wing trackrecord farmhouse freedom cheapside".split()
#: Words beside topics of either label, so that they tell nothing.
FILLERS = "my the top best new online super mega real easy win free cheap farm club world home portal zone hub net24".split()
#: The commonest letter pairs of English make names without a meaning, which are to be allowed.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split()
NAMELESS = 400
#: Host patterns and paths: the same for both labels.
PLACES = (("www.{}.example.com", "/en/12"), ("{}.example.org", "/de/340.html"), ("blog.{}.example.net", "/fr/7/"), ("m.{}.example.com", "/es/99"), ("{}.com", "/index.html"))
#: The same with the words in the path of a neutral host.
PATHS = (("www.example.com", "/en/{}/12"), ("example.org", "/{}"), ("blog.example.net", "/fr/7/{}.html"), ("m.example.com", "/{}/index.html"), ("shop.com", "/de/{}/99"))
#: Paths that only one label has.
OWN_PATHS = {True: ("/go/aff/{}", "/click/out/{}.php", "/promo/{}/bonus"), False: ("/articles/2021/{}.html", "/guide/{}/intro", "/archive/{}/notes")}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or where there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        of, start = text.split("/", 1)
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ^host$ and of the path, marked by which they come from."""
    def of(text: Column, mark: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    return F.concat(*[of(host, "h", n) for n in GRAMS], *[of(path, "p", n) for n in GRAMS])


def labelled(spark: SparkSession) -> DataFrame:
    """(host, path, label): label 1 is to be blocked. Each topic word is in hosts and in paths, alone, before and after fillers that take turns; a blocked word in a path is on hosts of allowed words too; names without a meaning are allowed."""
    rows = []
    for bad, words in ((True, BLOCKED), (False, ALLOWED)):
        for i, w in enumerate(words):
            forms = [w, f"{w}-{FILLERS[i % len(FILLERS)]}", f"{FILLERS[(i + 7) % len(FILLERS)]}-{w}", f"{FILLERS[(i + 13) % len(FILLERS)]}{w}"]
            for k, form in enumerate(forms):
                at = [(host.format(form), path) for host, path in PLACES[k % 2 :: 2]] + [(host, path.format(form)) for host, path in PATHS[k % 2 :: 2]]
                at.append((f"{ALLOWED[(i + 7 * k) % len(ALLOWED)]}.example.org", OWN_PATHS[bad][k % 3].format(form)))
                rows += [(host, path, float(bad)) for host, path in at]
    for i in range(NAMELESS):
        name = "".join(PAIRS[(i * step + i // 40 * k) % len(PAIRS)] for k, step in enumerate((1, 7, 11, 17)[: 2 + i % 3]))
        rows += [(host.format(name), path, 0.0) for host, path in (PLACES[i % 5], (PATHS[i % 5][0], PATHS[i % 5][1].format(name)))]
    return spark.createDataFrame(rows, "host string, path string, label double").coalesce(1)


def hashed(df: DataFrame, features: int = FEATURES) -> DataFrame:
    return HashingTF(numFeatures=features, binary=True, inputCol="_grams", outputCol="_features").transform(df.withColumn("_grams", grams(F.col("host"), F.col("path")))).drop("_grams")


def fit(labels: DataFrame, features: int = FEATURES) -> LogisticRegressionModel:
    """Fits the model to a small table (host, path, label)."""
    rows = hashed(labels, features).cache()
    model = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=40, regParam=0.02, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_predicted").fit(rows)
    rows.unpersist()
    return model


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: tuple[tuple[str, str], ...] = RULES, features: int = FEATURES) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) for each row of pages(page_id, url).

    Null urls and urls without :// have empty host and path, fit no rule and are judged by the model. Rows that repeat
    are judged alike; very long urls are judged whole; a probability of just 0.5 is block, and of rules of one length, which
    can't both fit a host, the later. Other columns are ignored; an empty table gives none. probability: of block, by
    the model.
    """
    host, path = host_and_path(F.col("url"))
    scored = model.transform(hashed(pages.select("page_id", host.alias("host"), path.alias("path")), features))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = vector_to_array("_p")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("probability"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: a verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages"), fit(labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "probability")
