"""URL filter: longest host / path rule, else logistic regression on hashed character n-grams (operator 8).

The classifier is fitted on a small labelled table of URLs (a parameter, at most
``MAX_LABELLED_URLS`` rows; the query's is made of 40 unwanted and 40 ordinary words, ten addresses each): host and path are cut into character n-grams, hashed into a fixed
number of features, and weighed by logistic regression.  Only its weights go to the scoring job.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is
scored on no n-grams (the model's intercept decides).  Repeated rows are scored alike; other
columns are kept.  Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_FEATURES = 1 << 14
NGRAM_SIZES = (3, 4, 5)
MAX_LABELLED_URLS = 10_000

#: (host, path, verdict): the rules of the query's contract (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

# What the labelled table is made of.  Words of unwanted sites ...
UNWANTED_WORDS = [
    "casino", "slots", "jackpot", "poker", "roulette", "blackjack", "bets", "betting", "lottery", "bingo",
    "porn", "xxx", "adult", "sexcam", "nude", "escort", "milf", "hookup", "camgirl", "fetish",
    "viagra", "cialis", "pills", "steroids", "slimming", "malware", "phish", "keygen", "warez", "crack",
    "payday", "loans", "forex", "giveaway", "prizes", "clickbait", "spam", "backlinks", "replica", "doubler"]
#: ... of ordinary ones, some of them near the others in spelling ...
ORDINARY_WORDS = [
    "news", "library", "garden", "weather", "university", "museum", "cooking", "travel", "history", "science",
    "council", "music", "bookshop", "forum", "software", "school", "hospital", "parliament", "orchestra", "railway",
    "festival", "farmers", "chess", "astronomy", "cycling", "pottery", "geology", "theatre", "harbour", "village",
    "essex", "adulthood", "pilgrims", "slotcar", "bettina", "spamalot", "crackers", "loanword", "casinghead", "nudibranch"]
#: ... and words that either kind uses.
COMMON_WORDS = ["best", "online", "my", "the", "city", "daily", "world", "club", "free", "home", "shop", "blog", "net", "live", "top"]
_ENDS = ["example", "example.com", "example.net", "example.org"]
_FRONTS = ["", "www.", "m.", "blog."]
_PATHS = ["/{a}", "/en/{n}", "/{a}/{c}?page={n}", "/de/{n}.html", "/{c}/{a}-{n}/", "/", "/fr/{n}/", "/{c}?id={n}&ref=x", "/es/{n}#top", "/{a}/{n}"]
#: Addresses for each word, and one word in so many is held out when accuracy is measured.
PER_WORD, HELD_OUT = 10, 5


def made_urls() -> list[tuple[str, float]]:
    """The labelled table: for each word ``PER_WORD`` addresses, label 1 for those of unwanted words.  Ends, fronts,
    paths and common words go round alike for both kinds, so only the words tell them apart."""
    out = []
    for words, label in ((UNWANTED_WORDS, 1.0), (ORDINARY_WORDS, 0.0)):
        for i, word in enumerate(words):
            for j in range(PER_WORD):
                common, n = COMMON_WORDS[(i + 4 * j) % len(COMMON_WORDS)], (i * 131 + j * 37) % 1000
                name = (f"{word}-{common}", f"{common}{word}", word, f"{common}-{word}", f"{word}{common}")[(i + j) % 5]
                host = _FRONTS[(i + j) % 4] + name + "." + _ENDS[(i + j // 4) % 4]
                path = _PATHS[(i + j) % len(_PATHS)].format(a=word, c=common, n=n)
                out.append((f"http{'s' * ((i + j) % 2)}://{host}{path}", label))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(made_urls(), "url string, label double")


def split_held_out(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labelled rows to fit on, and those held out (one in ``HELD_OUT`` by crc32 of the address)."""
    out = F.coalesce(F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0, F.lit(False))
    return labelled.where(~out), labelled.where(out)


def accuracy(model, labelled: DataFrame) -> DataFrame:
    """One row: rows, right, missed (label 1 allowed) and wrongly blocked, of labelled rows judged without rules."""
    judged = judge(labelled.select("url", "label"), model, rules=[])
    blocked = F.col("verdict") == "block"
    bad = F.col("label") == 1.0
    return judged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(blocked == bad).alias("right"),
                      F.count_if(bad & ~blocked).alias("missed"), F.count_if(~bad & blocked).alias("wrongly_blocked"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``host || path`` text) and its verdict; null if none fits."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def char_ngrams(text: Column, sizes=NGRAM_SIZES) -> Column:
    """The distinct character n-grams of a text.  It is cut into characters once and grams are joined from neighbours by
    index, so a long text takes linear time whatever its script."""
    def grams(chars: Column) -> Column:
        def of(k: int) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(chars) - k, F.lit(0)))
            joined = F.transform(places, lambda i: F.concat(*[F.get(chars, i + d) for d in range(k)]))
            return F.when(F.size(chars) >= k, joined).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of(k) for k in sizes])

    # bound to a variable: the text is split once
    cut = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.array_distinct(F.get(F.transform(F.array(cut), grams), F.lit(0)))


def _features(df: DataFrame, host: Column, path: Column) -> DataFrame:
    # host grams keep their borders; path grams are marked so that they count apart
    host_text = F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise(F.lit(""))
    path_grams = F.transform(char_ngrams(path), lambda g: F.concat(F.lit("/:"), g))
    return df.withColumn("__grams", F.concat(char_ngrams(host_text), path_grams))


def fit(labelled: DataFrame, reg: float = 0.01):
    """Fit on the labelled table (columns url, label)."""
    n = labelled.limit(MAX_LABELLED_URLS + 1).count()
    if n > MAX_LABELLED_URLS:
        raise ValueError(f"the labelled table may have {MAX_LABELLED_URLS} rows at most")
    url = F.col("url")
    rows = _features(labelled.coalesce(1), host_of(url), path_of(url)).select("label", "__grams").cache()
    model = Pipeline(stages=[
        HashingTF(inputCol="__grams", outputCol="__features", numFeatures=N_FEATURES, binary=True),
        LogisticRegression(featuresCol="__features", labelCol="label", regParam=reg, maxIter=60,
                           rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__unwanted"),
    ]).fit(rows)
    rows.unpersist()
    return model


def judge(df: DataFrame, model, rules=RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule and verdict (allow or block)."""
    clash = [c for c in ("host", "path", "rule", "verdict") if c in df.columns and c != url]
    df = df.drop(*clash)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = _features(df.withColumn("host", host).withColumn("path", path), F.col("host"), F.col("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (model.transform(rows)
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("__unwanted") == 1.0, "block").otherwise("allow")))
            .drop("__grams", "__features", "__raw", "__probability", "__unwanted"))
