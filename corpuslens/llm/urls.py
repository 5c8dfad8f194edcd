"""Operator 2: URL filter by the ratio of two character language models.

URLs that a rule decides teach two smoothed variable-order Markov models, one of accepted and one of rejected URLs:
Witten-Bell interpolation from contexts of ORDER characters down to none, over the whole URL. A URL that no rule fits is judged by the
difference of the models' log-likelihoods, divided by its length, against a threshold calibrated on rule-decided URLs
that the models have not seen.

Counts are those of all rows, repeated URLs as often as they occur: the n-grams of the whole table are aggregated on the executors, the model is a table with
a row for each n-gram (it grows with the input and is never collected or broadcast by hand), and scoring is a join.
Log-ratios are kept in millionths as whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, join_keyed, stage

ORDER = 4
#: Characters that the lowest-order model shares its mass over.
ALPHABET = 256
UNIT = 1_000_000
#: One fifth of the rule-decided URLs calibrates.
FOLDS = 5
BIN = 1000
# The rules of the query, longest first wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null or without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; nothing that stands behind one of these is path."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*+(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Hashes' sources: one n-gram of ORDER + 1 characters for each character and the end."""
    chars = F.split(F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03")), "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def model(urls: DataFrame) -> DataFrame:
    """(gram, ratio, n): for each n-gram of ``urls`` (text, n, accepted, rejected) log P_accepted - log P_rejected in units.

    n, accepted and rejected say how many rows have the text, and how many of them teach either model. An order's chances
    are joined with the next order's by its suffix, which as many n-grams share as there are characters.
    """
    spark = urls.sparkSession
    sums = [F.sum(c).alias(c) for c in ("n", "a", "r")]
    grams = urls.select(F.explode(_grams(F.col("text"))).alias("gram"), "n", F.col("accepted").alias("a"), F.col("rejected").alias("r"))
    top = stage(spark, grams.groupBy("gram").agg(*sums), "grams")
    parts = top.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))).withColumn("part", F.expr("right(gram, k)"))
    counts = stage(spark, parts.groupBy("k", "part").agg(*sums), "counts", narrow=True)
    chances = spark.range(1).select(F.lit("").alias("suffix"), F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))

    def chance(x: str) -> Column:
        total = F.col("n" + x) + F.col("t" + x)
        return F.when(total == 0, F.col("p" + x)).otherwise((F.col(x) + F.col("t" + x) * F.col("p" + x)) / F.greatest(total, F.lit(1))).alias("p" + x)

    for k in range(1, ORDER + 2):
        own = counts.where(F.col("k") == k).select("part", "n", "a", "r", F.expr("left(part, k - 1)").alias("context"), F.expr("right(part, k - 1)").alias("suffix"))
        contexts = own.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        chances = own.join(contexts, "context").join(chances, "suffix").select(F.col("part").alias("suffix"), "n", chance("a"), chance("r"))
        if k <= ORDER:
            chances = chances.drop("n")
    return chances.select(F.col("suffix").alias("gram"), F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("ratio"), "n")


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, score (log-likelihood difference a character).

    The rules see host and path, the models the whole URL, as often as it occurs. A null URL is an empty text; it and one
    without :// have empty host and path. Repeated rows are judged alike; an empty table gives no rows. Without
    rule-decided URLs of both kinds the threshold is 0. Columns of ``pages`` that have one of the new names are an error.
    """
    spark = pages.sparkSession
    clash = {c.lower() for c in pages.columns} & {"host", "path", "rule", "verdict", "score"}
    if clash:
        raise ValueError(f"columns of the table have names of the result: {', '.join(sorted(clash))}")
    said, text, u, v, known = free_names(pages, count=5)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col))).withColumn("rule", rule).withColumn(said, verdict)
    # two hashes stand for the text: all that follows is the same for equal texts
    ruled = ruled.withColumn(text, F.coalesce(F.col(url_col), F.lit("")))
    keyed = ruled.withColumns({u: F.xxhash64(text), v: F.xxhash64(F.lit("v"), F.col(text))}).drop(text)
    named = keyed.select(F.coalesce(F.col(url_col), F.lit("")).alias("text"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(said).alias("said"))
    distinct = stage(spark, named.groupBy("u", "v").agg(F.min("text").alias("text"), F.min("said").alias("said"), F.count("*").alias("n")), "urls")
    fold = F.pmod(F.col("v"), F.lit(FOLDS))
    taught = lambda kind: F.when((fold != 0) & (F.col("said") == kind), F.col("n")).otherwise(0).cast("long")
    ratios = model(distinct.select("text", "n", taught("allow").alias("accepted"), taught("block").alias("rejected")))
    prints = [F.xxhash64("gram").alias("g"), F.xxhash64(F.lit("g"), "gram").alias("g2")]
    ratios = stage(spark, ratios.select(*prints, "ratio", "n"), "ratios", narrow=True)
    shown = distinct.select("u", "v", "said", "n", F.explode(_grams(F.col("text"))).alias("gram")).select("u", "v", "said", F.col("n").alias("rows"), *prints)
    sums = join_keyed(shown, ratios, ["g", "g2"], "n").groupBy("u", "v").agg(F.sum("ratio").alias("sum"), F.count("*").alias("grams"), F.min("said").alias("said"), F.min("rows").alias("n"))
    scored = stage(spark, sums.select("u", "v", "said", "n", F.expr("sum div grams").alias("mean")), "url-scores", narrow=True)
    cut = threshold(scored.where(fold == 0))
    result = join_keyed(keyed, scored.select(F.col("u").alias(u), F.col("v").alias(v), F.col("mean").alias(known), "n"), [u, v], "n")
    decided = F.coalesce(F.col(said), F.when(F.col(known) >= cut, "allow").otherwise("block"))
    return result.withColumn("verdict", decided).withColumn("score", F.col(known) / UNIT).select(*pages.columns, "host", "path", "rule", "verdict", "score")


def threshold(scored: DataFrame) -> int:
    """The mean ratio that parts accepted from rejected URLs (mean, said, n rows) best, both kinds weighing the same; 0 without one kind.

    A histogram reaches the driver; log-ratios are bounded by the smoothing, so its bins are too.
    """
    bins = (
        scored.where("said is not null")
        .groupBy(F.floor(F.col("mean") / BIN).alias("b"))
        .agg(F.sum(F.when(F.col("said") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("r"))
        .orderBy("b")
        .collect()
    )
    accepted, rejected = sum(x.a for x in bins), sum(x.r for x in bins)
    if not accepted or not rejected:
        return 0
    # errors when all from bin i on are accepted; of equally good cuts the middle one
    errors, below_a, below_r = [], 0, 0
    for x in bins:
        errors.append((round(below_a / accepted + (rejected - below_r) / rejected, 12), x.b))
        below_a, below_r = below_a + x.a, below_r + x.r
    least = min(errors)[0]
    i = next(k for k, e in enumerate(errors) if e[0] == least)
    low = errors[i - 1][1] + 1 if i else errors[i][1]
    return int((low + errors[i][1]) / 2 * BIN)


def keep_allowed(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Those of ``pages`` that are judged ``allow``, with their own columns, whatever their names."""
    own = free_names(pages, count=len(pages.columns))
    judged = judge(pages.toDF(*own), own[pages.columns.index(url_col)], rules)
    return judged.where("verdict = 'allow'").select(own).toDF(*pages.columns)
