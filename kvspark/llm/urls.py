"""URL filters: rules first, then a character language-model ratio, with DataFrame functions only.

Rules name a host with its subdomains and the start of a path; the longest that
fits decides. URLs that a rule allows or blocks teach two Markov models over
a reduced alphabet: the next symbol given the last two, or one, or none, whichever
was seen often enough, each smoothed with the shorter one. A URL without a rule is
judged by the difference of the models' log-likelihoods per symbol, against the
threshold that separates allowed from blocked URLs best, each class weighing half.

Counts and the calibration cover all URLs. The alphabet bounds the model:
``len(ALPHABET) ** 3`` rows whatever the input, so it is broadcast to the URLs'
symbols. Sums per URL are complete before the shuffle, which then holds one small
row per URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, no
rule, and is scored by what text it has (null: none). Without both allowed and
blocked examples there is no model and URLs without a rule are allowed. Repeated
rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.tables import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Start, letters, any digit, the usual punctuation, any other character, end.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0./-_?=&#%:*$"
SIZE = len(ALPHABET)
#: Times a context must have been seen for its own counts to be used.
SEEN = 8
#: Thresholds tried: from -SPAN to SPAN nats a symbol in steps of STEP.
SPAN, STEP = 5.0, 0.01


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    url, pattern = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Codes of a URL's symbols after two start symbols, with the end symbol last."""
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    text = F.regexp_replace(text, r"[^a-z0./\-_?=&#%:]", "*")
    padded = F.concat(F.lit("^^"), text, F.lit("$"))
    return F.transform(F.split(padded, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _grams(codes: Column) -> Column:
    """Codes of (symbol before last, last symbol, symbol) of every symbol after the start."""
    each = F.transform(
        F.array(codes),  # bound once, not evaluated again for every symbol
        lambda known: F.transform(
            F.slice(known, F.lit(3), F.size(known)),
            lambda c, i: (F.get(known, i) * SIZE + F.get(known, i + 1)) * SIZE + c,
        ),
    )
    return F.get(each, F.lit(0))


def model(counts: DataFrame) -> DataFrame:
    """(class, gram, logp) of every possible gram, from ``counts`` (class, gram, n) of each class."""
    spark = counts.sparkSession
    grid = spark.range(SIZE**3).select(F.col("id").cast("int").alias("gram"))
    grid = grid.withColumn("allow", F.explode(F.array(F.lit(True), F.lit(False))))
    full = grid.join(counts, ["allow", "gram"], "left").select(
        "allow",
        "gram",
        F.floor(F.col("gram") / SIZE**2).alias("a"),
        (F.floor(F.col("gram") / SIZE) % SIZE).alias("b"),
        (F.col("gram") % SIZE).alias("c"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n3"),
    )
    over = lambda *by: Window.partitionBy("allow", *by)
    full = full.withColumn("n2", F.sum("n3").over(over("b", "c"))).withColumn("n1", F.sum("n3").over(over("c")))
    # Each (b, c) stands once for every a, and each c for every (a, b): hence the flags.
    first_a, first_ab = (F.col("a") == 0).cast("int"), ((F.col("a") == 0) & (F.col("b") == 0)).cast("int")
    full = (
        full.withColumn("ctx2", F.sum("n3").over(over("a", "b")))
        .withColumn("kinds2", F.sum((F.col("n3") > 0).cast("int")).over(over("a", "b")))
        .withColumn("ctx1", F.sum(F.col("n2") * first_a).over(over("b")))
        .withColumn("kinds1", F.sum((F.col("n2") > 0).cast("int") * first_a).over(over("b")))
        .withColumn("total", F.sum(F.col("n1") * first_ab).over(over()))
    )
    p0 = (F.col("n1") + 1) / (F.col("total") + SIZE)
    p1 = F.when(F.col("ctx1") < SEEN, p0).otherwise((F.col("n2") + F.col("kinds1") * p0) / (F.col("ctx1") + F.col("kinds1")))
    p2 = F.when(F.col("ctx2") < SEEN, p1).otherwise((F.col("n3") + F.col("kinds2") * p1) / (F.col("ctx2") + F.col("kinds2")))
    return full.select("allow", "gram", F.log(p2).alias("logp"))


def ratio(labelled: DataFrame) -> DataFrame | None:
    """(gram, d): log-likelihood differences, from ``labelled`` (allow, grams); None without both classes."""
    grams = labelled.select("allow", F.explode("grams").alias("gram"))
    counts = written(grams.groupBy("allow", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    if counts.select("allow").distinct().count() < 2:
        return None
    sign = F.when(F.col("allow"), F.col("logp")).otherwise(-F.col("logp"))
    return written(model(counts).groupBy("gram").agg(F.sum(sign).alias("d")), "ratio")


def scored(urls: DataFrame, differences: DataFrame) -> DataFrame:
    """``urls`` (with ``grams``, which goes) with ``score``: above 0, more like allowed URLs.

    The score is the mean difference of log-likelihoods a symbol; every URL has its end symbol at least.
    """
    others = [c for c in urls.columns if c != "grams"]
    each = urls.select(*others, F.explode("grams").alias("gram")).join(F.broadcast(differences), "gram")
    return each.groupBy(*others).agg(F.avg("d").alias("score"))


def threshold(examples: DataFrame) -> float:
    """The score that separates ``examples`` (score, allow) best, classes weighing alike; the smallest of equals."""
    bins = int(2 * SPAN / STEP)
    at = F.least(F.greatest(F.floor((F.col("score") + SPAN) / STEP), F.lit(0)), F.lit(bins)).cast("int")
    held = examples.groupBy(at.alias("bin")).agg(
        F.sum(F.col("allow").cast("double")).alias("good"), F.sum((~F.col("allow")).cast("double")).alias("bad")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # Cutting below a bin loses the allowed under it and keeps the blocked in it and above.
    lost = F.coalesce(F.sum("good").over(below), F.lit(0.0)) / F.sum("good").over(whole)
    gained = F.coalesce(F.sum("bad").over(below), F.lit(0.0)) / F.sum("bad").over(whole)
    # The cut lies midway between the last score below it and the first above.
    before = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))
    best = held.select("bin", before.alias("before"), (lost - gained).alias("loss")).orderBy("loss", "bin").first()
    return (best["bin"] + best["before"]) / 2 * STEP - SPAN


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per row of ``pages``; score is null without a model."""
    host, path = split_url(F.col("url"))
    own = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = own.withColumn("host", host).withColumn("path", path).withColumn("grams", _grams(symbols(F.col("url")))).drop("url")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = written(own.withColumn("rule", rule).withColumn("says", says), "urls")
    allow = (F.col("says") == "allow").alias("allow")
    differences = ratio(own.filter("says IS NOT NULL").select(allow, "grams"))
    if differences is None:
        judged, by_model = own.withColumn("score", F.lit(None).cast("double")), F.lit("allow")
    else:
        judged = written(scored(own, differences), "scored")
        cut = threshold(judged.filter("says IS NOT NULL").select("score", allow))
        by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", by_model).alias("verdict"), "score")
