"""URL filters: rules of host and path decide what they fit, gradient-boosted trees on
lexical features the rest. The trees learn from URLs whose label is known; in a crawl
those are the URLs that the rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import store

#: Distinct labelled URLs that training reads, about: more are drawn by a hash of the URL.
SAMPLE = 20_000
#: Trees, their depth, the step of each, and the rows a suffix needs to count half.
TREES, DEPTH, STEP, SMOOTH = 16, 4, 0.25, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(rows: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``params`` (what stands between ``?`` and ``#``) of ``url``. The
    host ends at the first of ``/?#``; a null URL or one without ``://`` has empty parts."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    found = rows.withColumn("_rest", after).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    found = found.withColumn("_tail", F.expr("substring(_rest, char_length(_host) + 1)"))
    return found.select(
        *rows.columns, F.translate("_host", UPPER, LOWER).alias("host"), F.regexp_extract("_tail", r"^[^?#]*", 0).alias("path"),
        F.regexp_extract("_tail", r"^[^?#]*\?([^#]*)", 1).alias("params"))


def decided(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of (``host``, ``path``, any others) with ``rule`` and ``ruled``, the verdict of the
    longest rule that fits; null where none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's.
    Hosts are looked up by suffix and paths by a prefix of each length that the rules of the
    host have, so a row is tried with as many keys as it has labels and lengths, however
    many rules there are. Rules of equal length go by their text.
    """
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("_of"), F.expr("substring(rule, char_length(substring_index(rule, '/', 1)) + 1)").alias("_start"))
    split = split.groupBy("_of", "_start").agg(F.min_by(F.struct("rule", "verdict"), F.struct("rule", "verdict")).alias("_r"))
    sizes = split.groupBy("_of").agg(F.collect_set(F.char_length("_start")).alias("_sizes"))
    most = split.agg(F.max(F.size(F.split("_of", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    kept = rows.columns
    tried = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_labels", labels)
    suffixes = F.expr(f"transform(sequence(1, least(size(_labels), {int(most)})), n -> array_join(slice(_labels, size(_labels) - n + 1, n), '.'))")
    keyed = tried.withColumn("_of", F.explode(suffixes)).drop("_labels")
    keyed = keyed.join(sizes, "_of", "left").withColumn("_size", F.explode_outer("_sizes")).drop("_sizes")
    keyed = keyed.withColumn("_start", F.expr("CASE WHEN _size <= char_length(path) THEN substring(path, 1, _size) END"))
    met = keyed.join(split, ["_of", "_start"], "left")
    best = F.max(F.when(F.col("_r").isNotNull(), F.struct(F.char_length("_r.rule").alias("n"), F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict")))).alias("_best")
    one = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in kept], best)
    return one.select(*kept, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("ruled"))


def entropy(text: Column) -> Column:
    """Bits a character of a text, from runs of equal characters in sorted order."""
    n = F.char_length(text).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    term = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)
    step = lambda acc, c: F.when(
        acc["c"] == c, F.struct(c.alias("c"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))
    ).otherwise(F.struct(c.alias("c"), F.lit(1).alias("run"), (acc["sum"] + term(acc["run"])).alias("sum")))
    spent = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda acc: acc["sum"] + term(acc["run"]))
    return F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0)


#: Parts of a URL whose share of blocked URLs is a feature: endings of the host by one, two
#: and three labels, the ending of the path, and its first folder.
SUFFIXES = {
    "_tail1": "substring_index(host, '.', -1)",
    "_tail2": "substring_index(host, '.', -2)",
    "_tail3": "substring_index(host, '.', -3)",
    "_ending": r"regexp_extract(path, '[.]([A-Za-z0-9]{1,8})$', 1)",
    "_folder": "regexp_extract(path, '^/([^/]*)/', 1)",
}
LEXICAL = ["_length", "_depth", "_digits", "_entropy", "_params", "_labels", "_host_length", "_hyphens"]


def with_features(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url).cast("double")
    count = lambda text, kind: F.char_length(F.regexp_replace(text, kind, "")).cast("double")
    filled = lambda text, mark: F.size(F.array_remove(F.split(text, mark), "")).cast("double")
    return rows.select(
        "*", n.alias("_length"), filled(F.col("path"), "/").alias("_depth"), F.when(n > 0, count(url, "[^0-9]") / n).otherwise(0.0).alias("_digits"),
        entropy(url).alias("_entropy"), filled(F.col("params"), "&").alias("_params"), filled(F.col("host"), r"\.").alias("_labels"),
        F.char_length("host").cast("double").alias("_host_length"), count(F.col("host"), "[^-]").alias("_hyphens"), *[F.expr(c).alias(k) for k, c in SUFFIXES.items()])


@dataclass
class UrlModel:
    """Trees and the suffix table they read; without trees every URL scores ``prior``."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float


def _with_rates(rows: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    for kind in SUFFIXES:
        # At most one row for each sampled URL: SAMPLE bounds what is sent to all tasks.
        table = suffixes.where(F.col("kind") == kind).select(F.col("key").alias(kind), "seen", "bad")
        rate = (F.coalesce("bad", F.lit(0.0)) + prior * SMOOTH) / (F.coalesce("seen", F.lit(0)) + SMOOTH)
        rows = rows.join(F.broadcast(table), kind, "left").withColumn(f"{kind}_rate", rate).drop("seen", "bad")
    inputs = [*LEXICAL, *[f"{k}_rate" for k in SUFFIXES]]
    return VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep").transform(rows).drop(*inputs, *SUFFIXES)


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 3) -> UrlModel:
    """A model from ``url, label`` (1: to be blocked; rows without either do not count).

    Copies of a URL count once, with the label most of them have (a tie: blocked). Of more
    than ``sample`` distinct URLs about that many are drawn by hash. One half of them fills
    the suffix table, the other half trains the trees, so no URL meets its own label in it.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).groupBy("url").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = store(known, "labelled")
    n = known.count()
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)
    drawn = store(with_features(with_parts(known.withColumn("_draw", draw).where(F.col("_draw") < min(1.0, sample / max(n, 1))))).repartition(8, "url"), "drawn")
    half = F.pmod(F.hash("url", F.lit(seed)), F.lit(2)) == 0
    told = drawn.agg(F.avg("label"), F.min(F.when(~half, F.col("label"))), F.max(F.when(~half, F.col("label")))).first()
    prior = 0.0 if told[0] is None else float(told[0])
    if told[1] is None or told[1] == told[2]:
        return UrlModel(None, None, prior)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in SUFFIXES])
    suffixes = store(drawn.where(half).select(F.explode(pairs).alias("s"), "label").groupBy("s.kind", "s.key").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("bad")), "suffixes")
    rows = _with_rates(drawn.where(~half), suffixes, prior).select("label", "_features")
    trees = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed).fit(rows)
    return UrlModel(trees, suffixes, prior)


def scored(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Rows of (``url, host, path, params``, any others) with ``score``, the chance to be one
    that is to be blocked."""
    if model.trees is None:
        return rows.withColumn("score", F.lit(model.prior))
    rated = _with_rates(with_features(rows), model.suffixes, model.prior)
    trees = model.trees.setFeaturesCol("_features").setProbabilityCol("_chance").setRawPredictionCol("_raw").setPredictionCol("_said")
    return trees.transform(rated).withColumn("score", vector_to_array("_chance")[1]).drop("_features", "_chance", "_raw", "_said")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``page_id, url``.

    ``rules`` holds ``rule`` (like ``net/es/``) and ``verdict`` (allow or block). What no rule fits
    is blocked from a score of 0.5 on; without two kinds of labels the score is the share of
    blocked URLs. A null URL or one without ``://`` has empty host and path, which no rule
    fits. Repeated rows and null ids stay, each with its own verdict; URLs of any length are
    read whole. Other columns are not read; an empty table gives no rows.
    """
    told = store(decided(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules), "ruled")
    model = fit(told.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "block").cast("int").alias("label")))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored(told, model).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
