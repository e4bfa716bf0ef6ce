"""Near-duplicate lines by a deletion-neighbourhood join, on DataFrame operations only.

Two lines are near when one word inserted, deleted or replaced turns one into the
other. Deleting each word in turn gives a line's variants; two near lines share one.
A line has a chance of a neighbour only if another line begins or ends with the same
words, so variants are made for such lines alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import store

#: Lines of fewer words are compared exactly: one word would be too large a part of them.
MIN_WORDS = 8

POSITION = ("_id", "_k", "_line")


def words(line: Column) -> Column:
    return F.split(line, " ", -1)


def _ends(w: Column, n: Column) -> Column:
    """Keys of a line's first and last h words, h the largest power of two that leaves a
    word between them. One edit spares one of the two ends. Where a line one word shorter
    would take a smaller h, the line takes that too, to meet such lines."""
    h = lambda m: F.pow(F.lit(2.0), F.floor(F.log2((m - 1) / 2))).cast("int")
    keys = lambda k: F.array(F.xxhash64(F.lit("head"), k, F.slice(w, F.lit(1), k)), F.xxhash64(F.lit("tail"), k, F.slice(w, n - k + 1, k)))
    return F.when(h(n) == h(n - 1), keys(h(n))).otherwise(F.concat(keys(h(n)), keys(h(n - 1))))


def _within_one(a: Column, b: Column) -> Column:
    """Whether the word lists differ by one insertion, deletion or replacement at most."""
    short = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), short - 1), lambda i: F.get(a, i) != F.get(b, i))
    at = F.coalesce(F.get(differs, F.lit(0)), short)
    rest = lambda x, start: F.slice(x, start + 1, F.greatest(F.lit(0), F.size(x) - start))
    return (
        F.when(F.size(a) == F.size(b), rest(a, at + 1) == rest(b, at + 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, at + 1) == rest(b, at))
        .when(F.size(a) + 1 == F.size(b), rest(a, at) == rest(b, at + 1))
        .otherwise(False)
    )


def remove_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, ``text`` without the lines that repeat an earlier one,
    and ``n_lines``, ``n_removed`` (long; input columns of these names are replaced).

    Lines are what newlines separate, words what single spaces separate. In the order
    (doc_id, text hash, line number) a line goes if an equal line comes before it, or, from
    ``min_words`` words on, if a line within one word edit comes before it, be that one
    kept or not. Lines without a visible character always stay. A null text is treated
    as empty and returned as empty; rows of one id and one text are one document and are
    treated alike. An empty table gives no rows.
    """
    kept_columns = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    base = docs.select(*kept_columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"))
    base = base.withColumn("_k", F.xxhash64("_id", "text"))

    read = (
        base.select("_id", "_k", F.posexplode(F.split("text", "\n", -1)).alias("_line", "_s"))
        .where(F.col("_s").rlike(r"\S"))
        .withColumns({"_h1": F.xxhash64("_s"), "_h2": F.hash(F.lit("line"), "_s")})
    )
    lines = store(read.select("_h1", "_h2", *POSITION), "lines")
    first = store(lines.groupBy("_h1", "_h2").agg(F.min(F.struct(*POSITION)).alias("_first"), F.count("*").alias("_count")), "first-lines")

    ends = read.withColumn("_w", words(F.col("_s"))).withColumn("_n", F.size("_w")).where(F.col("_n") >= min_words).select("_h1", F.explode(_ends(F.col("_w"), F.col("_n"))).alias("_key"))
    ends = store(ends, "ends")
    shared = ends.groupBy("_key").agg(F.min("_h1").alias("_a"), F.max("_h1").alias("_b")).where("_a < _b").select("_key")
    hopeful = ends.join(shared, "_key", "left_semi").select("_h1").distinct()
    # Words of the hopeful lines, read from the place where each stands first.
    places = first.join(hopeful, "_h1", "left_semi").select("_h1", "_h2", *(F.col(f"_first.{c}").alias(c) for c in POSITION)).groupBy("_id", "_k").agg(
        F.collect_list(F.struct("_line", "_h1", "_h2")).alias("_at"))
    found = (
        base.select("_id", "_k", "text").join(places, ["_id", "_k"])
        .withColumn("_lines", F.split("text", "\n", -1))
        .select("_id", "_k", F.explode(F.transform("_at", lambda p: F.struct(p["_line"].alias("_line"), p["_h1"].alias("_h1"), p["_h2"].alias("_h2"), F.get(F.col("_lines"), p["_line"]).alias("_s")))).alias("_l"))
        .select(F.col("_l._h1"), F.col("_l._h2"), F.struct("_id", "_k", F.col("_l._line").alias("_line")).alias("_first"), words(F.col("_l._s")).alias("_w"))
        .dropDuplicates(["_h1", "_h2"])
    )
    hopeful_words = store(found, "hopeful-lines")

    size = F.size("_w")
    # The last "deletion" takes nothing away: it is the line itself, which a longer line's variant may equal.
    variants = hopeful_words.select(F.col("_h1").alias("_h"), size.alias("_n"), F.posexplode(F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.xxhash64(F.when(i < size, size - 1).otherwise(size), F.slice(F.col("_w"), F.lit(1), i), F.slice(F.col("_w"), i + 2, F.greatest(F.lit(0), size - i - 1))))).alias("_i", "_v"),
    ).select("_v", "_h", F.when(F.col("_i") < F.col("_n"), F.col("_i")).otherwise(-1).cast("int").alias("_place"))
    variants = store(variants, "variants")
    met = variants.groupBy("_v").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a < _b").select("_v")
    hits = variants.join(met, "_v").join(hopeful_words.select(F.col("_h1").alias("_h"), "_h1", "_h2", "_first"), "_h")
    hits = store(hits.select("_v", "_place", "_h1", "_h2", "_first"), "met-variants")
    member = F.struct("_first", "_h1", "_h2")
    groups = hits.groupBy("_v", "_place").agg(F.min(member).alias("_min"))
    # Lines with the same variant at the same place differ in one word: each looks at the earliest.
    replaced = groups.where("_place >= 0").select("_v", "_place", F.col("_min").alias("_other"))
    # A whole line and the longer lines that lose a word to become it look at each other.
    whole = groups.where("_place < 0").select("_v", F.col("_min").alias("_other"))
    longer = groups.where("_place >= 0").groupBy("_v").agg(F.min("_min").alias("_other"))
    near = (
        hits.where("_place >= 0").join(replaced, ["_v", "_place"]).select(member.alias("_own"), "_other")
        .unionByName(hits.where("_place >= 0").join(whole, "_v").select(member.alias("_own"), "_other"))
        .unionByName(hits.where("_place < 0").join(longer, "_v").select(member.alias("_own"), "_other"))
        .where("_other._first < _own._first").groupBy("_own._h1", "_own._h2", "_own").agg(F.collect_set("_other").alias("_others"))
    )
    pair = near.select(F.col("_h1"), F.col("_h2"), F.explode("_others").alias("_o")).select("_h1", "_h2", F.col("_o._h1").alias("_o1"), F.col("_o._h2").alias("_o2"))
    mine = hopeful_words.select("_h1", "_h2", F.col("_w").alias("_a"))
    theirs = hopeful_words.select(F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2"), F.col("_w").alias("_b"))
    verified = pair.join(mine, ["_h1", "_h2"]).join(theirs, ["_o1", "_o2"]).where(_within_one(F.col("_a"), F.col("_b"))).select("_h1", "_h2").distinct()

    fates = first.join(verified.withColumn("_near", F.lit(True)), ["_h1", "_h2"], "left").where("_near or _count > 1").select("_h1", "_h2", "_first", F.coalesce("_near", F.lit(False)).alias("_near"))
    gone = (
        lines.join(fates, ["_h1", "_h2"]).where(F.col("_near") | (F.struct(*POSITION) > F.col("_first")))
        .groupBy("_id", "_k").agg(F.collect_set("_line").alias("_gone"))
    )
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda s, i: ~F.array_contains(F.col("_gone"), i))
    return base.join(store(gone, "gone-lines"), ["_id", "_k"], "left").select(
        *kept_columns,
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
