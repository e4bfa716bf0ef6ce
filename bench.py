"""Headline timings. Prints one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
"""

from __future__ import annotations

import json
import os
import random
import string
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import all_queries  # noqa: E402
from sigweave.plans import detect  # noqa: E402
from sigweave.session import get_session, ship_package, spread  # noqa: E402
from sigweave.sources.captures import complete  # noqa: E402
from sigweave.sources.pack import RulePack  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NAMED = [
    "ext_links", "ext_tags", "ext_parts", "ext_readable_text", "match_word", "match_regex", "match_detect", "match_candidates",
    "agg_tech_prevalence", "win_topk_hits", "search_body_kwic", "trial_regex", "sink_history_csv", "rules_effective", "rules_merge_plan",
    "feed_group_by_meta", "crawl_frontier",
]


def vocabulary(spark: SparkSession) -> list[str]:
    """Words of the corpus, frequent ones first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 4")
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(5_000).collect()]


def word_pack(n: int, words: list[str], present: float = 0.1) -> RulePack:
    """``n`` word rules. A share ``present`` asks for a word of the corpus, the others for
    random letters that hardly any text holds."""
    rng = random.Random(n)
    made = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(6, 12)))
    rules = []
    for i in range(n):
        asked = [rng.choice(words) if rng.random() < present else made() for _ in range(rng.randint(1, 4))]
        part = rng.choices(["body", "title", "header", "script"], [7, 1, 1, 1])[0]
        rules.append({"id": f"b{i:05d}", "name": f"Bench {i}", "matchers": [{"type": "word", "part": part, "words": asked}]})
    return RulePack(rules)


def documents(spark: SparkSession) -> DataFrame:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return complete(spread(docs).select(F.col("doc_id").alias("capture_id"), F.col("text").alias("body")))


def pages(spark: SparkSession) -> DataFrame:
    return complete(spread(spark.read.parquet(f"{SF}/pages.parquet")))


def drain(build: Callable[[], DataFrame]) -> float:
    """Make and run a whole plan, every row and column, without collecting it."""
    started = time.perf_counter()
    df = build()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = get_session("bench", f"local[{CPUS}]")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    queries, _ = all_queries()
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    drain(lambda: queries["ext_title"](spark, SF))  # start the workers and the code cache
    for name in NAMED:
        times[name] = drain(lambda name=name: queries[name](spark, SF))
    words = vocabulary(spark)
    for n in (100, 1000, 8000):
        pack = word_pack(n, words)
        for label, frame in (("pages", pages(spark)), ("documents", documents(spark))):
            took = drain(lambda frame=frame, pack=pack: detect.rule_hits(frame, pack))
            times[f"pack_{n}_{label}"] = took
            rates[f"pack_{n}_{label}"] = round(frame.count() / took, 1)
    print(json.dumps({
        "metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
        "rows_per_sec": rates}))


if __name__ == "__main__":
    main()
