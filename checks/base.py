"""Registry of queries and their SQL twins, and the inputs both sides derive.

Captures need columns the page table lacks (headers, status, icons, ...). They
are computed from ``page_id`` by the same rule here and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sigweave
from sigweave.functions import html
from sigweave.session import spread
from sigweave.sources.pack import RulePack, probe_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PACK_DIR = Path(sigweave.__file__).parent / "packs"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in ("pages", "documents", "part") else rows


@lru_cache(maxsize=None)
def core_pack() -> RulePack:
    return RulePack.from_file(PACK_DIR / "core.json")


NEXT_PROBE = probe_key("#__next")


def captures(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    p = F.col("page_id")
    no_map = F.create_map().cast("map<string,string>")
    pair = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
    mod = lambda n: p % n
    server = (
        F.when(mod(4) == 0, F.concat(F.lit("nginx/1.25."), mod(7).cast("string")))
        .when(mod(4) == 1, "Apache/2.4").when(mod(4) == 2, "cloudflare").otherwise("nginx"))
    headers = F.map_concat(
        pair("server", server),
        F.when(mod(3) == 0, pair("x-powered-by", F.concat(F.lit("PHP/8.1."), mod(3).cast("string")))).otherwise(no_map),
        F.when(mod(5) == 0, pair("set-cookie", F.concat(F.lit("sid="), p.cast("string")))).otherwise(no_map),
    )
    return pages.select(
        p.alias("capture_id"), "url", html.title(F.col("html")).alias("title"), F.coalesce("html", F.lit("")).alias("body"),
        F.when(mod(6) == 3, 301).when(mod(6) == 4, 404).when(mod(6) == 5, 500).otherwise(200).alias("status"),
        headers.alias("headers"),
        F.when(mod(7) == 0, pair("generator", F.concat(F.lit("WordPress 6."), mod(9).cast("string")))).otherwise(no_map).alias("meta"),
        F.concat(
            F.when(mod(7) == 0, F.array(F.lit("/wp-content/themes/t.js"))).otherwise(F.array().cast("array<string>")),
            F.when(mod(2) == 0, F.array(F.concat(F.lit("/js/jquery-3."), mod(8).cast("string"), F.lit(".min.js")))).otherwise(F.array().cast("array<string>")),
        ).alias("scripts"),
        F.when(mod(10) == 0, F.array(F.lit(-1010568750))).when(mod(10) == 1, F.array(F.lit(42), F.lit(-1015932800)))
        .when(mod(10) == 2, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("favicon_hashes"),
        F.when(mod(4) == 0, pair("React.version", F.concat(F.lit("18."), mod(3).cast("string"), F.lit(".0")))).otherwise(no_map).alias("js"),
        F.when(mod(8) == 0, F.map_from_arrays(F.array(F.lit(NEXT_PROBE)), F.array(F.lit(True))))
        .otherwise(F.create_map().cast("map<string,boolean>")).alias("dom_hits"),
        mod(20).cast("int").alias("tab_id"),
        F.timestamp_seconds(F.lit(1704067200) + p * 137).alias("at"),
    )


TITLE_SQL = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"

CAPTURES_SQL = rf"""
captures AS (
  SELECT page_id AS capture_id, page_id AS p, url, {TITLE_SQL} AS title, html AS body,
    CASE page_id % 6 WHEN 3 THEN 301 WHEN 4 THEN 404 WHEN 5 THEN 500 ELSE 200 END AS status,
    CASE page_id % 4 WHEN 0 THEN 'nginx/1.25.' || (page_id % 7) WHEN 1 THEN 'Apache/2.4' WHEN 2 THEN 'cloudflare' ELSE 'nginx' END AS server,
    CASE WHEN page_id % 5 = 0 THEN 'sid=' || page_id END AS cookie,
    CASE WHEN page_id % 3 = 0 THEN 'PHP/8.1.' || (page_id % 3) END AS powered,
    CASE WHEN page_id % 7 = 0 THEN 'WordPress 6.' || (page_id % 9) END AS generator,
    list_concat(CASE WHEN page_id % 7 = 0 THEN ['/wp-content/themes/t.js'] ELSE []::VARCHAR[] END,
      CASE WHEN page_id % 2 = 0 THEN ['/js/jquery-3.' || (page_id % 8) || '.min.js'] ELSE []::VARCHAR[] END) AS scripts,
    CASE page_id % 10 WHEN 0 THEN [-1010568750] WHEN 1 THEN [42, -1015932800] WHEN 2 THEN [0] ELSE []::INTEGER[] END AS favicon_hashes,
    CASE WHEN page_id % 4 = 0 THEN '18.' || (page_id % 3) || '.0' END AS react,
    page_id % 8 = 0 AS next_dom, (page_id % 20)::INTEGER AS tab_id,
    TIMESTAMP '2024-01-01' + to_seconds(137 * page_id) AS seen_at
  FROM pages),
texts AS (
  SELECT *, 'server: ' || server || chr(10) || coalesce('set-cookie: ' || cookie || chr(10), '') || coalesce('x-powered-by: ' || powered || chr(10), '') AS header_text,
    coalesce('generator: ' || generator || chr(10), '') AS meta_text, array_to_string(scripts, chr(10)) AS script_text FROM captures),
parts AS (
  SELECT capture_id, unnest(['body','title','url','header','raw','meta','script']) AS part,
    unnest([body, title, url, header_text, header_text || body, meta_text, script_text]) AS text FROM texts)"""


def with_captures(rest: str) -> str:
    return f"WITH {CAPTURES_SQL}{rest}"


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def sql_values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ",\n    ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES\n    {body})"
