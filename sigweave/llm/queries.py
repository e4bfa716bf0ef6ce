"""One query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_exact_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.sharding import shard

    # Whole documents are placed; size and checksum are those of the placed texts.
    placed = shard(read_table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long").alias("size")
    return placed.select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_length_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.lines import remove_lines

    out = remove_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op7_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, pos - 1 AS pos, line
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
seen AS (
    SELECT line, min((doc_id, pos)) AS first, string_split(line, ' ') AS w
    FROM lines WHERE regexp_matches(line, '\S') GROUP BY line),
long AS (SELECT line, first, w, len(w) AS n FROM seen WHERE len(w) >= 8),
cut AS (
    SELECT line, first, n, i, w[1:i - 1] || w[i + 1:n] AS rest
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
near AS (
    SELECT a.line FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.n = b.n WHERE b.first < a.first
    UNION SELECT a.line FROM cut a JOIN long b ON a.rest = b.w WHERE b.first < a.first
    UNION SELECT a.line FROM long a JOIN cut b ON a.w = b.rest WHERE b.first < a.first),
fate AS (
    SELECT l.doc_id, l.pos, l.line,
           coalesce(s.line IS NOT NULL AND ((l.doc_id, l.pos) > s.first OR n.line IS NOT NULL), false) AS gone
    FROM lines l LEFT JOIN seen s ON l.line = s.line LEFT JOIN near n ON l.line = n.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM fate GROUP BY doc_id
"""


@query
def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.common import id_remainder
    from sigweave.llm.toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.jaccard import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1),
split AS (SELECT first, copies, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM texts),
grams AS (
    SELECT DISTINCT first, w[i:i + least(5, len(w)) - 1] AS gram
    FROM (SELECT first, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT first, count(*) AS n FROM grams GROUP BY first),
shared AS (
    SELECT a.first AS a, b.first AS b, count(*) AS common
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.first <> b.first GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.first = a JOIN sizes y ON y.first = b
    WHERE common >= 0.8 * (x.n + y.n - common) - 1e-6),
reach AS (SELECT first AS a, first AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS first, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS first, count(*) AS n_links, sum(copies) AS linked FROM links JOIN texts ON texts.first = b GROUP BY a)
SELECT d.doc_id, t.first AS rep_id, class_id, coalesce(n_links, 0) AS n_links,
       (coalesce(linked, 0) + copies - 1)::BIGINT AS n_linked_rows
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.text JOIN class USING (first) LEFT JOIN counted USING (first)
"""


@query
def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.ppm import score

    return score(read_table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.suffixes import remove_repeats

    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.imatch import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


@query
def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.pieces import encode

    out = encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "variant", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "lossless")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.infill import fill_in_middle, restored

    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = F.sha2("output", 256).alias("output_sha256")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, back)


SQL["op13_fill_in_middle"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, ('0x' || h[1:8])::BIGINT AS h1,
           ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts),
cut AS (
    SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
    SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts
"""


@query
def op12_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.collocations import mine

    return mine(read_table(spark, sf_dir, "documents"))


SQL["op12_setm_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (
    SELECT lang, w[i:i + k - 1] AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)),
freq AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
cut AS (SELECT lang, g, f AS a, unnest(range(1, k)) AS c, k FROM freq WHERE k > 1),
scored AS (
    SELECT cut.lang, cut.g, a, c, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
    FROM cut JOIN freq x ON x.lang = cut.lang AND x.g = cut.g[1:c] JOIN freq y ON y.lang = cut.lang AND y.g = cut.g[c + 1:cut.k]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
spans AS (
    SELECT lang, f, g[s:s + m - 1] AS g
    FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS s FROM freq, (VALUES (2), (3)) t(m) WHERE m < k)),
longer AS (SELECT lang, g, max(f) AS top FROM spans GROUP BY lang, g),
alone AS (
    SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.g = lowest.g
    WHERE top IS NULL OR 100::HUGEINT * top < 80::HUGEINT * a),
ranked AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


#: The rules of the page filter.
PAGE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op11_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.urls import judge

    rules = spark.createDataFrame(PAGE_RULES, "rule string, verdict string")
    return judge(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")
