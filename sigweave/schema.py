"""Fixed column types of captures, rules and hits."""

from pyspark.sql import types as T

CAPTURE_FIELDS = {
    "capture_id": T.LongType(),
    "url": T.StringType(),
    "title": T.StringType(),
    "body": T.StringType(),
    "status": T.IntegerType(),
    "headers": T.MapType(T.StringType(), T.StringType()),
    "meta": T.MapType(T.StringType(), T.StringType()),
    "scripts": T.ArrayType(T.StringType()),
    "favicon_hashes": T.ArrayType(T.IntegerType()),
    "js": T.MapType(T.StringType(), T.StringType()),
    "dom_hits": T.MapType(T.StringType(), T.BooleanType()),
}

JS_PROBE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("pattern", T.StringType()),
])
DOM_PROBE = T.StructType([
    T.StructField("sel", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
MATCHER = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("negative", T.BooleanType()),
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("regex", T.ArrayType(T.StringType())),
    T.StructField("status", T.ArrayType(T.IntegerType())),
    T.StructField("hash", T.ArrayType(T.IntegerType())),
    T.StructField("dsl", T.ArrayType(T.StringType())),
    T.StructField("js", T.ArrayType(JS_PROBE)),
    T.StructField("dom", T.ArrayType(DOM_PROBE)),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("version", T.StringType()),
])
RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("matchers-condition", T.StringType()),
    T.StructField("matchers", T.ArrayType(MATCHER)),
    T.StructField("implies", T.ArrayType(T.StringType())),
    T.StructField("excludes", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.IntegerType()),
])

EVIDENCE = T.StructType([
    T.StructField("matcher_ix", T.IntegerType()),
    T.StructField("pattern_ix", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("version", T.StringType()),
])

PARTS = ("body", "title", "url", "header", "raw", "meta", "script")
MATCHER_TYPES = ("word", "regex", "status", "icon_hash", "dsl", "js", "dom")

# Field of a matcher that holds the payload of each type.
PAYLOAD_FIELD = {
    "word": "words", "regex": "regex", "status": "status", "icon_hash": "hash",
    "dsl": "dsl", "js": "js", "dom": "dom",
}
