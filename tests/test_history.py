"""Histories hold the hits of the whole pack, however their scans were dealt to batches."""

from pyspark.sql import functions as F

from checks.base import captures, core_pack
from checks.stream import as_stream
from sigweave.operators import reports
from sigweave.plans import detect
from sigweave.streaming import captures as streams
from sigweave.streaming.runtime import work_dir


def test_stored_histories_hold_all_hits_of_their_capture(spark):
    caps = captures(spark, "/root/testdata/sf0.001")
    hits = detect.detect(caps, core_pack()).persist()
    scans = reports.scan_history(caps, hits, F.lit("page"), F.col("at"))
    history = streams.history_table(work_dir(spark, "history"))
    streams.history_stream(as_stream(scans, "at", slices=2), history, work_dir(spark, "state"))
    found = {r.capture_id: {h.id for h in r.hits} for r in streams.read_history(history, spark, 5_000).collect()}
    want = {}
    for r in hits.collect():
        want.setdefault(r.capture_id, set()).add(r.rule_id)
    assert found and all(ids == want.get(c, set()) for c, ids in found.items())
    assert any("status" not in i for ids in found.values() for i in ids)
