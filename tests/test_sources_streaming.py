"""Sources, sinks and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import readers, writers
from palimpsest.streaming import events

SF = "/root/testdata/sf0.001"


def test_corrections_csv(spark, tmp_path):
    names = [c.split(" ")[0] for c in readers.CORRECTIONS.split(", ")]
    row = {n: "" for n in names} | {"edit_id": "e1", "before_text": '"line one\nline ""two"""', "utterance_start": "1.5", "utterance_end": "bad", "utterance_id": "u", "edit_timestamp": "2026-01-02T03:04:05"}
    (tmp_path / "c.csv").write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    out = readers.typed_edits(readers.corrections(spark, str(tmp_path / "c.csv"))).first()
    assert out.before_text == 'line one\nline "two"' and out.start == 1.5 and out.end is None and out.edit_ts.year == 2026


def test_json_lines_with_a_broken_tail(spark, tmp_path):
    (tmp_path / "part-0.jsonl").write_text('{"utterance_id": "a", "row_sig": "s"}\n\n{"utterance_id": "b", "row')
    assert readers.json_lines(spark, str(tmp_path), readers.BOUNDARY).count() == 1
    broken = [r for r in readers.json_lines(spark, str(tmp_path), readers.BOUNDARY, keep_broken=True).collect() if r["_corrupt"]]
    assert len(broken) == 1


def test_meeting_documents(spark, tmp_path):
    doc = {"meeting": {"id": "m", "cityId": "c"}, "people": [{"id": "p", "name": "Ann"}], "transcript": [{"speakerTagId": "t1", "speakerTag": {"personId": "p"}, "utterances": [{"id": "u1", "text": "x", "startTimestamp": 0.0, "endTimestamp": 1.0, "lastModifiedBy": "user"}, {"id": None, "text": "y"}]}, {"speakerTagId": "t2", "speakerTag": {"personId": None}, "utterances": [{"id": "u2", "text": "z", "startTimestamp": 1.0, "endTimestamp": 2.0}]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    rows = readers.utterances(readers.meetings(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.seq, r.utterance_id, r.speaker_name) for r in rows] == [(0, "u1", "Ann"), (1, "u2", None)]
    assert readers.never_edited(readers.utterances(readers.meetings(spark, str(tmp_path)))).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.range(6).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("validation"))
    assert writers.by_split(rows, str(tmp_path / "s")).count() == 6
    writers.versioned(rows, str(tmp_path / "v"), 3, source="x")
    assert writers.open_versioned(spark, str(tmp_path / "v"), 3).count() == 6
    with pytest.raises(ValueError):
        writers.open_versioned(spark, str(tmp_path / "v"), 4)


def test_stream_equals_batch(spark):
    stream = events.windowed(events.read_events(spark, SF, glob="events.parquet"), "6 hours", late="1000 days")
    got = events.run_once(stream, "w6", "complete")
    want = events.windowed(spark.read.parquet(f"{SF}/events.parquet"), "6 hours", late=None)
    key = lambda df: sorted((str(r.w_start), r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_label_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", {"status": "a", "notes": "n"}), (2, "u", {"notes": None}), (3, "v", {"status": "b"})], "id long, utterance_id string, patch map<string,string>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.label_state(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    out = {r.utterance_id: json.loads(r.label) for r in events.run_once(stream, "labels_out", "update").collect()}
    assert out == {"u": {"status": "a"}, "v": {"status": "b"}}


def test_upsert(spark, tmp_path):
    sink = events.upsert(str(tmp_path / "t"), "k", "ts")
    sink(spark.createDataFrame([("a", 1), ("b", 1)], "k string, ts int"), 0)
    sink(spark.createDataFrame([("a", 2)], "k string, ts int"), 1)
    assert {r.k: r.ts for r in spark.read.parquet(str(tmp_path / "t/1")).collect()} == {"a": 2, "b": 1}
