import json

import pytest
from pyspark.sql import functions as F

from groundlake.operators import events as e
from groundlake.operators import metrics as m
from groundlake.plans import streams, view
from groundlake.sources import documents as sd
from groundlake.sources import events as se
from groundlake.streaming import events as st

SF = "/root/testdata/sf0.001"
GOOD = {"event_id": "E1", "event_type": "query_completed", "timestamp": "2026-01-02T03:04:05Z", "latency_ms": 5, "language": "kn", "session_id": "S1"}


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))


def test_four_lines_give_one_valid_event(spark, tmp_path):
    write(tmp_path / "a.jsonl", [GOOD, GOOD | {"event_id": "E2", "raw_query": "x"}, "", GOOD | {"event_id": "E3", "latency_ms": -10}, "not json"])
    lines = se.read_events_jsonl(spark, str(tmp_path))
    checked = e.validate(lines)
    rows = {r.line_number: r.reason for r in checked.collect()}
    assert rows == {1: None, 2: "forbidden field", 4: "latency_ms: negative", 5: "not JSON"}
    bad = {r.line_number: r for r in e.quarantine(checked).collect()}
    assert bad[5].raw_content_preview == "not json" and bad[2].raw_content_preview is None and "raw_query" in bad[2].keys_present
    lake = e.normalize(e.first_occurrence(checked), b"s")
    assert len(lake.columns) == 39 and set(lake.columns) == {c.split()[0] for c in se.LAKE.split(", ")}
    row = lake.first()
    assert row.telemetry_environment == "fixture" and row.hour == 3 and row.total_latency_ms == 5.0 and row.anonymous_user_id.startswith("USER-")


def test_lake_round_trip_prunes_partitions(spark, tmp_path):
    write(tmp_path / "a.jsonl", [GOOD | {"event_id": f"E{i}", "timestamp": f"2026-01-0{1 + i % 2}T00:00:00Z"} for i in range(5)])
    lake = e.normalize(e.first_occurrence(e.validate(se.read_events_jsonl(spark, str(tmp_path)))), b"s")
    se.write_lake(lake, str(tmp_path / "lake"))
    back = se.read_lake(spark, str(tmp_path / "lake"))
    assert back.count() == 5 and back.select("date").distinct().count() == 2
    plan = back.filter("date = '2026-01-01'").groupBy("language").count()._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_ten_queries_give_the_known_rates(spark):
    rows = [("fixture", "query_completed", f"u{i}", "kn" if i % 2 == 0 else "hi", 20, i < 8, i >= 8, i < 8) for i in range(10)]
    lake = spark.createDataFrame(rows, "telemetry_environment string, event_type string, anonymous_user_id string, language string, candidate_count int, grounded boolean, fallback_used boolean, citation_valid boolean")
    zero = {c: F.lit(0.0) for c in ("total_latency_ms", "retrieval_latency_ms", "generation_latency_ms", "reranking_latency_ms", "best_retrieval_score")} | {c: F.lit(0) for c in ("citation_count", "retrieved_chunk_count", "variant_count")} | {c: F.lit(False) for c in ("is_code_mixed", "is_romanized", "error")}
    lake = lake.withColumns(zero)
    one = m.answers(lake).filter("environment = 'fixture'").first()
    assert (one.queries_evaluated, one.grounded_answer_rate, one.fallback_answer_rate, one.citation_validity_rate) == (10, 80.0, 20.0, 80.0)
    kn = m.language_performance(lake).filter("environment = 'all' AND language = 'kn'").first()
    assert (kn.total_queries, kn.query_share_pct) == (5, 50.0)
    assert m.retrieval(lake).filter("environment = 'all'").first().avg_candidate_count == 20.0
    named = m.transitions(view.lake(spark, SF))
    assert named.count() == m.explicit_transitions(view.lake(spark, SF)).count()


def test_text_files_and_admission(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿ಕನ್ನಡ".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbf")
    rows = {r.path.rsplit("/", 1)[1]: r for r in sd.read_text_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "ಕನ್ನಡ" and rows["a.txt"].warnings == ["BOM_STRIPPED"]
    assert rows["b.txt"].text == "café" and rows["b.txt"].warnings == ["UTF8_DECODE_FALLBACK"] and rows["c.txt"].warnings == ["EMPTY_FILE", "BOM_STRIPPED"]
    files = spark.createDataFrame([("x.PDF", 10), ("x.exe", 10), ("y.txt", 0), ("z.md", 16 << 20)], "path string, length long")
    assert [r.path for r in sd.admitted(files).collect()] == ["x.PDF"]


def test_chunk_artifacts_and_manifest(spark, tmp_path):
    (tmp_path / "d_chunks.json").write_text(json.dumps({"document_id": "D", "chunks": [{"chunk_id": "D:p1:c0", "doc_id": "D", "text_content": "x"}, {"chunk_id": "D:p1:c1", "doc_id": "D", "text_content": "y"}]}))
    (tmp_path / "manifest.json").write_text(json.dumps([{"document_id": "D", "title": "T", "category": "c", "is_active": True}]))
    (tmp_path / "d_parsed.json").write_text(json.dumps({"doc_id": "D", "filename": "d.txt", "pages": []}))
    assert [r.chunk_id for r in sd.read_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()] == ["D:p1:c0", "D:p1:c1"]
    manifest = sd.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert sd.read_parsed(spark, str(tmp_path), manifest).first().title == "T"


def test_stream_of_lines_has_two_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.jsonl", [GOOD, "broken", GOOD | {"event_type": "weird"}])
    st.validate_stream(st.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "valid"), str(tmp_path / "rejected"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "valid")).count() == 1 and spark.read.json(str(tmp_path / "rejected")).count() == 2


def _stream(spark, tmp_path):
    lake = view.lake(spark, SF).withColumn("ts", F.col("timestamp").cast("timestamp"))
    lake.union(lake.limit(50)).repartition(2).write.parquet(str(tmp_path / "events"))
    return lake, spark.readStream.schema(lake.schema).parquet(str(tmp_path / "events"))


def _run(df, tmp_path, spark, name, **trigger):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_stream_deduplicates_and_counts_in_windows(spark, tmp_path):
    lake, stream = _stream(spark, tmp_path)
    assert _run(st.deduplicated(stream, "40 days"), tmp_path, spark, "firsts").count() == lake.count()
    batch = {(r.start, r.event_type): r.events for r in st.windowed(spark.read.parquet(str(tmp_path / "events")), "1 day").collect()}
    live = {(r.start, r.event_type): r.events for r in _run(st.windowed(stream, "1 day", "1 hour"), tmp_path, spark, "days").collect()}
    assert live and all(batch[k] == n for k, n in live.items())


def test_keyed_state_equals_the_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lake = m.queries(view.lake(spark, SF)).withColumn("ts", F.col("timestamp").cast("timestamp"))
    lake.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(lake.schema).parquet(str(tmp_path / "events"))
    got = {r.event_id: r.previous_language for r in _run(st.previous_language(stream), tmp_path, spark, "sessions", once=True).collect()}
    want = {r.event_id: r.lag_language for r in m.with_previous_language(lake).collect()}
    assert got == want


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 7)):
        (tmp_path / name).write_text("".join("\n" if i % 10 == 3 else f"{i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        lines = se.read_events_jsonl(spark, str(tmp_path))
        assert lines.groupBy(F.spark_partition_id()).count().count() > 1
        got = sorted((r.source_file, r.line_number, r.line) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, i, str(i)) for name, n in (("a.jsonl", 4000), ("b.jsonl", 7)) for i in range(1, n + 1) if i % 10 != 3)


def test_metrics_have_a_manifest(spark, tmp_path):
    table = spark.createDataFrame([("all", 1), ("all", 2), ("live", 1)], "environment string, n long")
    se.write_metrics({"x": table, "none": table.limit(0)}, str(tmp_path / "m"))
    assert {(r.name, r.environment, r.rows, r.schema_version) for r in se.read_metrics_manifest(spark, str(tmp_path / "m")).collect()} == {("x", "all", 2, "1.0"), ("x", "live", 1, "1.0")}


def test_questions_and_reports(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps([{"question_id": "Q1", "question": "x?", "language": "kn", "acceptable_answer_points": ["a", "b"], "source_documents": [{"document_id": "D", "page": 2}], "answer_available": True}, {"question_id": "Q2"}]))
    one, two = sd.read_questions(spark, str(tmp_path / "gold.json")).orderBy("question_id").collect()
    assert one.acceptable_answer_points == ["a", "b"] and one.source_documents[0].page == 2 and one.answer_available and two.question is None
    se.write_report(spark.createDataFrame([("insert", 3)], "action string, chunks long"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.schema("action string, chunks long").json(str(tmp_path / "report")).collect()] == [("insert", 3)]


def test_a_batch_that_is_run_again_leaves_one_copy(spark, tmp_path):
    lines = spark.createDataFrame([("f", 0, json.dumps(x) if isinstance(x, dict) else x) for x in (GOOD, GOOD | {"telemetry_environment": "test"}, GOOD | {"telemetry_environment": ""}, "broken", GOOD | {"event_type": "weird"})], "source_file string, line_number int, line string")
    write = st.recorder(str(tmp_path / "valid"), str(tmp_path / "rejected"), "live")
    for batch_id in (0, 0, 1):
        write(lines, batch_id)
    rows = [json.loads(r.line) | {"batch": r.batch_id} for r in spark.read.json(str(tmp_path / "valid")).collect()]
    assert sorted((r["batch"], r["telemetry_environment"]) for r in rows) == [(b, x) for b in (0, 1) for x in ("live", "live", "test")]
    assert {k: v for k, v in rows[0].items() if k not in ("telemetry_environment", "batch")} == {k: v for k, v in GOOD.items() if k != "telemetry_environment"}
    assert spark.read.json(str(tmp_path / "rejected")).count() == 4
    with pytest.raises(ValueError):
        st.stamped(lines, "prod")
    kept = {r.line for r in st.stamped(lines, "live").collect()}
    assert "broken" in kept


def test_a_run_replaces_the_lake(spark, tmp_path):
    lake = view.lake(spark, SF).select("event_id", "telemetry_environment", "date", "event_type")
    for part, whole, left in (("live", True, {"live"}), ("test", True, {"test"}), ("live", False, {"live", "test"})):
        se.write_lake(lake.filter(F.col("telemetry_environment") == part), str(tmp_path / "lake"), whole)
        assert {r.telemetry_environment for r in spark.read.parquet(str(tmp_path / "lake")).select("telemetry_environment").distinct().collect()} == left


def test_state_is_carried_from_run_to_run(spark, tmp_path):
    events = [("s", f"e{i}", language, i) for i, language in enumerate(("en", "hi", "kn", "te", "en"))] + [("t", "f0", "hi", 0)]
    rows = spark.createDataFrame(events, "session_id string, event_id string, language string, at int").selectExpr("session_id", "event_id", "language", "timestamp_seconds(at) AS ts", "least(2, at DIV 2) AS lot")
    with streams._rocksdb(spark):
        folder = streams.arriving(rows, "carried", lambda stream, f: streams._appended(st.previous_language(stream), f, once=True))
    assert {(r.event_id, r.previous_language) for r in spark.read.parquet(f"{folder}/out").collect()} == {("e0", None), ("e1", "en"), ("e2", "hi"), ("e3", "kn"), ("e4", "te"), ("f0", None)}


def test_last_languages_are_carried_by_one_join_a_batch(spark):
    events = [("s", f"e{i}", language, i) for i, language in enumerate(("en", "hi", "kn", "te", None, "en"))] + [("t", "f0", "hi", 0), ("t", "f1", "en", 5)]
    rows = spark.createDataFrame(events, "session_id string, event_id string, language string, at int").selectExpr("session_id", "event_id", "language", "timestamp_seconds(at) AS ts", "least(2, at DIV 2) AS lot")
    folder = streams.arriving(rows, "carried", lambda stream, f: st.carried_language(stream, f"{f}/out", f"{f}/last", f"{f}/state"))
    assert {(r.event_id, r.previous_language) for r in spark.read.parquet(f"{folder}/out").collect()} == {("e0", None), ("e1", "en"), ("e2", "hi"), ("e3", "kn"), ("e4", "te"), ("e5", None), ("f0", None), ("f1", "hi")}


def test_an_arriving_lot_is_many_files(spark, monkeypatch):
    rows = spark.range(0, 3 * streams.FILE_ROWS, 1, 1).withColumn("lot", F.lit(0))
    folder = streams.arriving(rows, "files", lambda stream, f: stream.writeStream.format("noop").option("checkpointLocation", f"{f}/state").trigger(availableNow=True).start())
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) >= 3
    made, recorder = [], st.recorder
    monkeypatch.setattr(st, "recorder", lambda *a: made.append(a) or recorder(*a))
    streams.recorded(spark, SF)
    assert len(made) == streams.LOTS + 1


def test_a_stamp_leaves_the_text_of_the_other_fields(spark):
    kept = ['{"telemetry_environment":"test","a":1.50}', '{"telemetry_environment":5}', "[1]", "{broken", '{"a":1,"a":2}', "5", "", None]
    changed = {
        ' {"a": 1.50, "b": {"telemetry_environment": ""}} ': '{"telemetry_environment":"live","a": 1.50, "b": {"telemetry_environment": ""}} ', "{ }": '{"telemetry_environment":"live" }', "\t{}": '{"telemetry_environment":"live"}',
        '{"b":1,"\\u0074elemetry_environment":""}': '{"b":1,"telemetry_environment":"live"}', '{"telemetry_environment":null}': '{"telemetry_environment":"live"}',
    }
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate([*kept, *changed])], "source_file string, line_number int, line string")
    assert [r.line for r in st.stamped(lines, "live").orderBy("line_number").collect()] == [*kept, *changed.values()]


def test_escaped_strings_are_read_before_they_are_judged(spark):
    notes = {"write to a\\u0040b.org": "note: sensitive", "\\u0041IzaSyA1234567890abcdefghijklmnopqrstuv": "note: sensitive", "x" * 199 + "\\n\\t": "note: too long", "x" * 198 + "\\n\\t": None, "é" * 201: "note: too long", "é" * 200: None, "call 987654321": None, "\\u0039876543210": "note: sensitive", "a@b": None}
    rows = [("f", i, json.dumps(GOOD)[:-1] + f', "note": "{n}"}}') for i, n in enumerate(notes)]
    found = e.validate(spark.createDataFrame(rows, "source_file string, line_number int, line string")).orderBy("line_number")
    assert [r.reason for r in found.collect()] == list(notes.values())
