import datetime as dt
import json

import pytest
from gleaner.sources import files as S
from gleaner.sources.store import Store, changed, check_schema, check_vectors, from_columns, parse_space, requested_spaces
from gleaner.streaming import events as E
from pyspark.sql import functions as F


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "point_id string, text string, content_hash string")


def test_store_upserts_deletes_and_validates(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = points(spark, ("a", "1", "h1"), ("b", "2", "h2"))
    assert store.create("points", first.schema) and not store.create("points", first.schema) and not store.has_points("points")
    store.upsert("points", first)
    store.upsert("points", points(spark, ("b", "3", "h3"), ("c", "4", "h4")))
    read = lambda: sorted((r["point_id"], r["text"]) for r in store.read("points").collect())
    assert read() == [("a", "1"), ("b", "3"), ("c", "4")]
    store.update("points", spark.createDataFrame([("a", "new"), ("c", None)], "point_id string, text string"))
    store.delete("points", spark.createDataFrame([("b",)], "point_id string"))
    assert read() == [("a", "new"), ("c", "4")] and store.has_points("points")
    assert store.scroll("points", F.col("point_id") == "a", ("text",), 5).collect()[0]["text"] == "new"
    with pytest.raises(ValueError, match="content_hash"):
        store.create("points", first.drop("content_hash").schema)
    with pytest.raises(ValueError, match="'text' is string, not int"):
        check_schema(first.schema, spark.createDataFrame([], "point_id string, text int, content_hash string").schema)
    with pytest.raises(FileNotFoundError):
        store.read("nothing")
    assert store.load("bulk", first) == 2
    with pytest.raises(ValueError, match="exists"):
        store.load("bulk", first)


def test_changed_also_sees_new_spaces(spark):
    old = spark.createDataFrame([("a", "s1", "h")], "point_id string, space string, content_hash string")
    now = spark.createDataFrame([("a", "s1", "h"), ("a", "s2", "h"), ("b", "s1", None)], "point_id string, space string, content_hash string")
    assert sorted((r["point_id"], r["space"]) for r in changed(now, old, ("point_id", "space")).collect()) == [("a", "s2"), ("b", "s1")]


def test_spaces(spark):
    assert parse_space("math__qwen3") == ("math", "qwen3", 1024, True)
    assert requested_spaces(["ctx__hashed", "com__jinacode", "ctx__hashed"]) == ["ctx__hashed", "com__jinacode"]
    with pytest.raises(ValueError, match="nope"):
        requested_spaces(["ctx__nope"])
    vectors = spark.createDataFrame([("p", "ctx__hashed", [1.0] * 63)], "point_id string, space string, embedding array<double>")
    with pytest.raises(ValueError, match="ctx__hashed"):
        check_vectors(vectors, ["ctx__hashed"])


def test_columnar_export(spark):
    schema = "ids array<string>, documents array<string>, metadatas array<string>, embeddings array<array<double>>"
    good = spark.createDataFrame([(["a", "b"], ["x", "y"], ["m", "n"], [[1.0], [2.0]])], schema)
    assert [(r["point_id"], r["embedding"]) for r in from_columns(good).collect()] == [("a", [1.0]), ("b", [2.0])]
    with pytest.raises(Exception, match="differ in length"):
        from_columns(spark.createDataFrame([(["a"], [], ["m"], [[1.0]])], schema)).collect()
    with pytest.raises(ValueError, match="embeddings"):
        from_columns(good.drop("embeddings"))


def test_papers_and_sources(spark, tmp_path):
    (tmp_path / "one.md").write_text(" text one\n")
    (tmp_path / "one.json").write_text(json.dumps({"math_terms": ["kernel"], "section": "Intro"}))
    (tmp_path / "two.md").write_text("text two")
    (tmp_path / "empty.md").write_text(" \n")
    got = sorted((r["text"], r["section"], r["math_terms"], r["source"]) for r in S.papers(spark, str(tmp_path)).collect())
    assert got == [("text one", "Intro", ["kernel"], ""), ("text two", "two", [], "")]
    with pytest.raises(FileNotFoundError):
        S.papers(spark, str(tmp_path / "missing"))
    package = tmp_path / "src" / "pkg"
    (package / "sub").mkdir(parents=True)
    (package / "a.py").write_text("x")
    (package / "sub" / "b.py").write_text("y")
    (tmp_path / "src" / "tests").mkdir()
    (tmp_path / "src" / "tests" / "t.py").write_text("z")
    assert sorted(r["source"] for r in S.source_files(spark, str(package)).collect()) == ["x", "y", "z"]
    (tmp_path / "lexicon.json").write_text('["finite difference", "rbf"]')
    assert [r["term"] for r in S.lexicon(spark, str(tmp_path / "lexicon.json")).orderBy("position").collect()] == ["finite difference", "rbf"]


def test_event_log_round_trip_and_fold(spark, tmp_path):
    log = str(tmp_path / "log")
    event = lambda q, e, text: spark.createDataFrame([(q, e, text)], "query_id string, event string, t string").select("query_id", "event", F.struct(F.col("t").alias("query_text")).alias("payload"))
    for q, e, text in (("q1", "retrieval", "one"), ("q1", "execution", "two"), ("q1", "retrieval", "three"), ("q2", "retrieval", "four")):
        E.append_events(event(q, e, text), log)
    strict = S.event_log(spark, log)
    assert strict.count() == 4 and strict.filter("ts is null").count() == 0
    got = {(r["query_id"], r["event"]): r["payload"]["query_text"] for r in E.fold(strict).collect()}
    assert got == {("q1", "retrieval"): "three", ("q1", "execution"): "two", ("q2", "retrieval"): "four"}
    assert E.folded(strict, ["retrieval", "execution"]).count() == 2
    (tmp_path / "log" / "bad.txt").write_text('\n{"query_id": \nnot json\n{"event": "retrieval", "ts": "2024-01-01T00:00:00+00:00"}\n')
    loose = S.event_log(spark, log, strict=False)
    assert loose.count() == 4 and loose.filter("plan = 'unknown' and query_text = ''").count() == 1


@pytest.mark.parametrize("size", [1_000_000, 2])
def test_sessions_labels_and_modes(spark, monkeypatch, size):
    monkeypatch.setattr(E, "RANGE", size)
    day = dt.datetime(2024, 1, 1, 23, 59, 0)
    offsets = [0, 60, 121, 121, 300, 86_500, 86_560]
    rows = [(f"q{i}", f"Query {i}", day + dt.timedelta(seconds=s), "xxyzxyy"[i]) for i, s in enumerate(offsets)]
    events = spark.createDataFrame(rows, "query_id string, query_text string, ts timestamp, item string")
    found = E.sessions(events, 60, tie="query_id")
    assert [r["session_id"] for r in found.orderBy("ts", "query_id").collect()] == [0, 0, 1, 1, 2, 3, 3]
    assert [r["session_id"] for r in E.sessions(events.withColumn("k", F.lit(1)), 60, "k", tie="query_id").orderBy("ts", "query_id").collect()] == [0, 0, 1, 1, 2, 3, 3]
    firsts = E.first_events(found)
    registry = spark.createDataFrame([("q0", "kept")], "session_key string, label string")
    labels = {r["session_key"]: (r["label"], r["is_new"]) for r in E.labels(firsts, registry).collect()}
    assert labels["q0"] == ("kept", False) and labels["q2"] == ("query-2_01-02_0001", True)
    modes = {r["session_id"]: (r["item"], r["n"]) for r in E.most_appearing(E.appearances(found, "item"), "item").collect()}
    assert modes == {0: ("x", 2), 1: ("y", 1), 2: ("x", 1), 3: ("y", 2)}
    assert E.sessions(events.limit(0), 60).collect() == []


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    schema = "point_id string, text string, content_hash string"
    points(spark, ("a", "1", "h1"), ("a", "1", "h1"), ("b", "2", "h2")).write.parquet(str(source))
    store = Store(spark, str(tmp_path / "store"))
    for rows in (None, points(spark, ("b", "2b", "h3"), ("a", "1", "h1"))):
        if rows is not None:
            rows.write.mode("append").parquet(str(source))
        E.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, "points", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["point_id"], r["text"]) for r in store.read("points").collect()) == [("a", "1"), ("b", "2b")]
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("q", day + dt.timedelta(seconds=s)) for s in (0, 30, 200)], "query_id string, ts timestamp").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("query_id string, ts timestamp").parquet(str(tmp_path / "ev"))
    E.session_stream(stream, 60).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start().awaitTermination()
    assert sorted(r["events"] for r in spark.table("sess").collect()) == [1, 2]


def test_the_last_of_a_key_wins_and_the_layout_stays(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 1, "z")], "point_id string, n int, kind string").coalesce(1)
    store.upsert("t", rows, partition_by=("kind",), order=("n",))
    assert sorted(tuple(r) for r in store.read("t").select("point_id", "n").collect()) == [("a", 3), ("b", 1)]
    store.upsert("t", spark.createDataFrame([("b", 5, "x"), ("b", 4, "x")], "point_id string, n int, kind string").coalesce(1))
    store.delete("t", spark.createDataFrame([("a",)], "point_id string"))
    assert [r["n"] for r in store.read("t").collect()] == [4] and store.layout("t") == ("kind",)
    store.expire("t", 1)
    assert store.read("t").count() == 1
    store.write("none", rows.filter("false"), ("kind",))
    assert store.read("none").columns == ["point_id", "n", "kind"] and not store.has_points("none")


def test_a_stream_prunes_and_labels_stay(spark, tmp_path):
    source = str(tmp_path / "in")
    points(spark, ("a", "1", "h1"), ("b", "2", "h2")).write.parquet(source)
    store = Store(spark, str(tmp_path / "store"))
    now = points(spark, ("a", "", ""))
    E.ingest_stream(spark.readStream.schema("point_id string, text string, content_hash string").parquet(source), store, "points", str(tmp_path / "cp"), current=now).awaitTermination()
    assert [r["point_id"] for r in store.read("points").collect()] == ["a"]
    labelled = spark.createDataFrame([("q1", "one", True), ("q2", "old", False)], "session_key string, label string, is_new boolean")
    assert E.register(labelled, store) == 1 and E.register(labelled, store) == 0
    assert [tuple(r) for r in store.read("labels").collect()] == [("q1", "one")]


def test_limits_keep_file_order_and_summaries_join_by_two_keys(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": f"q{i}", "options": ["a", "b"], "ref": {"n": i}} for i in (5, 3, 9, 1)]))
    schema = "id string, options array<string>, ref struct<n:int>"
    assert [r["id"] for r in S.json_table(spark, str(tmp_path / "q.json"), schema, 3).collect()] == ["q5", "q3", "q9"]
    assert S.json_table(spark, str(tmp_path / "q.json"), schema).count() == 4
    chunks = spark.createDataFrame([("f", None), ("f", "C"), ("g", None)], "function_name string, class_name string")
    told = spark.createDataFrame([("f", None, "alone"), ("f", "C", "method")], "function_name string, class_name string, summary string")
    assert sorted((r["function_name"], r["class_name"] or "", r["summary"]) for r in S.with_summaries(chunks, told).collect()) == [("f", "", "alone"), ("f", "C", "method"), ("g", "", "")]


def test_sessions_are_written_once(spark, tmp_path):
    from gleaner import drivers

    log = tmp_path / "log.jsonl"
    event = lambda q, ts, ids: json.dumps({"query_id": q, "event": "retrieval", "ts": ts, "payload": {"query_text": f"How {q}?", "plan": "hybrid", "candidates": [{"point_id": p, "fused_rank": k, "fused_score": 0.0163934, "leg_scores": {"dense": 0.123456}} for k, p in enumerate(ids)]}})
    log.write_text("\n".join([event("a", "2024-01-01T10:00:00Z", "xyzw"), event("b", "2024-01-01T10:00:30Z", "y"), event("c", "2024-01-01T12:00:00Z", "")]) + "\n")
    read = lambda: S.event_log(spark, str(log), strict=False)
    out = str(tmp_path / "out")
    labels = drivers.write_sessions(spark, read(), out)
    assert labels == ["how-a_01-01_1000", "how-c_01-01_1200"]
    one = json.loads((tmp_path / "out" / labels[0] / "session.json").read_text())
    assert [q["query_id"] for q in one["queries"]] == ["a", "b"] and [c["point_id"] for c in one["queries"][0]["candidates"]] == ["x", "y", "z"]
    assert one["queries"][0]["candidates"][0]["fused_score"] == 0.0164 and one["queries"][0]["candidates"][0]["leg_scores"] == {"dense": 0.1235}
    index = json.loads((tmp_path / "out" / "index.json").read_text())
    assert [(i["label"], i["queries"], i["most_appearing"]) for i in index] == [(labels[0], 2, "y"), (labels[1], 1, None)]
    assert drivers.write_sessions(spark, read(), out) == [] and drivers.write_sessions(spark, read(), out, force=True) == labels
