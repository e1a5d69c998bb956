"""Readers, sinks and the streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from proselake.operators import choices, dataset, detectors, grading, grammar
from proselake.sources import files, readers
from proselake.streaming import twins


def test_jsonl(spark, tmp_path):
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    p = tmp_path / "rows.jsonl"
    p.write_text('{"text":"Tea.","label":1}\n\n{"text":"Cup.","label":0}\n')
    rows = readers.read_jsonl(spark, str(p))
    assert rows.count() == 2
    out = str(tmp_path / "out")
    readers.write_jsonl(rows, out)
    readers.append_new(spark.createDataFrame([("tea.", 1), ("Pot.", 0)], "text string, label int"), out)
    assert {r["text"] for r in readers.read_jsonl(spark, out).collect()} == {"Tea.", "Cup.", "Pot."}


def test_seeds_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One line.\n\n Two line. \n")
    (tmp_path / "b.txt").write_text("one LINE.\nThree.")
    assert [tuple(r) for r in readers.read_seeds(spark, str(tmp_path)).orderBy("file", "line").select("source", "sentence").collect()] == [("a", "One line."), ("a", "Two line."), ("b", "Three.")]
    assert readers.read_documents(spark, str(tmp_path)).count() == 2


def test_scenarios_results_fingerprint(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"id":"bait_1","user_turns":["a","b"]}\n{"id":"other_1","user_turns":["a"]}\n')
    assert readers.read_scenarios(spark, str(p), "bait").count() == 1
    readers.check_scenarios(readers.read_scenarios(spark, str(p)))
    dump = tmp_path / "d.jsonl"
    dump.write_text(json.dumps({"_scen": readers.fingerprint(spark, str(p))}) + '\n{"id":"bait_1","replies":["x"]}\n')
    assert readers.is_fresh(spark, str(dump), str(p)) and readers.read_replies(spark, str(dump)).count() == 1
    p.write_text("{}\n")
    assert not readers.is_fresh(spark, str(dump), str(p))
    d = tmp_path / "r" / "x"
    d.mkdir(parents=True)
    (d / "results_1.json").write_text(json.dumps({"results": {"t": {"acc,none": 0.5, "alias": "t"}}, "group_subtasks": {"g": ["t"]}}))
    assert readers.latest_results(spark, str(tmp_path / "r")).first()["metrics"]["acc,none"] == 0.5
    assert [r["task"] for r in readers.result_leaves(spark, str(tmp_path / "r")).collect()] == ["t"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, t, x) for t, x in enumerate(["The red lamp fell. Rain came.", "the RED lamp  fell. rain came.", "The red lamp fell again."])]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(str(src))

    q = twins.deduplicated(stream).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(str(src)).select(dataset.T.dedup_key("text").alias("k")).distinct().count()
    assert spark.table("kept").count() == batch == 2

    q = twins.phrase_counts(stream).writeStream.format("memory").queryName("phrases").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = detectors.repeated_phrases(spark.read.parquet(str(src)), min_n=3, max_n=3, least_content=0, in_last=False)
    assert {r["phrase"]: r["n_messages"] for r in spark.table("phrases").collect()} == {r["phrase"]: r["n_messages"] for r in want.collect()}

    seen = []
    twins.run_batches(stream, str(tmp_path / "ck"), lambda b, k: seen.append(b.count()) or len(seen) == 2).awaitTermination()
    assert len(seen) == 2
    twins.append_resumable(stream, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    twins.append_resumable(stream, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_sql_functions(spark):
    grammar.register(spark)
    r = spark.sql("""SELECT block_spans('a "b"') AS b, contrast('It is not a lamp, but a lantern.') AS c""").first()
    assert [x["type"] for x in r["b"]] == ["NARRATION", "SPEECH"] and r["c"] == "DET NOUN / DET NOUN"


def test_opener_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'He ran. He hid.' AS text").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, text string").parquet(src)
    q = twins.opener_windows(stream, "ts", "text").writeStream.format("memory").queryName("ow").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["opener"], r["n"]) for r in spark.table("ow").select("opener", F.col("n")).collect()] == [("he", 2)]


def test_pairs_labels_predictions(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", "pair_1", "s", "neg", None)], readers.PAIR)
    for name in ("warm_pairs.jsonl", "curated_warm_pairs.jsonl", "warm.jsonl"):
        readers.write_jsonl(pairs, str(tmp_path / name))
    assert {r["file"] for r in readers.read_pairs(spark, str(tmp_path)).collect()} == {"warm", "curated_warm"}
    assert readers.read_pairs(spark, str(tmp_path / "none")).count() == 0
    readers.write_predictions(spark.createDataFrame([("x y", 0.75), ("z", 0.5)], "text string, score double"), str(tmp_path / "p"), 0.6)
    assert {r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()} == {"0.7500\t1\tx y", "0.5000\t0\tz"}


def test_attempts_are_resumed(spark, tmp_path):
    kept, tried = str(tmp_path / "kept"), str(tmp_path / "tried")
    rows = lambda *r: spark.createDataFrame(r, "group_id string, status string, pos string")
    first = rows(("a", "accepted", "x"), ("b", "rejected", "y"), ("c", "error", None))
    readers.record_attempts(first, kept, tried)
    readers.record_attempts(first, kept, tried)  # a run that is repeated writes nothing twice
    assert sorted(r["group_id"] for r in readers.read_attempted(spark, tried).collect()) == ["a", "b"]
    seeds = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "group_id string")
    left = dataset.remaining(seeds, readers.read_jsonl(spark, kept, "group_id string"), readers.read_attempted(spark, tried))
    assert sorted(r["group_id"] for r in left.collect()) == ["c", "d"]
    # a run that ended after the kept rows: the key isn't kept again, and is told as attempted
    readers.write_jsonl(rows(("c", "accepted", "z")).drop("status"), kept, "append")
    readers.record_attempts(rows(("c", "accepted", "z")), kept, tried)
    assert readers.read_jsonl(spark, kept, "group_id string").where("group_id = 'c'").count() == 1
    assert readers.read_attempted(spark, tried).where("group_id = 'c'").count() == 1


def test_files(spark, tmp_path):
    root = str(tmp_path)
    assert files.preferred(spark, root, ("a", files.write_file(spark, root + "/b", "x").rsplit("/", 1)[1])) == root + "/b"
    rows = spark.createDataFrame([(0, 0.5)], "dim int, d double")
    files.write_artifact(rows, root + "/one", "m", None)
    assert files.read_artifact(spark, root + "/one", "dim int, d double", "m", "first", "first").collect() == rows.collect()
    for model, axis in (("n", "first"), ("m", "second")):
        with pytest.raises(ValueError):
            files.read_artifact(spark, root + "/one", "dim int, d double", model, axis, "first")
    with pytest.raises(FileNotFoundError):
        files.preferred(spark, root, ("none",))


def test_stale_dumps_are_fatal(spark):
    ids = lambda *x: spark.createDataFrame([(i, True) for i in x], "id string, ok boolean")
    grading.require_same(ids("a", "b"), ids("a", "b", "c"), ids("b", "a"))
    with pytest.raises(ValueError, match="without b"):
        grading.require_same(ids("a", "b"), ids("a", "b"), ids("a"))


def test_projection_domain(spark):
    bad = spark.createDataFrame([("other", None, None)], "o string, d string, f string")
    with pytest.raises(Exception, match="no projection"):
        bad.select(choices.projection(*(F.col(c) for c in "odf"))).collect()


# ---- keyed state ----


def _finished(stream, folder, state):
    with state.keyed_state(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_ledger_killed_and_restarted(spark, tmp_path):
    """Attempts in files of overlapping times, a stream that is stopped between them and fails inside one: each key ends once."""
    import datetime as dt
    import random

    from proselake.streaming import ledger, state

    draw, t0, schema = random.Random(3), dt.datetime(2024, 1, 1), "key long, attempt long, at timestamp, outcome string"
    rows = [(draw.randrange(30) if i % 50 else None, i, t0 + dt.timedelta(hours=i * 3 + draw.randrange(10)), draw.choice(["error"] * 7 + ["accepted", "rejected"])) for i in range(300)]
    rows += rows[:20]  # repeated attempts
    last = (None, 10**9, t0 + dt.timedelta(days=400), "error")
    source = str(tmp_path / "in")

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def fails(x):
        raise RuntimeError("killed")

    stream = lambda: ledger.ledger_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    arrive(rows[:100])
    _finished(stream(), tmp_path, state)
    arrive(rows[100:200])
    killed = stream().select("*", F.udf(fails, "string")("status").alias("x"))
    with state.keyed_state(spark):
        q = killed.writeStream.foreachBatch(lambda b, k: b.collect() and None).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination()
    _finished(stream(), tmp_path, state)
    for part in (rows[200:], [last]):
        arrive(part)
    got = sorted(tuple(r) for r in _finished(stream(), tmp_path, state).collect())
    want = sorted(tuple(r) for r in ledger.ledger_batch(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len({g[0] for g in got}) == len(got) == 30
    assert {g[1] for g in got} == {"accepted", "rejected", "expired", "exhausted"}
    _finished(stream(), tmp_path, state)  # nothing new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


TEXTS = [
    'He left. "Stay." She sat.', "One.\n\nTwo", 'He said "no."  \n \n "Yes!" \n\n\n And   then… (so.) it ended', "", None, "  \n \n ", "  a. b. c.  ", 'x." \n\ny', 'x."\n\n"y." z.\n', "No end", "...\n\n... ! ?", "A. B. C.\x0bD",
]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pieces_of_text(size):
    from proselake.streaming import deltas

    for text in TEXTS:
        done, open_ = [], ""
        for k in range(0, len(text or ""), size):
            more, open_ = deltas.closed(open_ + text[k : k + size])
            done += more
        assert done + deltas.sentences_of(open_) == deltas.sentences_of(text or ""), text


def test_sentences_as_they_come(spark, tmp_path):
    """Pieces in any order over several batches, some of them twice."""
    from proselake.streaming import deltas, state

    texts = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    pieces = deltas.in_pieces(texts, size=4).drop("n")
    source = str(tmp_path / "in")
    for part in ("at % 3 = 1", "at = 1", "at % 3 = 0", "at % 3 = 2"):
        pieces.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = deltas.sentence_stream(spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(source))
    got = sorted(tuple(r) for r in _finished(stream, tmp_path, state).collect())
    assert got == sorted(tuple(r) for r in detectors.exploded_sentences(texts, "doc_id", "text").collect())


def test_texts_share_a_value_of_state(spark, tmp_path):
    """Many open texts, those of a shard in one value: frames and calls to the store go by shards."""
    from proselake.streaming import deltas, state

    texts = spark.createDataFrame([(k, f"One {k}. Two {k}. 'Three' {k} and more") for k in range(500)], "doc_id long, text string")
    pieces = deltas.in_pieces(texts, size=5).drop("n")
    source = str(tmp_path / "in")
    for part in ("at % 2 = 0", "at % 2 = 1"):
        pieces.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = deltas.sentence_stream(spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(source), shards=3)
    with state.keyed_state(spark):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(lambda p: json.loads(p.json), q.recentProgress)]
    assert max(seen) == 3
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in detectors.exploded_sentences(texts, "doc_id", "text").collect())


def test_stream_stops_before_its_next_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(5):
        spark.createDataFrame([(k,)] * 3, "n int").coalesce(1).write.mode("append").parquet(source)
    seen, metrics = [], {"rows": F.count(F.lit(1)), "total": F.sum("n")}
    stream = lambda: spark.readStream.schema("n int").option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(twins.Aborted) as told:
        twins.run_bounded(stream(), str(tmp_path / "ck"), lambda b, k: seen.append((k, b.count())), metrics, lambda m: m["total"] / 2 if m["total"] >= 8 else None)
    assert seen == [(0, 3), (1, 3), (2, 3)] and (told.value.value, told.value.batch) == (4.5, 2)
    # started again without a bound, the batches that weren't done follow
    after = twins.run_bounded(stream(), str(tmp_path / "ck"), lambda b, k: seen.append((k, b.count())), metrics, lambda m: None, {"rows": 9, "total": 9})
    assert seen[3:] == [(3, 3), (4, 3)] and after == {"rows": 15, "total": 30}


# ---- lines and predictions ----


def test_line_ranges(spark, tmp_path):
    """Every line is in one range, whatever the ranges' width; hidden files are none."""
    from proselake.sources import lines

    lines.register(spark)
    (tmp_path / "a.txt").write_bytes("one\n\n  twö  \r\nthree three\nend".encode())
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "_c.txt").write_text("no\n")
    for wide in (1, 3, 7, 1000):
        rows = spark.read.format(lines.SOURCE).option("path", str(tmp_path)).option("rangeBytes", wide).load().collect()
        assert sorted((r["offset"], r["text"]) for r in rows) == [(0, "one"), (5, "twö"), (15, "three three"), (27, "end")]
    assert spark.read.format(lines.SOURCE).option("path", str(tmp_path / "none")).load().collect() == []


def test_predictions_of_failed_tasks_leave_nothing(spark, tmp_path):
    from proselake.sources import lines

    lines.register(spark)
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(k / 10, f"text {k}\nmore") for k in range(10)], "score double, text string").repartition(4)
    rows.write.format(lines.SINK).option("path", out).option("threshold", 0.7).mode("append").save()
    read = lambda: sorted(r["text"] for r in spark.read.format(lines.SOURCE).option("path", out).load().collect())
    want = sorted(f"{k / 10:.4f}\t{int(k >= 7)}\ttext {k} more" for k in range(10))
    assert read() == want
    fails = F.udf(lambda t: 1 / 0 if t.startswith("text 9") else t, "string")
    with pytest.raises(Exception):
        rows.select("score", fails("text").alias("text")).write.format(lines.SINK).option("path", out).mode("append").save()
    assert read() == want  # what tasks wrote that were still running then stays in a hidden folder
    rows.limit(3).write.format(lines.SINK).option("path", out).mode("overwrite").save()
    assert len(read()) == 3


def test_lines_as_they_grow(spark, tmp_path):
    """A stream from growing files to the sink, started again after each growth: whole lines only, each once."""
    from proselake.sources import lines

    lines.register(spark)
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()

    def run():
        s = spark.readStream.format(lines.SOURCE).option("path", str(source)).option("rangeBytes", 5).load()
        s = s.select((F.length("text") / 10).alias("score"), "text")
        s.writeStream.format(lines.SINK).option("path", out).option("checkpointLocation", ck).trigger(once=True).start().awaitTermination()
        return sorted(r["text"].split("\t")[2] for r in spark.read.format(lines.SOURCE).option("path", out).load().collect())

    (source / "a").write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    (source / "a").write_text("one\ntwo\nthree\n")
    (source / "b").write_text("four\n")
    assert run() == ["four", "one", "three", "two"]
    assert run() == ["four", "one", "three", "two"]
