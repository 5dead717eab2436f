"""Sources, sinks and streams."""

import json
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from cardloom.functions import register
from cardloom.operators.cards import parse_cards
from cardloom.operators.chunker import chunk
from cardloom.sources.readers import Options, direct_text, layered, load_options, page_text, preset_name, queue_stream, read_files
from cardloom.sources.samples import sample_uploads
from cardloom.sources.sinks import append_cards, append_rows, create_tables, enqueue, export_csv, export_json
from cardloom.streaming.progress import Gate, live_progress, status_counts
from cardloom.streaming.rates import burst_rates


def test_options(tmp_path):
    (tmp_path / "settings.json").write_text(json.dumps({"batch_size": 12, "top_k": 7, "other": 1}))
    (tmp_path / "settings.big.json").write_text(json.dumps({"batch_size": 6}))
    got = load_options(str(tmp_path), "b!ig")
    assert (got.batch_size, got.top_k, got.top_p) == (6, 7, 0.9)
    assert load_options(str(tmp_path / "none")) == Options() and Options().context == 160 + 1024 * 4
    assert preset_name("../a b-1.2_x") == "..ab-1.2_x"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\ntwo".encode())
    (tmp_path / "b.HTML").write_text("<p>x</p>")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.pdf").write_bytes(b"p")
    got = {r.file_id: r.content for r in read_files(spark, str(tmp_path), strip_html=True, pdf=lambda b: [["t", "u"]]).collect()}
    assert got == {"a.txt": "one\ntwo", "b.HTML": "\r\nx", "d.pdf": "t\n\nu\n\n---\n"}
    assert page_text([]) == ""


def test_direct_text(spark):
    df = spark.sql("SELECT ' x ' AS t, cast(null AS string) AS n, timestamp'2024-01-02 03:04:05.678' AS at")
    content, name = direct_text(F.col("t"), F.col("n"), F.col("at"))
    assert tuple(df.select(content, name).head()) == ("x", "text_input_2024-01-02T03-04-05-678Z.txt")


def test_tables_and_exports(spark, tmp_path):
    create_tables(spark, str(tmp_path))
    create_tables(spark, str(tmp_path))
    chunks = spark.createDataFrame([("c", 0, 1, "f", None)], "content string, start_position int, end_position int, file_id string, extra_context string")
    written = append_rows(chunks, f"{tmp_path}/text_chunks.parquet", ["content"], 4)
    assert [r.id for r in written.collect()] == [5]
    held = spark.read.parquet(f"{tmp_path}/text_chunks.parquet")
    cards = spark.createDataFrame([('a"q\nz', "b", 5)], "question string, answer string, origin_id long")
    append_cards(cards, held, f"{tmp_path}/flash_cards.parquet", 0)
    try:
        append_cards(cards.withColumn("origin_id", F.lit(6)), held, f"{tmp_path}/flash_cards.parquet", 0)
        raise AssertionError("a lost reference must not be written")
    except ValueError:
        pass
    stored = spark.read.parquet(f"{tmp_path}/flash_cards.parquet")
    export_csv(stored, held, f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == 'Question,Answer,FileId\n"a""q\nz","b","f"\n'
    parsed = parse_cards(spark.createDataFrame([(1, 'Q: a"q\nz\nA: b')], "id long, response string"), "response", ["id"])
    chunks = spark.createDataFrame([(1, "text", 0, 4, "f", None)], "id long, content string, start_position int, end_position int, file_id string, extra_context string")
    export_json(parsed, chunks, ["id"], "id", f"{tmp_path}/json")
    line = next((tmp_path / "json").rglob("part-*")).read_text()
    origin = {"Id": 1, "Content": "text", "StartPosition": 0, "EndPosition": 4, "FileId": "f", "ExtraContext": None}
    assert json.loads(line) == [{"Id": 0, "Question": 'a"q\nz', "Answer": "b", "OriginId": 0, "Origin": origin}]


def test_gate_holds_and_releases(spark, tmp_path):
    now, out = [0.0], []
    make = lambda **more: Gate(str(tmp_path / "pending"), lambda df: out.append(sorted(r.id for r in df.collect())), 8, 90, lambda: now[0], **more)
    held = make()
    held(spark.range(0, 5), 0)
    held(spark.range(0, 5), 0)  # the same batch again
    assert out == []
    now[0] = 91
    again = make()  # after a restart nothing is forgotten, neither rows nor the wait
    assert again.poll(spark) and out == [[0, 1, 2, 3, 4]] and not again.poll(spark)
    again(spark.range(0, 8), 1)
    assert out[1] == list(range(8)) and not again.poll(spark)
    busy = [3]
    full = make(order=("id",), width=3, in_flight=lambda: busy[0])
    full(spark.range(0, 9), 2)
    assert out[2] == [0, 1, 2]  # room for twice three less what is in work
    busy[0] = 6
    now[0] += 200
    assert not full.poll(spark)
    busy[0] = 0
    assert full.poll(spark) and out[3] == [3, 4, 5, 6, 7, 8]


def test_gate_watches_the_clock(spark, tmp_path):
    out, stop = [], threading.Event()
    held = Gate(str(tmp_path / "pending"), lambda df: out.append(df.count()), 8, 0.2)
    held(spark.range(0, 2), 0)
    thread = held.watch(spark, stop, 0.1)
    until = time.time() + 30
    while not out and time.time() < until:
        time.sleep(0.1)
    stop.set()
    thread.join(10)
    assert out == [2]


def test_queue_stream(spark, tmp_path):
    schema = "chunk_id long, seq long, token string, rewind_chars int, status string"
    rows = [(1, 0, "ab", 0, None), (1, 1, "cd", 0, None), (1, 2, "", 3, None), (1, 3, "Z", 0, None), (1, 3, "Z", 0, None), (2, 0, "x", 0, None)]
    enqueue(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "in"))
    seen = {}
    stream = live_progress(queue_stream(spark, str(tmp_path / "in"), schema), timeout_ms=60_000)

    def each(batch, _):
        seen.update({r.chunk_id: r.text for r in batch.collect()})

    query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 40
    while len(seen) < 2 and time.time() < until:  # state with timeouts keeps a stream busy, so it is never done by itself
        time.sleep(0.3)
    query.stop()
    assert seen == {1: "aZ", 2: "x"}


def test_status_and_rates(spark):
    work = spark.createDataFrame([("Queued", 0, None, 0), ("done", 2, 10, 0), ("done", 0, 5, 3)], "status string, n_cards long, n_tokens long, s long").withColumn("at", F.timestamp_seconds("s"))
    assert tuple(status_counts(work).head()) == (1, 1, 15, 5.0)
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 05:00:00"])
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 1], "at": at, "n": [5, 15, 7]}))
    got = sorted((r.n_tokens, r.tokens_per_second) for r in burst_rates(df, "k", "at", "n", "1 hour").collect())
    assert got == [(7, None), (20, 2.0)]


def test_registered_for_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "<p>A.", "A.\n\nB.\n"), (2, None, None)], "id long, page string, t string").createOrReplaceTempView("told")
    assert spark.sql("SELECT html_to_text(page) AS x FROM told WHERE id = 1").head().x == "\r\nA."
    assert [tuple(r) for r in spark.sql("SELECT id, c.content, c.end_position FROM told, LATERAL chunk_text(t) c").collect()] == [(1, "A.B.", 4)]
    assert [r.line for r in spark.sql("SELECT l.line FROM told, LATERAL text_lines(t) l ORDER BY line_no").collect()] == ["A.", "", "B."]
    assert [tuple(r) for r in spark.sql("SELECT c.question, c.answer FROM VALUES ('Q: a\nA: b') AS v(t), LATERAL parse_cards(t) c").collect()] == [("a", "b")]


def test_samples_and_layers(spark):
    rows = chunk(sample_uploads(spark), "content", ["file_id"]).collect()
    assert {r.file_id for r in rows} == {"notes.txt", "words.txt"}
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r.m for r in df.select(layered(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": "1", "b": "2"}, {}]
