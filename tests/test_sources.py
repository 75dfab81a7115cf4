"""Text files, offsets, sequence files, metadata and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bhashaloom.logs import log_to, logger
from bhashaloom.operators.stats import corpus_statistics
from bhashaloom.plans.loading import Loader
from bhashaloom.sources import metadata as D
from bhashaloom.sources import sequences as Q
from bhashaloom.sources import text as T
from bhashaloom.streaming import lines as R


def test_lossy_lines(spark, tmp_path):
    (tmp_path / "Hindi.txt").write_bytes(b"a\xff\xe0\xa4x\none\r\ntwo\rthree")
    (tmp_path / "notes.md").write_text("no")
    got = [(r["lang"], r["line"]) for r in T.read_lines(spark, str(tmp_path)).collect()]
    assert got == [("Hindi", "ax"), ("Hindi", "one"), ("Hindi", "two"), ("Hindi", "three")]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_offsets(spark, tmp_path, size):
    content = "a\n\nbकc\nlast".encode()
    (tmp_path / "x.txt").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = sorted((r["offset"], r["line"]) for r in T.line_offsets(spark, str(tmp_path)).collect())
        places = [r["line"] for r in T.read_numbered(spark, str(tmp_path)).orderBy("place").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, "a"), (2, ""), (3, "bकc"), (9, "last")] and places == [x for _, x in got]
    some = spark.createDataFrame([("x.txt", 3), ("x.txt", 3)], "file_name string, offset long")
    assert [r["line"] for r in T.lines_at(T.line_offsets(spark, str(tmp_path)), some).collect()] == ["bकc"]


def test_missing_inputs(spark, tmp_path, caplog):
    there = str(tmp_path)
    T.require(spark, [there])
    with pytest.raises(FileNotFoundError):
        T.require(spark, [there, f"{there}/none"])
    assert T.present(spark, [there, f"{there}/none"]) == [there] and "none" in caplog.text
    (tmp_path / "hindi_0_train.bin").write_bytes(bytes(16))
    assert Q.read_sequences(spark, there, 4, "_train.bin", "hin").count() == 2
    with pytest.raises(ValueError):
        Q.read_sequences(spark, there, 4, "_train.bin", "odia")


def test_logs(tmp_path):
    log_to(str(tmp_path / "run.log"), console=False)
    logger("test").info("a line")
    log_to(None, console=False)
    assert "bhashaloom.test - INFO - a line" in (tmp_path / "run.log").read_text()


def test_loader(spark):
    rows = [(s, g, i, [i]) for s, n in (("train", 5), ("test", 3)) for g in ("a", "b") for i in range(n)]
    frame = spark.createDataFrame(rows, "split_name string, lang string, seq_id long, tokens array<int>")
    loader = Loader(frame, 2)
    assert loader.languages() == ["a", "b"] and len(loader) == 5
    ids = lambda f: [r["seq_id"] for r in f.orderBy("slot").collect()]
    assert ids(loader.language_batch("a")) == [0, 1]
    loader.switch_mode("test")
    assert ids(loader.language_batch("a")) == [0, 1] and len(loader) == 3
    state = loader.state()
    loader.switch_mode("train")
    assert [ids(loader.language_batch("a")) for _ in range(3)] == [[2, 3], [4], [0, 1]]
    with pytest.raises(ValueError):
        loader.language_batch("c")
    with pytest.raises(ValueError):
        loader.batch_of("none")
    assert loader.mode == "train" and loader.next_batch().count() == 2 and loader.batch_of("test").count() == 2 and loader.mode == "train" and loader.position == 2
    again = Loader(frame, 2)
    again.resume(state)
    assert again.mode == "test" and ids(again.language_batch("a")) == [2]
    again.position = 3
    with pytest.raises(StopIteration):
        again.next_batch()


def test_existing_and_writing(spark, tmp_path):
    frame = spark.createDataFrame([("a", "one"), ("b", "two")], "lang string, text string")
    T.write_lines(frame, "text", str(tmp_path / "out"), "lang")
    assert T.existing(spark, [str(tmp_path / "out"), str(tmp_path / "none")]) == ([str(tmp_path / "out")], [str(tmp_path / "none")])
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "out")).select("lang", "value").collect())) == [("a", "one"), ("b", "two")]
    report = T.statistics_report(corpus_statistics(frame, "lang", "text"), "lang").where("lang = 'a'").first()["report"]
    assert "Lines: 1" in report and "Language: A" in report


def test_sequences(spark, tmp_path):
    rows = [("a", [i, 50303, i + 1, 0]) for i in range(10)] + [("b", [1, 2, 3, 4])]
    frame = spark.createDataFrame(rows, "lang string, tokens array<int>").repartition(3)
    Q.write_sequences(frame, str(tmp_path / "s"), "_train.bin")
    with open(tmp_path / "s" / "a_9999999_train.bin", "wb") as f:
        np.array([7, 7, 7, 7, 9], "<u2").tofile(f)  # a whole sequence and a partial one
    got = sorted((r["lang"], r["tokens"]) for r in Q.read_sequences(spark, str(tmp_path / "s"), 4, "_train.bin").collect())
    assert got == sorted([(g, t) for g, t in rows] + [("a", [7, 7, 7, 7])])


def test_metadata(spark, tmp_path):
    lines = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "lang string, split string")
    made = D.dataset_metadata(lines, lines, "lang", "split")
    assert made["languages"]["a"] == {"total_lines": 2, "train_lines": 1, "test_lines": 1} and made["sequence_counts"]["train"] == {"a": 1, "b": 1}
    D.write_metadata(spark, made, str(tmp_path / "m"))
    assert D.read_metadata(spark, str(tmp_path / "m")) == made
    (tmp_path / "r1.json").write_text('{"iter": 1, "loss/iter": 2.5}')
    (tmp_path / "r2.json").write_text('{"iter": 2, "lr": 0.1}')
    runs = D.read_runs(spark, str(tmp_path / "r*.json")).orderBy("iter").select("`loss/iter`", "lr").collect()
    assert [tuple(r) for r in runs] == [(2.5, None), (None, 0.1)]


def test_stream(spark, tmp_path):
    rows = [("x", "the same line", "2025-01-01 00:00:00"), ("x", "the  same line", "2025-01-01 00:10:00"), ("x", "another line", "2025-01-01 00:20:00"), ("x", "no", "2025-01-01 00:30:00")]
    frame = spark.createDataFrame(rows, "lang string, line string, at string").withColumn("at", F.to_timestamp("at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = R.stream_lines(spark, str(tmp_path / "in"), "lang string, line string, at timestamp")
    R.to_table(R.clean_stream(stream, "line", "lang", "at"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["another line", "the same line"]
    counts = R.windowed_counts(stream, "lang", "at")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n_lines"] for r in spark.table("counts").collect()] == [4]
