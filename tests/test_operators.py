"""Statistics, samples, packing, batches, metrics and arrays on small cases."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from bhashaloom.config import Packing
from bhashaloom.functions.text import language_of_file, shortened
from bhashaloom.operators import arrays as A
from bhashaloom.operators import loader as L
from bhashaloom.operators import metrics as M
from bhashaloom.operators import sample as S
from bhashaloom.operators import tokens as K
from bhashaloom.operators.stats import char_frequencies, corpus_statistics, top_characters
from bhashaloom.plans.ranking import digest_rank, first_by_digest, order_bucket, with_rank
from bhashaloom.plans.skew import hot_keys, salted_join


def test_statistics(spark):
    rows = [(1, "x", "abc"), (2, "x", "  "), (3, "x", None), (4, "x", "ba b. c"), (5, "y", "")]
    frame = spark.createDataFrame(rows, "id long, lang string, line string")
    got = {r["lang"]: r for r in corpus_statistics(frame, "lang", "line").collect()}
    assert (got["x"]["line_count"], got["x"]["word_count"], got["x"]["char_count"], got["x"]["vocab_size"]) == (4, 4, 12, 4)
    assert got["x"]["unique_chars"] == 6 and got["x"]["avg_sentence_length"] == round(4 / 3, 6)
    assert got["y"]["line_count"] == 1 and got["y"]["word_count"] == 0 and got["y"]["avg_word_length"] == 0
    top = [r["ch"] for r in top_characters(char_frequencies(frame, "lang", "line", "id"), "lang", 4).orderBy("place").collect()]
    assert top == ["b", "a", "c", "\n"]  # equals come in the order in which they were first seen


def test_names_and_display(spark):
    frame = spark.createDataFrame([("Hindi.txt", "a" * 101), ("crawl_1.txt", "a" * 100)], "f string, t string")
    got = frame.select(language_of_file(F.col("f"), {"Hindi.txt": "Hindi"}).alias("l"), shortened(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("Hindi", "a" * 100 + "..."), ("crawl_1", "a" * 100)]


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, id long, x int")
    for got in (with_rank(frame, ["g"], F.floor(F.col("id") / 64), ["id"]), digest_rank(frame, ["g"], F.md5(F.col("id").cast("string")), ["id"])):
        per = {}
        for r in got.collect():
            per.setdefault(r["g"], []).append(r["rank"])
        assert {g: sorted(v) == list(range(1, len(v) + 1)) for g, v in per.items()} == {"a": True, "b": True, None: True}


def test_sparse_keys(spark):
    keys = [0, 5, 2**62, -(2**62), 2**40, 2**40 + 1, 7 * 10**15]
    frame = spark.createDataFrame([("g", k) for k in keys], "g string, id long")
    bucket = order_bucket(frame, "id")
    got = with_rank(frame, ["g"], bucket, ["id"]).collect()
    assert {r["id"]: r["rank"] for r in got} == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert frame.select(bucket.alias("b")).agg(F.max("b")).first()[0] <= 4096
    assert with_rank(frame.limit(0), ["g"], order_bucket(frame.limit(0), "id"), ["id"]).count() == 0


def test_salted_join(spark):
    many = spark.createDataFrame([("h", i) for i in range(3000)] + [("c", 1), ("c", 2), (None, 5)], "k string, id long")
    few = spark.createDataFrame([("h", 10), ("c", 20), ("d", 30), (None, 40)], "k string, v int")
    hot = hot_keys(many.groupBy("k").count(), ["k"], "count", 3003)
    assert [r["k"] for r in hot.collect()] == ["h"]
    assert sorted(map(tuple, salted_join(many, few, ["k"], hot, ["id"]).collect())) == sorted(map(tuple, many.join(few, "k").select("k", "id", "v").collect()))


def test_split_is_exact_and_complete(spark):
    frame = spark.createDataFrame([(g, i) for g, n in (("a", 9), ("b", 20), ("c", 129), (None, 40)) for i in range(n)], "g string, id long")
    got = S.split_exact(frame, "g", "id", 0.05).groupBy("g").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect()
    assert {r["g"]: (r["t"], r["n"]) for r in got} == {"a": (0, 9), "b": (1, 20), "c": (6, 129), None: (2, 40)}


def test_shuffles_are_permutations(spark):
    frame = spark.range(1000).select(F.lit("g").alias("g"), F.col("id"))
    for got in (S.shuffled(frame, ["g"], "id"), S.buffer_shuffled(frame, "g", "id", 100)):
        rows = got.orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(1, 1001)) and sorted(r["id"] for r in rows) == list(range(1000)) and [r["id"] for r in rows] != list(range(1000))
    assert all(len({r["id"] // 100 for r in rows[i : i + 100]}) == 1 for i in range(0, 1000, 100))


def test_packing(spark):
    t = 8
    lines = [("a", i, list(range(n))) for i, n in enumerate([7, 1, 3, 16, 2])] + [("b", i, [1] * 7) for i in range(4)]
    frame = spark.createDataFrame(lines, "lang string, id long, tokens array<int>")
    got = K.pack(frame, ["lang"], "id", "tokens", Packing(sequence_length=t, chunk_lines=2)).collect()
    want = set()
    for lang in "ab":
        own = [x for g, _, x in lines if g == lang]
        for c in range(0, len(own), 2):
            flat = [x for ts in own[c : c + 2] for x in ts]
            want |= {(lang, c // 2, s, tuple(flat[s * t : s * t + t])) for s in range(len(flat) // t)}
    assert {(r["lang"], r["chunk"], r["seq"], tuple(r["tokens"])) for r in got} == want


def test_allocation(spark):
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "lang string, weight double")
    assert {r["lang"]: r["slots"] for r in L.allocation(weights, "lang", "weight", 16).collect()} == {"a": 9, "b": 4, "c": 3}


def test_batches(spark):
    frame = spark.createDataFrame([(g, i) for g, n in (("a", 50), ("b", 7), (None, 3)) for i in range(n)], "lang string, id long")
    mixed = L.mixed_batches(frame, "lang", "id", 8).collect()
    assert len(mixed) == 57 // 8 * 8 and {(r["batch"], r["slot"]) for r in mixed} == {(b, s) for b in range(7) for s in range(8)}
    single = L.single_batches(frame, ["lang"], "id", 8)
    full = L.padded(single, ["lang"], 8).groupBy("lang", "batch").count().collect()
    assert {r["count"] for r in full if r["lang"]} == {8}
    windows = L.random_windows(spark.createDataFrame([("a", i, list(range(i * 10, i * 10 + 10))) for i in range(5)] + [("b", 0, [1])], "lang string, id long, t array<int>"), "lang", "id", "t", 20, 7).collect()
    assert len(windows) == 20 and all(r["x"] == list(range(r["start"], r["start"] + 7)) and r["y"] == [x + 1 for x in r["x"]] for r in windows)


def test_series(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 250)
    rng = random.Random(2)
    values = [rng.random() * 10 for _ in range(1100)]
    frame = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "series string, step long, v double")
    rolled = [r["rolling"] for r in M.rolling_mean(frame, "series", "step", "v", 100).orderBy("step").collect()]
    averaged = [r["ema"] for r in M.moving_average(frame, "series", "step", "v").orderBy("step").collect()]
    deltas = [r["delta"] for r in M.delta(frame, "series", "step", F.col("v")).orderBy("step").collect()]
    now = None
    for i, v in enumerate(values):
        now = v if now is None else 0.9 * now + 0.1 * v
        last = values[max(0, i - 99) : i + 1]
        assert math.isclose(rolled[i], sum(last) / len(last)) and math.isclose(averaged[i], now)
        assert deltas[i] is None if i == 0 else math.isclose(deltas[i], v - values[i - 1], abs_tol=1e-12)


def test_arrays(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([([1.0, 3.0, 2.0, 3.0], 1), ([nan, inf, None, 0.0], -1)], "v array<double>, t int")
    got = frame.select(A.top_k_mask(F.col("v"), 2).alias("top"), A.invalid_count(F.col("v")).alias("bad"), A.cross_entropy(F.col("v"), F.col("t")).alias("loss"), A.softmax(F.col("v")).alias("p")).collect()
    assert got[0]["top"] == [-inf, 3.0, -inf, 3.0] and got[0]["bad"] == 0 and got[1]["bad"] == 3 and got[1]["loss"] is None
    powers = [math.exp(x - 3) for x in (1, 3, 2, 3)]
    assert all(math.isclose(a, b / sum(powers)) for a, b in zip(got[0]["p"], powers)) and math.isclose(got[0]["loss"], -math.log(1 / sum(powers)))
    drawn = spark.createDataFrame([([0.2, 0.5, 0.3], u) for u in (0.0, 0.19, 0.2, 0.69, 0.71, 0.9999)], "p array<double>, u double").select(A.draw(F.col("p"), F.col("u")).alias("d")).collect()
    assert [r["d"] for r in drawn] == [0, 0, 1, 1, 2, 2]


def test_schedule(spark):
    rate = M.learning_rate(F.col("id"), base=1.0, least=0.1, warmup=10, decay=20)
    got = [r["r"] for r in spark.range(25).select(rate.alias("r")).collect()]
    assert math.isclose(got[0], 1 / 11) and math.isclose(got[10], 1.0) and math.isclose(got[15], 0.55) and math.isclose(got[20], 0.1) and got[24] == 0.1
    assert spark.range(1).select(M.duration(F.lit(3725.9)).alias("d")).first()["d"] == "1h 2m 5s"


def test_subwords_round_trip(spark):
    model = "/opt/tokenizers/piece_bpe_32k.model"
    rows = [(1, "plain words"), (2, ""), (3, None), (4, "हिन्दी text")]
    frame = spark.createDataFrame(rows, "id long, text string")
    ids = K.subword_ids(frame, "id", "text", model)
    back = {r["id"]: r["text"] for r in K.decode_subwords(ids, "id", "tokens", model).collect()}
    assert back == {1: "plain words", 2: "", 3: "", 4: rows[3][1]}


def test_moving_average_forgets_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 400)
    frame = spark.range(1, 5001).select(F.lit("s").alias("series"), F.col("id").alias("step"), F.when(F.col("id") == 1, 100.0).otherwise(0.0).alias("v"))
    for keep in (0.0, 0.5, 0.9999, 1.0):
        got = {r["step"]: r["ema"] for r in M.moving_average(frame, "series", "step", "v", keep).collect()}
        assert len(got) == 5000 and all(math.isclose(e, 100 * keep ** (i - 1), rel_tol=1e-9, abs_tol=1e-12) for i, e in got.items())
    late = {r["step"]: r["ema"] for r in M.moving_average(frame.withColumn("v", F.col("step").cast("double")), "series", "step", "v", 0.5, start=5).collect()}
    assert min(late) == 5 and late[5] == 5.0 and late[6] == 5.5 and len(late) == 4996


def test_quotas(spark):
    frame = spark.createDataFrame([(g, i) for g, n in (("a", 500), ("b", 3), (None, 40)) for i in range(n)], "g string, id long")
    assert {r["g"]: r["count"] for r in S.sample_per_group(frame, "g", "id", 17).groupBy("g").count().collect()} == {"a": 17, "b": 3, None: 17}
    digest = F.md5(F.col("id").cast("string"))
    want = {(r["g"], r["id"]) for r in digest_rank(frame, ["g"], digest, ["id"]).collect() if r["rank"] <= 100}
    assert {(r["g"], r["id"]) for r in first_by_digest(frame, ["g"], digest, "id", F.lit(100)).where("taken").collect()} == want
    assert first_by_digest(frame.limit(0), ["g"], digest, "id", F.lit(100)).count() == 0
