"""The fixed-size sample and the mixture."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bhashaloom.llm import fixed_sample as S
from bhashaloom.llm import mixing as M


def pieces(spark, n, extra=()):
    return spark.createDataFrame([(i, None if i % 7 == 0 else i * i % 5, f"row {i}") for i in range(n)] + list(extra), "id long, piece long, text string")


@pytest.mark.parametrize(("good", "bad", "n"), [(10**12, 3 * 10**12, 2000), (7, 5, 6), (5, 0, 3), (0, 5, 3), (10**10, 10, 10**10)])
def test_hypergeometric(good, bad, n):
    rng = np.random.default_rng(1)
    if n > 10**6:
        n = good + bad - 5
    got = [S.hypergeometric(good, bad, n, rng) for _ in range(5)]
    assert all(max(0, n - bad) <= x <= min(n, good) for x in got)
    if n == 2000:
        assert abs(sum(got) / 5 - 500) < 60


def test_quota():
    rng = np.random.default_rng(3)
    counts = [5, 0, 100, 1, 30]
    total = Counter()
    for _ in range(4000):
        q = S.split_quota(counts, 20, rng)
        assert sum(q) == 20 and all(x <= c for x, c in zip(q, counts))
        total.update(dict(enumerate(q)))
    for i, c in enumerate(counts):
        assert abs(total[i] / 4000 - 20 * c / 136) < 0.15
    assert S.split_quota(counts, 1000, rng) == counts


def test_size_and_same_again(spark):
    frame = pieces(spark, 3000)
    one = S.fixed_size_sample(frame, 100, "piece", ["id"])
    two = S.fixed_size_sample(frame.repartition(7), 100, "piece", ["id"])
    assert one.count() == 100 and {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()}
    assert one.columns == frame.columns
    assert S.fixed_size_sample(frame, 5000, "piece", ["id"]).count() == 3000
    assert S.fixed_size_sample(frame, 0, "piece", ["id"]).count() == 0
    with pytest.raises(ValueError):
        S.fixed_size_sample(frame, -1, "piece", ["id"])


def test_every_row_alike(spark):
    """Over many seeds each row is drawn about equally often, whatever its piece."""
    frame = pieces(spark, 40).cache()
    seen: Counter = Counter()
    for seed in range(60):
        seen.update(r["id"] for r in S.fixed_size_sample(frame, 10, "piece", ["id"], seed).collect())
    assert sum(seen.values()) == 600
    expected, off = 15, sum((seen[i] - 15) ** 2 for i in range(40)) / 15
    assert expected * 0 + off < 75  # chi-square with 39 degrees of freedom, scaled by 3 / 4 for sampling without replacement


def test_repeated_rows_null_keys_and_names(spark):
    frame = pieces(spark, 50, [(None, None, None)] * 20).withColumn("n", F.lit(1)).withColumn("rank", F.lit(None).cast("int"))
    got = S.fixed_size_sample(frame, 60, "piece").collect()
    assert len(got) == 60 and sum(r["id"] is None for r in got) >= 10
    assert S.fixed_size_sample(frame.limit(0), 5, "piece").count() == 0
    assert S.fixed_size_sample(frame.limit(0), 5, "piece", ["id"]).count() == 0
    long_ = spark.createDataFrame([(1, 1, "x" * 300_000), (2, 1, "")], "id long, piece long, text string")
    assert S.fixed_size_sample(long_, 2, "piece", ["id"]).count() == 2


def sources(spark):
    rows = [(i, "big") for i in range(900)] + [(i + 900, "small") for i in range(30)] + [(i + 930, "none") for i in range(20)] + [(950, None)]
    return spark.createDataFrame(rows, "seq_id long, lang string")


def test_mixture_reaches_shares(spark):
    targets = spark.createDataFrame([("big", 3.0, None), ("small", 1.0, 4.9), ("absent", 1.0, 2.0), ("none", None, 1.0), (None, 1.0, 1.0), ("zero", 0.0, None), ("bad", float("nan"), None)], "lang string, train_weights double, max_repeats double")
    frame = sources(spark)
    mixture = M.mix(frame, targets)
    uses = Counter(r["lang"] for r in mixture.collect())
    assert abs(uses["small"] - 120) <= 1 and abs(uses["big"] - 360) <= 1 and set(uses) == {"small", "big"}
    most = mixture.groupBy("seq_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("c")).collect()
    assert all(r["n"] == r["c"] <= 4 for r in most)
    report = {r["source"]: r for r in M.shares(mixture, M.plan(frame, targets)).collect()}
    assert report["absent"]["reached_share"] == 0 and abs(report["small"]["reached_share"] - 0.25) < 0.003 and report["big"]["target_share"] == 0.75 and report["big"]["wanted_share"] == 0.6
    assert sorted(map(tuple, M.mix(frame.repartition(5), targets).collect())) == sorted(map(tuple, mixture.collect()))


def test_mixture_by_total_and_size(spark):
    targets = spark.createDataFrame([("big", 1.0, 1.0), ("small", 1.0, 2.0)], "lang string, train_weights double, max_repeats double")
    uses = Counter(r["lang"] for r in M.mix(sources(spark), targets, total=1000).collect())
    assert abs(uses["big"] - 500) <= 1 and uses["small"] == 60  # the cap holds where the total asks for more
    sized = sources(spark).withColumn("tokens", F.when(F.col("lang") == "small", 10).otherwise(1))
    uses = Counter(r["lang"] for r in M.mix(sized, targets, total=400, size=F.col("tokens")).collect())
    assert abs(uses["big"] - 200) <= 1 and abs(uses["small"] - 20) <= 1


def test_mixture_of_buckets_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    targets = spark.createDataFrame([("big", 1.0, None)], "lang string, train_weights double, max_repeats double")
    got = M.mix(sources(spark), targets, total=1234)
    per = Counter(r["seq_id"] for r in got.collect())
    assert abs(sum(per.values()) - 1234) <= 1 and set(per.values()) <= {math.floor(1234 / 900), math.ceil(1234 / 900)} and len(per) == 900
    assert M.mix(sources(spark).limit(0), targets).count() == 0
    assert M.mix(sources(spark), targets.limit(0)).count() == 0
    twice = sources(spark).unionByName(sources(spark)).withColumn("copies", F.lit(7)).withColumn("n_rows", F.lit(None).cast("int"))
    assert M.mix(twice, targets).count() == 1800


def test_large_populations():
    rng = np.random.default_rng(3)
    drawn = np.array([S.hypergeometric(3 * 10**11, 7 * 10**11, 10**6, rng) for _ in range(300)])
    assert abs(drawn.mean() - 300_000) < 4 * (10**6 * 0.21 / 300) ** 0.5 and 0.8 < drawn.std() / (10**6 * 0.21) ** 0.5 < 1.2
    few = [S.hypergeometric(10**9, 10**9, 3, rng) for _ in range(4000)]
    assert all(abs(few.count(x) / 4000 - p) < 0.03 for x, p in enumerate((0.125, 0.375, 0.375, 0.125)))
    assert S.hypergeometric(10**9, 1, 10**9 + 1, rng) == 10**9 and S.hypergeometric(10**12, 5, 10**12 + 2, rng) in range(10**12 - 3, 10**12 + 1)
    assert S.leaves_for(10**5) == 32 and S.leaves_for(10**10) == 1 << 14 and sum(S.split_quota([10**11, 2 * 10**11], 10**9, rng)) == 10**9
