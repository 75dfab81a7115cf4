"""Sequences of both splits, with and without a language, through shard files and back."""

from __future__ import annotations

from bhashaloom.plans import sequence_queries as Q


def test_both_splits_and_no_language(spark, tmp_path):
    rows = [(s, g, [i] * 1024) for i, (s, g) in enumerate([("train", "hindi"), ("train", None), ("train", "hindi"), ("test", "odia"), ("test", None)])]
    spark.createDataFrame(rows, "split_name string, lang string, tokens array<int>").write.parquet(str(tmp_path / "packed_seqs.parquet"))
    got = {tuple(r) for r in Q.QUERIES["bin_roundtrip_splits"](spark, str(tmp_path)).collect()}
    assert got == {("train", "hindi", 2, 2048), ("train", None, 1, 1024), ("test", "odia", 1, 3072), ("test", None, 1, 4096)}
