"""The jobs end to end, by the command line."""

from __future__ import annotations

from bhashaloom.__main__ import main
from bhashaloom.sources.metadata import read_metadata
from bhashaloom.sources.sequences import read_sequences

HINDI = ["यह नगर बहुत सरल तथा सहज जगह पर बसा", "यह  नगर बहुत सरल तथा सहज जगह पर बसा", "घर पर सब लोग खुश तथा सहज", "abc", "", "कल शहर तक सड़क सरल तथा समतल"]


def test_clean_and_prepare(spark, tmp_path, capsys):
    source, cleaned, prepared = (str(tmp_path / x) for x in ("source", "cleaned", "prepared"))
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "Hindi.txt").write_text("\n".join(HINDI * 3), encoding="utf-8")
    (tmp_path / "source" / "english.txt").write_bytes(b"A line of plain words.\r\nAnother line of words.\rAnd one line more of words.\n" + b"".join(b"Number %d of many lines of plain words.\n" % i for i in range(60)))
    main(["clean", source, cleaned])
    assert "Hindi" in capsys.readouterr().out
    kept = spark.read.parquet(f"{cleaned}/processed").collect()
    assert sorted(r["text"] for r in kept if r["lang"] == "Hindi") == sorted({HINDI[0], HINDI[2], HINDI[5]}) and len(kept) == 66
    assert spark.read.parquet(f"{cleaned}/statistics").where("lang = 'english'").first()["line_count"] == 63
    report = "\n".join(r["value"] for r in spark.read.text(f"{cleaned}/report").collect())
    assert "Lines: 63" in report and "  '32': " in report

    main(["prepare", f"{cleaned}/processed", prepared, "--model", "/opt/tokenizers/piece_bpe_32k.model", "--length", "16", "--test-ratio", "0.1"])
    made = read_metadata(spark, f"{prepared}/metadata")
    assert made["languages"]["english"] == {"total_lines": 63, "train_lines": 57, "test_lines": 6}
    assert made["processing_stats"]["lines_processed"] == 66 and made["machine_specs"]["vcpus"] == 4 and set(made["files"]["train"]) >= {"english"}
    for split in ("train", "test"):
        counts = {r["lang"]: r["count"] for r in read_sequences(spark, f"{prepared}/bin", 16, f"_{split}.bin").groupBy("lang").count().collect()}
        assert counts == made["sequence_counts"][split]

    main(["clean", source, cleaned, "--sample", "2", "--no-dedup", "--no-quality", "--no-script", "--no-unicode"])
    assert {r["lang"]: r["count"] for r in spark.read.parquet(f"{cleaned}/processed").groupBy("lang").count().collect()} == {"Hindi": 2, "english": 2}
