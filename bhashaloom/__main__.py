"""python -m bhashaloom clean|prepare SOURCE TARGET [options]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from bhashaloom.config import Cleaning, Packing
from bhashaloom.plans.jobs import clean_corpus, prepare_dataset


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="bhashaloom", description="Cleans text files, or prepares sequences from cleaned lines. The master and all Spark settings come from spark-submit or spark-defaults.")
    jobs = out.add_subparsers(dest="job", required=True)
    clean = jobs.add_parser("clean", help="clean the text files of a folder")
    clean.add_argument("source")
    clean.add_argument("target")
    clean.add_argument("--sample", type=int, help="lines to keep of each language")
    for flag, what in (("dedup", "keep repeated lines"), ("unicode", "leave characters as they are"), ("quality", "keep short and repetitive lines"), ("script", "keep lines in other scripts")):
        clean.add_argument(f"--no-{flag}", action="store_true", help=what)
    prepare = jobs.add_parser("prepare", help="split, tokenize, pack and shuffle processed lines")
    prepare.add_argument("source")
    prepare.add_argument("target")
    prepare.add_argument("--model", required=True, help="SentencePiece model file that all workers reach")
    prepare.add_argument("--length", type=int, default=1024)
    prepare.add_argument("--chunk-lines", type=int, default=5000)
    prepare.add_argument("--test-ratio", type=float, default=0.05)
    prepare.add_argument("--seed", type=int, default=42)
    return out


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"bhashaloom {args.job}").getOrCreate()
    if args.job == "clean":
        settings = Cleaning(deduplicate=not args.no_dedup, clean_unicode=not args.no_unicode, remove_low_quality=not args.no_quality, script_filtering=not args.no_script)
        clean_corpus(spark, args.source, args.target, settings, args.sample).orderBy("lang").show(1000, False)
    else:
        settings = Packing(sequence_length=args.length, chunk_lines=args.chunk_lines, test_ratio=args.test_ratio, seed=args.seed)
        print(json.dumps(prepare_dataset(spark, args.source, args.target, args.model, settings), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
