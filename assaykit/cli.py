"""Command line: one check, all checks, or a report of earlier results."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .config import load_config
from .severity import exit_code


def parser() -> argparse.ArgumentParser:
    from .plans.runner import CHECKS

    out = argparse.ArgumentParser(prog="assaykit")
    commands = out.add_subparsers(dest="command", required=True)
    for name in (*CHECKS, "run_all"):
        p = commands.add_parser(name)
        p.add_argument("input", nargs="+" if name != "run_all" else None)
        p.add_argument("--config")
        p.add_argument("--sample-size", type=int)
        if name == "format_detection":
            p.add_argument("--sniff-records", type=int, default=2000)
        if name == "near_duplicates":
            p.add_argument("--threshold", type=float)
        if name == "run_all":
            p.add_argument("--output-dir", "-o", default="qc-results")
            p.add_argument("--skip-near", action="store_true", help="no near duplicates and no leakage between splits")
    p = commands.add_parser("report")
    p.add_argument("results", nargs="+")
    p.add_argument("--output", "-o")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    from .plans import report, runner

    args = parser().parse_args(argv)
    if args.command == "report":
        text = report.write_report(report.load_results(args.results))
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        print(text)
        return 0
    config = load_config(args.config)
    if args.sample_size:
        config = replace(config, sample_size=args.sample_size, pii_sample_size=args.sample_size)
    if getattr(args, "threshold", None) is not None:
        config = replace(config, near_duplicate_threshold=args.threshold)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("assaykit").getOrCreate()
    if args.command == "run_all":
        results, code = runner.run_all(spark, args.input, args.output_dir, config, args.skip_near)
        for r in results.values():
            print(runner.summary_line(r), file=sys.stderr)
        return code
    files = [f for i in args.input for f in runner.list_files(i)]
    run = runner.Run(spark, files, config)
    out = run.format_detection(args.sniff_records) if args.command == "format_detection" else getattr(run, args.command)()
    print(runner.summary_line(out), file=sys.stderr)
    print(runner.dump(out))
    return exit_code(out)


if __name__ == "__main__":
    raise SystemExit(main())
