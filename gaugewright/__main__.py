"""Command line: run an experiment, study its scores, compare runs, audit a table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gaugewright.plans import experiment
from gaugewright.sources import provenance, tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gaugewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run an experiment from a configuration")
    run.add_argument("--config", "-c", required=True)
    run.add_argument("--out", "-o", required=True)
    study = commands.add_parser("robustness", help="robustness of a results folder's scores")
    study.add_argument("results")
    study.add_argument("--output-dir")
    study.add_argument("--perturbation", type=float, default=0.01)
    study.add_argument("--noise-std", type=float, default=0.02)
    study.add_argument("--mc-iterations", type=int, default=2000)
    many = commands.add_parser("aggregate", help="compare models over many results folders")
    many.add_argument("--results_dir", required=True)
    many.add_argument("--primary_metric", default="overall__accuracy_mean")
    many.add_argument("--out_dir", required=True)
    audit = commands.add_parser("audit", help="audit a CSV table")
    audit.add_argument("path")
    audit.add_argument("--target")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gaugewright").getOrCreate()
    if args.command == "run":
        experiment.run_experiment(spark, provenance.load_config(args.config), args.out)
    elif args.command == "robustness":
        normalized = tables.read_results(spark, args.results)["normalized"]
        if "dataset" not in normalized.columns:
            normalized = normalized.withColumn("dataset", F.lit("results"))
        experiment.robustness_study(normalized, args.output_dir or f"{args.results}/robustness", perturbation=args.perturbation, noise_std=args.noise_std, iterations=args.mc_iterations)
    elif args.command == "aggregate":
        for name, df in experiment.compare_runs(spark, args.results_dir, args.primary_metric).items():
            tables.write_csv(df, f"{args.out_dir}/{name}")
    else:
        target = args.target or tables.detect_target(spark, args.path)
        df = tables.read_csv(spark, args.path, target)
        print(experiment.audit_report(df.withColumn("row_number", F.monotonically_increasing_id()), target, "row_number"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
