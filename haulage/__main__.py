"""Command line: build the model from an input and write any question's answer.

    python -m haulage list
    python -m haulage run QUERY --parquet-dir DIR  [--out PATH] [--format parquet|csv]
    python -m haulage run QUERY --csv-dir DIR      [--out PATH] [--format parquet|csv]
    python -m haulage build --parquet-dir DIR | --csv-dir DIR  --location PATH [--database NAME]
    python -m haulage run QUERY --saved PATH       [--out PATH] [--format parquet|csv]
    python -m haulage load --csv-dir DIR --model PATH [--rejects PATH]
    python -m haulage run QUERY --model PATH       [--out PATH] [--format parquet|csv]

``--rejects PATH`` (with ``--csv-dir``) writes the records that cannot be read there and goes on with
the others; without it the first one stops the load.  ``--keys PATH`` (with ``build``) keeps
the dimension keys of earlier builds with the same folder (see ``functions/key_registry.py``).

``load`` adds the order lines of an input to the model in the folder ``--model`` without building it anew (see
``plans/loads.py``); the first load begins it.

``--parquet-dir`` takes the TPC-H-shaped test tables (mapped by the fixture
adapter); ``--csv-dir`` takes the seven staging tables as CSV files (see
``sources/csv.py`` for the file names).  ``build`` saves the model's tables, and
``--saved`` answers a question from them without building anything.  Without ``--out`` the first rows are
shown.  ``spark.checkpoint.dir`` should name a shared folder on a cluster.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from haulage.plans.registry import all_queries

    ap = argparse.ArgumentParser(prog="haulage")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run, build, load = sub.add_parser("run"), sub.add_parser("build"), sub.add_parser("load")
    run.add_argument("query")
    for command in (run, build, load):
        src = command.add_mutually_exclusive_group(required=True)
        src.add_argument("--parquet-dir")
        src.add_argument("--csv-dir")
        command.add_argument("--master", default=None)
        command.add_argument("--rejects")
        if command is run:
            src.add_argument("--saved")
            src.add_argument("--model")
    load.add_argument("--model", required=True)
    build.add_argument("--location", required=True)
    build.add_argument("--database", default="modeling")
    build.add_argument("--keys")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = ap.parse_args(argv)

    queries = all_queries()
    if args.cmd == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.cmd == "run" and args.query not in queries:
        print(f"unknown query {args.query!r}; see `python -m haulage list`", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    from haulage.functions.key_registry import KeyRegistry
    from haulage.plans.loads import LoadedModel
    from haulage.plans.star import build_star, clean_for, open_star, register_staging, save_star, star_for
    from haulage.session import DEFAULT_CONF, scratch_path
    from haulage.sources.csv import read_csv_folder
    from haulage.sources.quarantine import ingest_folder

    owned = SparkSession.getActiveSession() is None
    builder = SparkSession.builder.appName("haulage")
    if args.master:
        builder = builder.master(args.master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    source = args.parquet_dir
    if args.csv_dir:
        if args.rejects:
            staging, rejects = ingest_folder(spark, args.csv_dir)
            rejects.write.mode("overwrite").parquet(args.rejects)
        else:
            staging = read_csv_folder(spark, args.csv_dir)
        source = register_staging(spark, args.csv_dir, staging)
    if args.cmd == "build":
        if args.keys:
            star = build_star(clean_for(spark, source), scratch_path(spark, "star"), keys=KeyRegistry(spark, args.keys))
        else:
            star = star_for(spark, source)
        save_star(star, args.database, args.location)
        print(args.location)
        if owned:
            spark.stop()
        return 0
    if args.cmd == "load":
        print(LoadedModel(spark, args.model).load(clean_for(spark, source)))
        if owned:
            spark.stop()
        return 0
    if args.model:
        source = LoadedModel(spark, args.model).open()
    if args.saved:
        source = open_star(spark, location=args.saved)
    df = queries[args.query](spark, source)
    if args.out:
        df.write.mode("overwrite").option("header", True).format(args.format).save(args.out)
        print(args.out)
    else:
        df.show(20, truncate=False)
    if owned:  # leave a session we did not start to its owner
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
