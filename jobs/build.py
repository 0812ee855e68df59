"""Batch job: read records, load what is new, bring the search index up to date.

    spark-submit --py-files corvane.zip jobs/build.py --dataset records.json --out warehouse/
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from corvane import build_session
from corvane.plans.index import build_index
from corvane.plans.ingest import LoadReport, ingest_path
from corvane.plans.store import sync_index
from corvane.sources.curated import path_exists
from corvane.sources.schemas import STORED_SCHEMA


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dataset", required=True, help="record files")
    parser.add_argument("--out", required=True, help="folder of the curated table and the index")
    parser.add_argument("--layout", choices=["lines", "array", "array_lines"], default="lines")
    parser.add_argument("--load-id", help="name of this load; a fresh one by default")
    parser.add_argument("--replace", action="store_true", help="replace the rows of a stored load of that name")
    parser.add_argument("--sample-size", type=int, default=0, help="first new records to take; 0 or less, the default, for all")
    parser.add_argument("--batch-size", type=int, default=0, help="most rows per written file, 0 for no limit")
    parser.add_argument("--skip-index", action="store_true", help="leave the search index as it is")
    return parser.parse_args(argv)


def run(spark: SparkSession, options: argparse.Namespace) -> LoadReport:
    table = f"{options.out.rstrip('/')}/repositories"
    load_id = options.load_id or f"load-{uuid.uuid4().hex}"
    if not options.replace and path_exists(spark, f"{table}/load_id={load_id}"):
        raise ValueError(f"load {load_id!r} is stored already: name another one or pass --replace")
    report = ingest_path(
        spark,
        options.dataset,
        table,
        load_id,
        layout=options.layout,
        n=options.sample_size,
        max_records_per_file=options.batch_size or None,
    )
    if not options.skip_index:
        curated = spark.read.schema(STORED_SCHEMA).parquet(table).drop("load_id")
        sync_index(spark, f"{options.out.rstrip('/')}/index", curated, build_index)
    return report


if __name__ == "__main__":
    report = run(build_session("build"), parse())
    print(
        f"{report.existing} records stored before, {report.saved} added in {report.seconds:.1f}s ({report.rate:.1f}/s), "
        f"{report.rejected} rejected"
    )
