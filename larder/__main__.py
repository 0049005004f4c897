"""Jobs for spark-submit: load, refresh, show, detail.

    python -m larder load STORE TRANSACTIONS PRODUCTS HOUSEHOLDS
    python -m larder refresh STORE
    python -m larder show STORE RESULT
    python -m larder detail STORE [--household 0010] [--sort SPEND] [--descending] [--page 2]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame

from larder.operators.detail import household_detail
from larder.plans.refresh import load_and_refresh, refresh_all
from larder.plans.warehouse import Warehouse
from larder.session import build_session
from larder.sources.ingest import LOAD_ORDER
from larder.sources.readers import read_csv
from larder.sources.store import Store


def parse(arguments: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="larder")
    jobs = parser.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("load", help="replace all tables from CSV and recompute everything")
    refresh = jobs.add_parser("refresh", help="recompute results that are not fresh")
    show = jobs.add_parser("show", help="print a written result")
    detail = jobs.add_parser("detail", help="print a page of purchase lines")
    for job in (load, refresh, show, detail):
        job.add_argument("store", help="folder all executors can reach")
    for table in LOAD_ORDER:
        load.add_argument(table, help="CSV file or folder")
    load.add_argument("--permit-rejects", action="store_true", help="load what can be read, count the rest")
    load.add_argument("--keep-first", action="store_true", help="keep one row of repeated dimension numbers")
    show.add_argument("result")
    detail.add_argument("--household", help="household number; all when absent")
    detail.add_argument("--sort", default="HSHD_NUM")
    detail.add_argument("--descending", action="store_true")
    detail.add_argument("--page", type=int, default=1)
    return parser.parse_args(arguments)


def run(warehouse: Warehouse, given: argparse.Namespace) -> DataFrame:
    if given.job == "load":
        spark = warehouse.store.spark
        raw = {t: read_csv(spark, getattr(given, t)) for t in LOAD_ORDER}
        return load_and_refresh(warehouse, raw, given.permit_rejects, given.keep_first)
    if given.job == "refresh":
        return refresh_all(warehouse)
    if given.job == "show":
        return warehouse.store.read(given.result)
    return household_detail(
        warehouse.star, given.household, given.sort, given.descending, given.page
    )


def main(arguments: Sequence[str] | None = None) -> None:
    given = parse(arguments)
    warehouse = Warehouse(Store(build_session(), given.store.rstrip("/")))
    result = run(warehouse, given)
    print("\t".join(result.columns))
    # Row by row as they come, so that a result of any length is printed whole.
    for row in result.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
