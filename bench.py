"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lapgraph.model import Backend, Config
from lapgraph.operators.factor import factorize
from lapgraph.plans import catalog
from lapgraph.sources import generators
from lapgraph.sources.matrix import from_edges

HEADLINE = [
    "q01_coalesce", "q02_laplacian", "q04_balance", "q06_components", "q09_star_merge", "q11_fractions", "q12_expected_clique", "q16_order_paths_exact",
    "q17_event_paths_approximate", "q18_forest_potentials", "q20_multiply", "q21_batched_rhs", "q26_event_cycles",
]


def banded(spark: SparkSession, n: int = 160_000, half_bandwidth: int = 6) -> None:
    """Factorize the banded Laplacian of the baseline: one block."""
    factorize(from_edges(generators.banded(spark, n, half_bandwidth), n), Config(backend=Backend.approximate()), checked=False)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start-up is not the queries'
    for name in HEADLINE:
        began = time.time()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    banded(spark)
    took["banded_160k_factorize"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
