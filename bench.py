"""Times the headline queries of the session library and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clickloom.jobs import queries as q
from clickloom.operators import evaluate, sweep
from clickloom.schema import VARIANTS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: 2000-02-13 in ms.
LINES_CUT = 950_400_000_000
CPUS = os.environ.get("BENCH_CPUS", "8")


def _ten_direct(spark, sf_dir):
    events = q._events(spark, sf_dir)
    parts = [sweep.direct_scores(events, v).withColumn("variant", F.lit(n)) for n, v in VARIANTS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lines_leaderboard(spark, sf_dir):
    """All variants on a wide item space: the last quarter of each customer's lines by day is to be foretold."""
    lines = q._lines(spark, sf_dir)
    late = F.col("ts") >= LINES_CUT
    truth = lines.where(late).groupBy("session", "type").agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))
    return sweep.leaderboard(lines.where(~late), evaluate.normalize_labels(truth))


QUERIES = {
    "index_l2": q.queries()["covisit_scores_base"],
    "index_l5": q.queries()["covisit_scores_v16"],
    "index_l20": q.queries()["covisit_scores_v17"],
    "index_l2_lineitem": q.covisit_scores_lineitem,
    "topk_300_lineitem": q.covisit_topk_300,
    "predict": q.predictions,
    "predict_lineitem": q.predictions_lineitem,
    "evaluate": q.recall_by_type,
    "sweep_folded": q.folded_sweep_scores,
    "sweep_ten_direct": _ten_direct,
    "leaderboard": q.variant_leaderboard,
    "sweep_folded_lineitem": lambda spark, sf_dir: sweep.folded_scores(q._lines(spark, sf_dir)),
    "leaderboard_lineitem": _lines_leaderboard,
}
#: Each query is run so often; its median counts.
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda f: f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run(QUERIES["predict"])  # starts the JVM's code
    took = {}
    for name, f in QUERIES.items():
        each = []
        for _ in range(RUNS):
            began = time.time()
            run(f)
            each.append(time.time() - began)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "session_covisitation_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
