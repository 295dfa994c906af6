"""Time the headline queries; print one JSON line.

BENCH_SF_DIR: folder of the Parquet tables. BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession, functions as F

from checks import tables
from fitframe import LOGISTIC, RankingCurve, fit, score
from fitframe.plans.evaluation import Evaluation
from fitframe.plans.scoring import scores_for
from fitframe.plans.scratch import Scratch
from fitframe.sources import parse_libsvm

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = 3


def timed(run, repeats: int = REPEATS) -> float:
    """Median seconds after one unmeasured run."""
    run()
    seconds = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def one_pass(spark, examples, **options) -> float:
    """Loss and gradient of cached examples at fixed weights."""
    examples = examples.with_df(examples.df.repartition(CPUS).persist())
    examples.df.count()
    scores = scores_for(examples, storage=examples.df.storageLevel, **options)
    evaluation = Evaluation(scores, LOGISTIC)
    weights = tables.ramp(spark, examples.num_features)
    seconds = timed(lambda: evaluation.sums(weights).collect())
    scores.close()
    examples.df.unpersist()
    return seconds


def training(examples, **options) -> tuple[float, int]:
    """Seconds of one run and the steps it computed."""
    examples = examples.with_df(examples.df.repartition(CPUS))
    computed = []

    def run():
        computed.append(len(fit(examples, **options).steps) - 1)

    return timed(run, repeats=1), computed[-1]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("fitframe-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = tables.line_examples(spark, SF_DIR)
    orders = tables.order_examples(spark, SF_DIR)
    seconds, steps = {}, {}

    seconds["gradient_dense_4"] = one_pass(spark, lines)
    seconds["gradient_dense_64"] = one_pass(spark, tables.embedding_examples(spark, SF_DIR))
    seconds["gradient_sparse"] = one_pass(spark, orders)
    seconds["gradient_joined"] = one_pass(spark, orders, broadcast_features=0)

    seconds["train_logistic"], steps["train_logistic"] = training(lines, num_iters=50)
    seconds["train_sparse"], steps["train_sparse"] = training(orders, num_iters=10, num_corrections=5)
    seconds["train_joined"], steps["train_joined"] = training(
        orders, num_iters=10, num_corrections=5, broadcast_features=0
    )
    scaled = tables.line_examples(spark, SF_DIR, scale=100.0)
    seconds["train_backtracking"], steps["train_backtracking"] = training(scaled, num_iters=6)

    scored = score(lines, tables.ramp(spark, 4, -0.3)).repartition(CPUS)

    def area():
        curve = RankingCurve(scored)
        curve.area().collect()
        curve.unpersist()

    seconds["auc"] = timed(area)

    text = f"{Scratch(spark).root}/lines"
    copies = F.explode(F.sequence(F.lit(1), F.lit(10)))
    lines_of_text = tables.embedding_lines(spark, SF_DIR).select("value", copies)
    lines_of_text.select("value").repartition(CPUS).write.text(text)
    parsed = parse_libsvm(spark.read.text(text))
    seconds["libsvm_parse"] = timed(
        lambda: parsed.write.format("noop").mode("overwrite").save()
    )

    print(
        json.dumps(
            {
                "metric": "fitframe headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "computed_steps": steps,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
