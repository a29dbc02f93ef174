"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import functions as F  # noqa: E402

from triagegrid.operators.decide import decide  # noqa: E402
from triagegrid.plans import derived  # noqa: E402
from triagegrid.plans.registry import QUERIES  # noqa: E402
from triagegrid.session import build_session  # noqa: E402


def decide_lines(spark, sf):
    """Whole decisions for a ticket per order line: the volume figure."""
    return decide(derived.line_tickets(spark, sf), now=F.lit("2026-01-01").cast("timestamp"))


HEADLINES = {
    "decide_lines": decide_lines,
    **{
        name: QUERIES[name]
        for name in [
            "queue_depths", "apply_guardrails", "triage_by_rules", "resolve_and_decide", "scorecard", "compare_scorecards",
            "record_ledger", "record_authoritative", "dedupe_earliest", "latency_profile", "token_totals", "price_match",
            "agreement", "flip_report", "recheck_verdict", "cascade_report", "model_mistakes", "write_decisions",
            "stream_record",
        ]
    },
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "triagegrid-bench",
        **{"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and load the classes, so the first query is not charged for them.
    small = Path(sf).parent / "sf0.001"
    QUERIES["queue_depths"](spark, str(small) if small.exists() else sf).collect()
    only = sys.argv[1:]
    times = {}
    for name, query in HEADLINES.items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf).name.removeprefix("sf"),
    }
    if "decide_lines" in times:
        result["tickets_per_second"] = round(lines / times["decide_lines"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
