"""Times the headline queries over one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from gatehouse.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "access_visible_resources", "access_decision_log", "grants_with_names", "directory_with_roles", "dept_subtree_counts", "conversation_transcript", "latest_conversation",
    "audit_page", "stats_monthly_quota", "stats_latency_percentiles", "corpus_retrieve_lexical", "corpus_retrieve_vector", "event_fold_turns", "frame_split", "token_states",
    "ext_sessions", "ext_asof", "ext_rollup_usage", "stream_tumbling_counts",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    queries = dict(registry.QUERIES)
    try:
        from gatehouse.llm import registry as llm

        queries |= llm.QUERIES
        names = HEADLINES + list(llm.QUERIES)
    except ModuleNotFoundError:
        names = HEADLINES
    queries["access_visible_resources"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # the JVM's warm-up
    for name in names:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
