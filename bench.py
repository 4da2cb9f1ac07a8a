"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores (default 8).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "scope_targets", "scope_found", "describe_cut", "manifest_entries", "sources_merged", "source_scores",
    "relevance_pairs", "relevance_rank", "context_budget", "context_text", "prompts_table", "prompts_column",
    "prompts_audit", "prompts_evaluation", "prompts_judge", "prompt_response", "table_sample", "verdicts",
    "judge_flags", "audit_upsert", "det_scores", "pii_hits", "style_flags",
    "consistency_native", "eval_grid", "model_means", "scorecard", "latency_percentiles", "run_summary",
    "execution_latest", "latest_approved", "apply_statements", "results_changes", "dq_length", "assign_ids",
    "kpis", "stream_flags",
)


def main():
    from checks.queries import QUERIES
    from metadoc.runtime import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", cpus, **{
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the workers and loads the classes.
    QUERIES["context_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name:22} {seconds[name]:8.3f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
