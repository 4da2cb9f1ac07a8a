"""Physical plans: what reaches the scan, and what must never be in a plan."""

import pytest

from checks.queries import QUERIES

GLOBAL_ROWS = {  # queries whose answer is a handful of rows ordered or counted as a whole
    "scope_totals", "audit_totals", "applied_counts", "kpis", "kpis_filtered", "judge_agreement",
    "best_model", "scorecard", "scorecard_alt", "normalized", "calibration_sample", "context_table_text",
    "assign_ids", "results_with_execution",
}
LIGHT = [n for n in QUERIES if n not in GLOBAL_ROWS and n not in {
    "relevance_pairs", "relevance_rank", "context_budget", "context_text", "prompts_schema", "prompts_table",
    "prompts_column", "prompts_audit", "responder_answers", "delimited_text", "text_file_content", "stream_flags"}]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_global_step_and_no_pairs(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for bad in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_sample_and_first_rows_are_top_k(spark, sf_dir):
    for name in ("context_table_text", "calibration_sample"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf_dir))


def test_rank_limits_run_before_the_shuffle(spark, sf_dir):
    for name in ("table_sample", "tables_per_schema", "first_errors"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf_dir))


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["level_limits"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_result_filters_reach_the_scan(spark, sf_dir, folder):
    from metadoc.operators.results import filter_results

    from checks.views import view

    view(spark, sf_dir, "v_results").write.parquet(str(folder / "results"))
    stored = spark.read.parquet(str(folder / "results"))
    plan = plan_of(filter_results(stored, "src3", only_approved=True).select("id_resultado"))
    assert "EqualTo(id_ejecucion,src3)" in plan and "EqualTo(status,aprobado)" in plan
    assert "ReadSchema: struct<id_resultado:bigint,id_ejecucion:string,status:string>" in plan
