"""Comparing candidate models on a golden set: generation, judge, consistency runs, scorecard."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metadoc.functions.text import strip
from metadoc.operators.evaluation import (
    best_model, consistency, evaluation_grid, metrics_long, model_means, price_frame, scored_items,
    scorecard, with_cost,
)
from metadoc.operators.prompts import evaluation_prompt, judge_prompt
from metadoc.operators.quality import checked_golden
from metadoc.operators.responses import ask
from metadoc.runtime import materialize


@dataclass
class Evaluation:
    items: DataFrame
    means: DataFrame
    metrics: DataFrame
    card: DataFrame
    best: DataFrame


def evaluate(spark, golden, config, responders, manifests, run_id="evaluation", answers_path=None,
             concurrency=None):
    """``responders`` maps every candidate and the judge to a responder.

    Candidates answer runs -1 (scored and judged) and 0..n-1 (consistency). Failed generations leave
    the object out for that model; failed consistency runs are left out on their own.
    """
    golden = checked_golden(golden)
    grid = evaluation_grid(golden, config.candidates, config.runs)
    key = ["model", "object_id", "run"]

    def build(rows):
        return rows.withColumn("prompt", evaluation_prompt(config.max_comment_chars))

    answers = ask(grid, key, build, responders, answers_path, concurrency, identity=["run"],
                  temperature=config.temperature)
    comment = F.when(F.col("error").isNull(), strip(F.col("text")))
    answers = materialize(
        answers.select(*key, comment.alias("comment"), "latency_ms", "tokens_in", "tokens_out"),
        "generated",
    )
    generated = answers.filter("run = -1 AND comment IS NOT NULL").drop("run").join(
        golden.select("object_id", "object_level", "context_text", "is_sensitive"), "object_id"
    )

    def judge_build(rows):
        return rows.withColumn("prompt", judge_prompt(manifests, config.catalog_product))

    judged = ask(
        generated.withColumnRenamed("model", "candidate"), ["candidate", "object_id"],
        judge_build, responders[config.judge], answers_path, concurrency, kind="judge",
    ).select(F.col("candidate").alias("model"), "object_id",
             F.when(F.col("error").isNull(), F.col("text")).alias("judge_text"))
    stability = consistency(answers.filter("run >= 0").withColumnRenamed("comment", "text"))
    items = materialize(
        scored_items(generated, judged, stability, config.max_comment_chars), "items"
    )
    means = materialize(model_means(items), "means")
    if means.isEmpty():
        raise RuntimeError("no model produced results that can be scored")
    params = {
        "temperature": config.temperature, "judge": config.judge, "n_consistency_runs": config.runs,
    }
    card = scorecard(with_cost(means, price_frame(spark, config.prices)))
    return Evaluation(items, means, metrics_long(means, run_id, params), card, best_model(card))
