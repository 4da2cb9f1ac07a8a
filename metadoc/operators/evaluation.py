"""Comparing candidate models on a golden set."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.functions.answers import with_judge_flags
from metadoc.functions.scorers import deterministic_scores, exact_ratio
from metadoc.operators.prompts import judge_keys
from metadoc.runtime import deal, materialize

DET = ("det_non_empty", "det_within_len", "det_no_pii", "det_is_spanish")
USAGE = ("latency_ms", "tokens_in", "tokens_out")


def judge_metrics():
    return [f"judge_{key}" for key in judge_keys()]


def item_metrics():
    return [*DET, *judge_metrics(), "consistency", *USAGE]


def golden_strata(golden):
    """Objects and reference comments per domain and level."""
    return golden.groupBy("domain", "object_level").agg(
        F.count("*").alias("objects"), F.count("gold_comment").alias("with_gold")
    )


def evaluation_grid(golden, models, runs):
    """One row per golden object, candidate and consistency run; run -1 is the judged generation."""
    return golden.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn(
        "run", F.explode(F.sequence(F.lit(-1), F.lit(runs - 1)))
    )


def consistency(runs, ratio=None):
    """(model, object_id, consistency): the first run against every later one, mean; 1 if alone.

    ``runs`` has ``model``, ``object_id``, ``run`` and ``text``; failed runs have a null text.
    """
    ratio = ratio or exact_ratio()
    keys = ["model", "object_id"]
    good = runs.filter(F.col("text").isNotNull()).select(*keys, "run", "text")
    base = good.groupBy(*keys).agg(
        F.min("run").alias("base_run"), F.min_by("text", "run").alias("base_text")
    )
    pairs = good.join(base, keys).filter(F.col("run") > F.col("base_run"))
    pairs = deal(pairs, *keys, "run")  # also splits an object with very many runs
    means = pairs.select(*keys, ratio(F.col("base_text"), F.col("text")).alias("ratio")).groupBy(
        *keys
    ).agg(F.avg("ratio").alias("mean_ratio"))
    return base.select(*keys).join(means, keys, "left").select(
        *keys, F.coalesce("mean_ratio", F.lit(1.0)).alias("consistency")
    )


def scored_items(generated, judged, stability, max_chars):
    """One wide row per model and object; objects whose generation failed are left out.

    ``generated`` has the answer columns and ``comment``; ``judged`` has ``judge_text``.
    """
    keys = ["model", "object_id"]
    rows = generated.filter(F.col("comment").isNotNull())
    rows = rows.join(judged.select(*keys, "judge_text"), keys, "left").join(stability, keys, "left")
    rows = with_judge_flags(rows, judge_keys())
    return rows.select(
        *keys, "is_sensitive", *deterministic_scores(F.col("comment"), max_chars),
        *judge_metrics(),
        F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        "latency_ms", F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
        F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
    )


def model_means(items, metrics=None):
    """Mean of every metric and number of items per model."""
    metrics = metrics or item_metrics()
    return items.groupBy("model").agg(
        F.count("*").alias("n_items"), *[F.avg(name).alias(name) for name in metrics]
    )


def metrics_long(means, run_id, params, metrics=None):
    """(run_id, model, kind, key, value, number): parameters as text, metrics as they are."""
    metrics = metrics or [name for name in means.columns if name not in ("model", "n_items")]
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    logged = [("param", key, F.lit(str(value)), number) for key, value in params.items()]
    logged += [("param", "n_items", F.col("n_items").cast("string"), number)]
    logged += [("metric", name, text, F.col(name).cast("double")) for name in metrics]
    rows = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.alias("value"), n.alias("number"))
        for kind, key, value, n in logged
    ]))
    return means.select(F.lit(run_id).alias("run_id"), "model", rows.alias("entry")).select(
        "run_id", "model", "entry.*"
    )


def price_frame(spark, prices):
    """``{model: (price per million tokens in, out)}`` as a small dimension."""
    return spark.createDataFrame(
        [(model, float(pair[0]), float(pair[1])) for model, pair in prices.items()],
        "model string, price_in double, price_out double",
    )


def with_cost(means, prices):
    """Cost of a thousand comments from mean tokens; models without a price cost nothing."""
    joined = means.join(F.broadcast(prices), "model", "left")
    price_in = F.coalesce("price_in", F.lit(0.0))
    price_out = F.coalesce("price_out", F.lit(0.0))
    one = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return joined.withColumns({
        "cost_1k": one * 1000, "priced": F.col("price_in").isNotNull(),
    }).drop("price_in", "price_out")


def normalized(rows, columns):
    """``<name>_norm`` for every ``{name: lower_is_better}``: 0..1 over all rows, 1 if all are equal.

    Lowest and highest are one row and are read as scalars, so no task sees all rows in order.
    """
    bounds = rows.agg(*[
        found(name).alias(f"{label}_{name}")
        for name in columns for label, found in (("lo", F.min), ("hi", F.max))
    ])
    edges = rows.withColumn(
        "edges", bounds.select(F.struct(*bounds.columns).alias("edges")).scalar()
    )
    out = {}
    for name, lower_is_better in columns.items():
        low, high = F.col(f"edges.lo_{name}"), F.col(f"edges.hi_{name}")
        share = (F.col(name) - low) / F.nullif(high - low, F.lit(0.0))
        share = 1 - share if lower_is_better else share
        out[f"{name}_norm"] = F.when(high == low, 1.0).otherwise(share)
    return edges.withColumns(out).drop("edges")


def _mean_of(names):
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return total / len(names)


def _check_weights(weights):
    if abs(sum(weights.values()) - 1.0) >= 1e-9:
        raise ValueError("weights must sum to 1")


def scorecard(costed, weights=None):
    """One row per model: weighted score and its parts, best first."""
    weights = weights or fv.WEIGHTS
    _check_weights(weights)
    rows = normalized(costed, {"cost_1k": True, "latency_ms": True})
    quality = _mean_of(judge_metrics())
    score = (
        weights["quality"] * quality
        + weights["consistency"] * F.col("consistency")
        + weights["cost"] * F.col("cost_1k_norm")
        + weights["latency"] * F.col("latency_ms_norm")
    )
    return rows.select(
        F.col("model").alias("modelo"), F.round(score, 3).alias("score_final"),
        F.round(quality, 2).alias("calidad"), F.round("consistency", 2).alias("consistencia"),
        F.round("cost_1k", 2).alias("costo_1k"), F.round("latency_ms", 0).alias("latencia_ms"),
    ).orderBy(F.desc("score_final"), "modelo")


def scorecard_by_criterion(costed, grounding, completeness, terminology, weights=None):
    """The other weighting: grounding apart from completeness and terminology."""
    weights = weights or fv.ALTERNATIVE_WEIGHTS
    _check_weights(weights)
    rows = normalized(costed, {"cost_1k": True, "latency_ms": True})
    score = (
        weights["grounding"] * F.col(grounding)
        + weights["completeness_terminology"] * _mean_of([completeness, terminology])
        + weights["consistency"] * F.col("consistency")
        + weights["cost"] * F.col("cost_1k_norm")
        + weights["latency"] * F.col("latency_ms_norm")
    )
    return rows.select(
        F.col("model").alias("modelo"), F.round(score, 3).alias("score_final"),
        F.round(grounding, 2).alias("grounding"), F.round("consistency", 2).alias("consistencia"),
        F.round("cost_1k", 2).alias("costo_1k"), F.round("latency_ms", 0).alias("latencia_ms"),
    ).orderBy(F.desc("score_final"), "modelo")


def best_model(card):
    return card.orderBy(F.desc("score_final"), "modelo").limit(1)


def latency_percentiles(items, approximate=False):
    """Median and 95th percentile of the latency per model; exact, or from a bounded sketch."""
    if approximate:
        return items.groupBy("model").agg(
            F.percentile_approx("latency_ms", F.lit(0.5)).alias("p50"),
            F.percentile_approx("latency_ms", F.lit(0.95)).alias("p95"),
        )
    return exact_percentiles(items, "model", "latency_ms", {"p50": 0.5, "p95": 0.95})


def exact_percentiles(items, key, value, shares):
    """Interpolated percentiles of ``value`` per ``key``, nulls left out.

    Distinct values are counted and laid out in order over the partitions of a written table. A value's
    place is its place in its partition behind the partitions before, so no task holds a whole key.
    """
    counts = items.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(value).alias("n"))
    laid = materialize(
        counts.orderBy(key, "v").withColumn("part", F.spark_partition_id()), "percentile-counts"
    )
    whole = Window.partitionBy(key)
    ahead = laid.groupBy(key, "part").agg(F.sum("n").alias("size")).select(
        F.col(key).alias("of"), F.col("part").alias("in_part"),
        (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("ahead"),
        F.sum("size").over(whole).alias("total"),
    )
    within = F.sum("n").over(Window.partitionBy(key, "part").orderBy("v"))
    # A row per key and partition, and partitions are ranges of keys: no more than both in number.
    placed = laid.withColumn("within", within).join(
        F.broadcast(ahead), F.col(key).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))
    ).withColumn("upto", F.col("ahead") + F.col("within"))
    found, picked = [], []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("total") - 1)
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
            found.append(F.max(F.when(here, F.col("v"))).alias(f"{name}_{side}"))
        found.append(F.max(place - F.floor(place)).alias(f"{name}_rest"))
        low, high, rest = (F.col(f"{name}_{part}") for part in ("low", "high", "rest"))
        picked.append(F.when(low == high, low).otherwise((1 - rest) * low + rest * high).alias(name))
    return placed.groupBy(key).agg(*found).select(key, *picked)


def pii_by_sensitivity(items):
    """Share of comments with personal data, for sensitive and other objects."""
    return items.groupBy("model", "is_sensitive").agg(
        F.count("*").alias("items"), F.avg(1 - F.col("det_no_pii")).alias("leak_rate")
    )


def agreement(rows, judge="judge_flag", expert="expert_flag"):
    """One row: the 2x2 counts of two 0/1 raters, their agreement and Cohen's kappa."""
    j, e = F.col(judge), F.col(expert)
    counts = rows.agg(
        F.count(F.when((j == 1) & (e == 1), 1)).alias("both_yes"),
        F.count(F.when((j == 1) & (e == 0), 1)).alias("judge_only"),
        F.count(F.when((j == 0) & (e == 1), 1)).alias("expert_only"),
        F.count(F.when((j == 0) & (e == 0), 1)).alias("both_no"),
    )
    total = F.col("both_yes") + F.col("judge_only") + F.col("expert_only") + F.col("both_no")
    seen = (F.col("both_yes") + F.col("both_no")) / total
    judge_yes = (F.col("both_yes") + F.col("judge_only")) / total
    expert_yes = (F.col("both_yes") + F.col("expert_only")) / total
    chance = judge_yes * expert_yes + (1 - judge_yes) * (1 - expert_yes)
    return counts.withColumns({
        "agreement": seen, "kappa": (seen - chance) / F.nullif(1 - chance, F.lit(0.0)),
    })
