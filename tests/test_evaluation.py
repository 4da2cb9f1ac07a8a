"""Model comparison."""

import itertools
from difflib import SequenceMatcher
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import view
from metadoc.config import EvaluationConfig, GenerationConfig
from metadoc.functions.scorers import native_ratio
from metadoc.operators import evaluation, quality, sampling
from metadoc.operators.prompts import judge_keys
from metadoc.operators.responses import tokens_from_usage
from metadoc.plans.evaluation import evaluate

GOLDEN = "object_id string, object_level string, context_text string, gold_comment string, domain string, is_sensitive boolean"
RUNS = "model string, object_id string, run int, text string"


def run_groups(spark, sf_dir):
    groups = {}
    for row in view(spark, sf_dir, "v_runs").orderBy("run").collect():
        if row["text"] is not None:
            groups.setdefault((row["model"], row["object_id"]), []).append(row["text"])
    return groups


def test_consistency_equals_plain_ratio(spark, sf_dir):
    """The exact ratio, an option, against a plain loop over the whole table."""
    groups = run_groups(spark, sf_dir)
    found = evaluation.consistency(view(spark, sf_dir, "v_runs")).collect()
    got = {(r["model"], r["object_id"]): r["consistency"] for r in found}
    assert set(got) == set(groups)
    for key, texts in groups.items():
        ratios = [SequenceMatcher(None, texts[0], text).ratio() for text in texts[1:]]
        assert got[key] == pytest.approx(mean(ratios) if ratios else 1.0)


def plain_distance(a, b):
    """Edit distance in code points."""
    codes = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    left, right = codes(a), codes(b)
    at = np.arange(len(right) + 1)
    row = at.copy()
    for n, c in enumerate(left, 1):
        row = np.r_[n, np.minimum(row[1:] + 1, row[:-1] + (right != c))]
        row = np.minimum.accumulate(row - at) + at
    return int(row[-1])


def test_registered_consistency_equals_plain_distances(spark, sf_dir):
    """The registered query, on whole texts, against a plain loop over the whole table."""
    groups = run_groups(spark, sf_dir)
    got = {(r["model"], r["object_id"]): r["consistency"] for r in QUERIES["consistency_native"](spark, sf_dir).collect()}
    assert set(got) == set(groups) and any(not t.isascii() for texts in groups.values() for t in texts)
    for key, texts in groups.items():
        ratios = [1 - plain_distance(texts[0], t) / n if (n := max(len(texts[0]), len(t))) else 1 for t in texts[1:]]
        assert got[key] == pytest.approx(mean(ratios) if ratios else 1.0, abs=1e-6)


@pytest.mark.parametrize("texts,expected", [
    (["a"], 1.0), (["abc", "abc", "abc"], 1.0), (["abc", "xyz"], 0.0), (["", ""], 1.0), (["", "a"], 0.0),
    ([None, "abc", "abd"], 2 / 3), (["ab", None], 1.0)])
def test_consistency_cases(spark, texts, expected):
    runs = spark.createDataFrame([("m", "o", i, t) for i, t in enumerate(texts)], RUNS)
    assert evaluation.consistency(runs).first()["consistency"] == pytest.approx(expected)


def test_native_ratio(spark):
    frame = spark.createDataFrame([("", ""), ("abc", "abd"), ("", "ab"), ("ñu", "nu")], "a string, b string")
    got = [r[0] for r in frame.select(native_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 2 / 3, 0.0, 0.5])


@pytest.mark.parametrize("values,lower,expected", [
    ([1.0, 2.0, 3.0], False, [0, .5, 1]), ([1.0, 2.0, 3.0], True, [1, .5, 0]), ([5.0, 5.0], True, [1, 1]), ([7.0], False, [1])])
def test_normalized(spark, values, lower, expected):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = evaluation.normalized(frame, {"v": lower}).orderBy("i").collect()
    assert [r["v_norm"] for r in got] == pytest.approx(expected)


def means_frame(spark, **models):
    names = [*judge_keys()]
    rows = [(m, *([q] * len(names)), c, tin, tout, lat) for m, (q, c, tin, tout, lat) in models.items()]
    columns = ", ".join(f"judge_{n} double" for n in names)
    return spark.createDataFrame(rows, f"model string, {columns}, consistency double, tokens_in double, tokens_out double, latency_ms double")


def test_scorecard(spark):
    means = means_frame(spark, a=(0.8, 0.9, 1000.0, 100.0, 500.0), b=(0.9, 0.7, 2000.0, 200.0, 900.0))
    costed = evaluation.with_cost(means, evaluation.price_frame(spark, {"a": (3.0, 15.0)}))
    card = evaluation.scorecard(costed).collect()
    assert [tuple(r) for r in card] == [
        ("b", round(.6 * .9 + .15 * .7 + .15 * 1 + 0, 3), .9, .7, 0.0, 900.0),
        ("a", round(.6 * .8 + .15 * .9 + 0 + .1, 3), .8, .9, 4.5, 500.0)]
    assert evaluation.best_model(evaluation.scorecard(costed)).first()["modelo"] == "b"
    with pytest.raises(ValueError):
        evaluation.scorecard(costed, {"quality": 1, "consistency": 1, "cost": 0, "latency": 0})


def test_agreement(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    row = evaluation.agreement(spark.createDataFrame(rows, "judge_flag int, expert_flag int")).first()
    assert (row["both_yes"], row["judge_only"], row["expert_only"], row["both_no"]) == (20, 5, 10, 15)
    assert row["agreement"] == pytest.approx(.7) and row["kappa"] == pytest.approx(.4)


def test_tokens_from_usage(spark):
    frame = spark.createDataFrame([('{"prompt_tokens": 12}',), ("{}",), (None,), ("x",)], "u string")
    assert [r[0] for r in frame.select(tokens_from_usage(F.col("u"), "prompt_tokens")).collect()] == [12, 0, 0, 0]


def candidate(quality):
    def respond(prompts):
        import pandas as pd

        if quality == "fails":
            raise RuntimeError("sin servicio")
        return pd.DataFrame({
            "text": [f" La tabla para {quality} " for _ in prompts], "latency_ms": 10.0 if quality == "good" else 20.0,
            "tokens_in": 100, "tokens_out": [10 for _ in prompts],
            "error": ["timeout" if "objeto 3" in p and quality == "good" else None for p in prompts]})
    return respond


def judge(prompts):
    import json

    import pandas as pd
    keys = ["fuera_de_contexto", "terminologia_incorrecta", "granularidad", "idioma_o_estilo", "informacion_faltante"]
    return pd.DataFrame({"text": [json.dumps({k: 1 if "good" in p or k == "granularidad" else 0 for k in keys}) for p in prompts]})


def test_evaluation_flow(spark):
    golden = spark.createDataFrame(
        [(f"o{i}", ["schema", "table", "column"][i % 3], f"contexto del objeto {i} ", None, "d", i == 0) for i in range(6)], GOLDEN)
    config = EvaluationConfig(candidates="good, bad, none", judge="judge", prices={"good": (1.0, 10.0)})
    done = evaluate(spark, golden, config, {
        "good": candidate("good"), "bad": candidate("bad"), "none": candidate("fails"), "judge": judge}, ["m.md"])
    means = {r["model"]: r for r in done.means.collect()}
    assert set(means) == {"good", "bad"}
    assert means["good"]["n_items"] == 5 and means["bad"]["n_items"] == 6
    assert means["good"]["judge_idioma_o_estilo"] == 1 and means["bad"]["judge_idioma_o_estilo"] == 0
    assert means["good"]["consistency"] == 1.0 and means["good"]["det_is_spanish"] == 1.0
    card = [r["modelo"] for r in done.card.collect()]
    assert card == ["good", "bad"] and done.best.first()["modelo"] == "good"
    assert done.card.first()["costo_1k"] == pytest.approx(.2)
    logged = {(r["model"], r["key"]): r["value"] for r in done.metrics.collect()}
    assert logged["good", "n_items"] == "5" and logged["bad", "judge"] == "judge"
    leaks = evaluation.pii_by_sensitivity(done.items).collect()
    assert {r["leak_rate"] for r in leaks} == {0.0}


def test_nothing_scored_is_an_error(spark):
    golden = spark.createDataFrame([("o", "table", "c", None, "d", False)], GOLDEN)
    config = EvaluationConfig(candidates=("none",), judge="judge")
    with pytest.raises(RuntimeError):
        evaluate(spark, golden, config, {"none": candidate("fails"), "judge": judge}, ["m.md"])


def test_golden_contract(spark):
    with pytest.raises(ValueError, match="context_text, domain"):
        quality.checked_golden(spark.createDataFrame(
            [("a", "table", None, True)], "object_id string, object_level string, gold_comment string, is_sensitive boolean"))
    with pytest.raises(ValueError, match="empty"):
        quality.checked_golden(spark.createDataFrame([], GOLDEN))


@pytest.mark.parametrize("rows,pct,size", [(0, 10, 0), (1, 1, 1), (500, 1, 500), (501, 1, 5), (501, 100, 501), (1000, 10, 100)])
def test_sample_size(spark, rows, pct, size):
    assert spark.range(1).select(sampling.sample_size(F.lit(rows), pct)).first()[0] == size


def test_table_sample(spark):
    wide = spark.range(600).select("id", *[F.lit("v" * 60).alias(f"c{i}") for i in range(25)])
    text = sampling.table_sample_text(wide, 10).first()[0].split("\n")
    assert len(text) == 31 and text[0].count(" | ") == 19
    assert len({line.split(" | ")[0] for line in text}) == 31
    assert text[1].split(" | ")[1] == "v" * 47 + "..."
    few = sampling.table_sample_text(wide, 1).first()[0].split("\n")
    assert len(few) == 7
    assert sampling.table_sample_text(wide.filter("id < 0"), 10).first()[0] == "(tabla vacía — sin registros)"
    assert sampling.table_sample_text(spark.range(3), 1).first()[0].count("\n") == 3


@pytest.mark.parametrize("wrong", [
    dict(candidates="a,b", judge="a"), dict(candidates="", judge="j"), dict(candidates="a", judge=""),
    dict(candidates="a", judge="j", temperature=2.5), dict(candidates="a", judge="j", runs=0),
    dict(candidates="a", judge="j", max_comment_chars=0)])
def test_evaluation_parameters(wrong):
    with pytest.raises(ValueError):
        EvaluationConfig(**wrong)


@pytest.mark.parametrize("wrong", [dict(scope_table=""), dict(scope_table="t", sampling_pct=0),
                                   dict(scope_table="t", sampling_pct=101), dict(scope_table="t", table_column="")])
def test_generation_parameters(wrong):
    with pytest.raises(ValueError):
        GenerationConfig(**wrong)


def test_candidates_are_split():
    assert EvaluationConfig(candidates=" a, b ,,c", judge="j").candidates == ("a", "b", "c")


def test_three_part_names():
    from metadoc.config import require_three_parts

    require_three_parts(golden="a.b.c")
    for name, wrong in itertools.product(["golden"], ["a.b", "a.b.c.d", "a"]):
        with pytest.raises(ValueError):
            require_three_parts(**{name: wrong})


def test_exact_percentiles_match_the_built_in(spark):
    from pyspark.sql import functions as F

    from metadoc.operators.evaluation import latency_percentiles

    rows = [("a", float(i * 37 % 101)) for i in range(1000)] + [("b", 5.0), ("c", None), ("d", 1.0), ("d", 2.0), (None, 3.0)]
    items = spark.createDataFrame(rows, "model string, latency_ms double").repartition(7)
    want = items.groupBy("model").agg(F.percentile("latency_ms", F.lit(0.5)), F.percentile("latency_ms", F.lit(0.95)))
    got = latency_percentiles(items)
    rounded = lambda frame: {r[0]: tuple(x if x is None else round(x, 9) for x in r[1:]) for r in frame.collect()}
    assert rounded(got) == rounded(want)
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString().replace("percentile-counts", "")
