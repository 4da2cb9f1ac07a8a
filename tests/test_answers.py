"""Reading answers, against the rules stated in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.operators.audit import (
    audit_by_criterion, audit_totals, claimed_verdicts, criteria_frame, settled_verdicts,
)
from metadoc.functions.answers import with_judge_flags
from metadoc.operators.prompts import judge_keys

KNOWN = [name for name, _ in fv.CRITERIA]
FINE = (True, None, None)


def plain_verdict(raw):
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.strip("`")
        if text[:4].lower() == "json":
            text = text[4:].strip()
    found = re.search(r"\{[^{}]*\}", text)
    try:
        data = json.loads(found.group() if found else text)
    except ValueError:
        return FINE
    if not isinstance(data, dict) or data.get("ok", True) or data.get("criterio") not in KNOWN:
        return FINE
    return False, data["criterio"], (data.get("detalles") or "").strip() or None


CASES = [
    None, "", "   ", '{"ok": true}', '{"ok": false, "criterio": "GRANULARIDAD", "detalles": " d "}',
    '```json\n{"ok": false, "criterio": "GRANULARIDAD", "detalles": "x"}\n```',
    '```\n{"ok": 0, "criterio": "GRANULARIDAD"}```', "```json\n[]\n```",
    'Claro: {"ok": false, "criterio": "IDIOMA_O_ESTILO", "detalles": ""} listo',
    '{"ok": "false", "criterio": "GRANULARIDAD"}', '{"ok": null, "criterio": "GRANULARIDAD"}',
    '{"ok": 0.0, "criterio": "GRANULARIDAD"}', '{"ok": -0.0, "criterio": "GRANULARIDAD"}',
    '{"ok": 0e3, "criterio": "GRANULARIDAD"}', '{"ok": 0.5, "criterio": "GRANULARIDAD"}',
    '{"ok": "", "criterio": "GRANULARIDAD"}', '{"ok": [], "criterio": "GRANULARIDAD"}',
    '{"ok": [0], "criterio": "GRANULARIDAD"}', '{"ok": false, "criterio": "OTRO"}',
    '{"ok": false, "criterio": null}', '{"ok": false}', '{"criterio": "GRANULARIDAD"}',
    '{"ok": false, "criterio": "GRANULARIDAD", "detalles": null}',
    '{"a": {"ok": false, "criterio": "GRANULARIDAD", "detalles": "inner"}}',
    '{"ok": false, "criterio": "GRANULARIDAD", "extra": {"x": 1}}',
    "[1, 2]", "nada", '{"ok": false, "criterio": "GRANULARIDAD"', '{ok: false}', '{"ok": false,}',
    '{"ok": false, "criterio": "GRANULARIDAD", "detalles": "l\\u00ednea\\n2"}', "```", "``````", "{}",
    '{"ok": false, "criterio": ["GRANULARIDAD"]}'.replace('["GRANULARIDAD"]', '"granularidad"'),
]


def random_answers(count):
    rng = random.Random(7)
    pieces = ['{"ok": false', '{"ok": true', '{"ok": 0', '{"ok": "no"', ', "criterio": "GRANULARIDAD"',
              ', "criterio": "X"', ', "detalles": " d"', "}", "```", "json", "\n", " ", "texto", "[", "]"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(count)]


def test_verdicts(spark):
    cases = CASES + random_answers(3_000)
    frame = spark.createDataFrame(list(enumerate(cases)), "id_resultado long, text string")
    settled = settled_verdicts(claimed_verdicts(frame), criteria_frame(spark))
    got = {r["id_resultado"]: (r["ok"], r["criterio"], r["detalles"]) for r in settled.collect()}
    for at, raw in enumerate(cases):
        if raw and re.search(r'"(\w+)"[^}]*"\1":', raw):
            continue  # duplicate keys are not readable here
        assert got[at] == plain_verdict(raw), raw


def test_values_that_are_no_text(spark):
    frame = spark.createDataFrame([
        (1, '{"ok": false, "criterio": ["GRANULARIDAD"]}'),
        (2, '{"ok": false, "criterio": "GRANULARIDAD", "detalles": 12}'),
    ], "id_resultado long, text string")
    rows = settled_verdicts(claimed_verdicts(frame), criteria_frame(spark)).orderBy("id_resultado").collect()
    assert [(r["ok"], r["detalles"]) for r in rows] == [(True, None), (False, "12")]


def test_totals(spark):
    rows = [(1, True, None, None), (2, False, "GRANULARIDAD", "a"), (3, False, "GRANULARIDAD", None),
            (4, False, "IDIOMA_O_ESTILO", "b")]
    verdicts = spark.createDataFrame(rows, "id_resultado long, ok boolean, criterio string, detalles string")
    assert tuple(audit_totals(verdicts).first()) == (4, 1, 3, 0)
    assert [tuple(r) for r in audit_by_criterion(verdicts).collect()] == [
        ("GRANULARIDAD", 2), ("IDIOMA_O_ESTILO", 1)]


def plain_flags(raw):
    found = re.search(r"\{.*\}", raw or "", re.DOTALL)
    try:
        data = json.loads(found.group()) if found else {}
    except ValueError:
        data = {}
    return tuple(int(data.get(key, 0) == 1) for key in judge_keys())


@pytest.mark.parametrize("value", ["1", "1.0", "true", '"1"', "0", "false", "null", "2", "[1]", "1e0", "1.00",
                                   '"true"', "0.1", "10"])
def test_judge_values(spark, value):
    raw = f'bla {{"granularidad": {value},\n "idioma_o_estilo": 1}} fin'
    frame = spark.createDataFrame([(raw,)], "judge_text string")
    row = with_judge_flags(frame, judge_keys()).drop("judge_text").first()
    assert tuple(row) == plain_flags(raw)


@pytest.mark.parametrize("raw", [None, "", "no", "{", '{"a": 1} x {"granularidad": 1}', '{"granularidad": {"x": 1}}'])
def test_judge_texts(spark, raw):
    frame = spark.createDataFrame([(raw,)], "judge_text string")
    assert tuple(with_judge_flags(frame, judge_keys()).drop("judge_text").first()) == plain_flags(raw)


def test_judge_duplicate_key_is_unreadable(spark):
    frame = spark.createDataFrame([('{"granularidad": 1, "granularidad": 1}',)], "judge_text string")
    assert sum(with_judge_flags(frame, judge_keys()).drop("judge_text").first()) == 0


def test_responders_get_settings_and_may_leave_figures_out(spark):
    import pandas as pd

    from metadoc.operators.responses import ask, call_settings

    def bare(texts):
        return pd.DataFrame({"text": list(texts)})

    def told(texts, settings):
        if (texts == "bad").any():
            raise RuntimeError("bad prompt")
        return pd.DataFrame({
            "text": [f"{t}/{settings['max_tokens']}/{settings['temperature']}" for t in texts], "latency_ms": [None if t == "b" else 5.0 for t in texts],
            "tokens_in": [9 if t == "a" else None for t in texts], "usage": ['{"prompt_tokens": 4, "completion_tokens": 2}', "no json", None][:1] * len(texts)})

    objects = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bad"])], "id int, p string")
    build = lambda rows: rows.withColumn("prompt", F.col("p"))
    found = {r.id: r for r in ask(objects, ["id"], build, told, kind="evaluation", temperature=0.7).collect()}
    assert found[0].text == "a/1024/0.7" and (found[0].latency_ms, found[0].tokens_in, found[0].tokens_out) == (5.0, 9, 2)
    assert found[1].latency_ms >= 0 and (found[1].tokens_in, found[1].tokens_out) == (4, 2)
    assert found[2].text is None and found[2].error == "bad prompt" and found[2].tokens_in == 0
    for r in ask(objects, ["id"], build, bare, kind="schema").collect():
        assert r.text is not None and r.error is None and r.latency_ms >= 0 and (r.tokens_in, r.tokens_out) == (0, 0)
    assert call_settings("schema") == {"max_tokens": 500, "temperature": 0.2}
