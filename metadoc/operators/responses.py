"""Answers to prompts: from a table of known answers, or from a pluggable responder.

A responder is a plain function from a pandas Series of prompts to a pandas DataFrame with the
columns text, latency_ms, tokens_in, tokens_out and error, one row per prompt; columns may be left out.
One with a second parameter also gets the settings of the call, ``{"max_tokens": …, "temperature": …}``.
Where it gives no latency, the time of its call counts, in equal shares for the prompts of the call; where
it gives no tokens, they are read from a column ``usage``, the JSON block of a service. No client is shipped.
"""

import inspect
import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metadoc import fixed_values as fv
from metadoc import schemas
from metadoc.functions.text import strip
from metadoc.operators.prompts import prompt_id
from metadoc.runtime import materialize, shared_dir

_ANSWER = ("text", "latency_ms", "tokens_in", "tokens_out", "error")


def tokens_from_usage(usage, key):
    """A token count out of a JSON usage block, 0 when it is missing."""
    count = F.try_variant_get(F.try_parse_json(usage), f"$.{key}", "int")
    return F.coalesce(count, F.lit(0))


def call_settings(kind, temperature=None):
    """The answer length and temperature of calls of a kind; the temperature of an evaluation is the run's."""
    length, usual = fv.CALL_SETTINGS[kind]
    return {"max_tokens": length, "temperature": usual if temperature is None else temperature}


def _with_settings(respond, settings):
    """``respond`` as a function of the prompts alone."""
    kinds = (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
    required = [p for p in inspect.signature(respond).parameters.values() if p.kind in kinds and p.default is p.empty]
    return (lambda texts: respond(texts, dict(settings))) if len(required) > 1 else respond


def answered(prompts, responses):
    """Prompts with their answers, matched by the hash of the text; unanswered ones have nulls."""
    known = responses.select("prompt_id", *_ANSWER)
    return prompts.withColumn("prompt_id", prompt_id(F.col("prompt"))).join(known, "prompt_id", "left")


def _calls(responder, settings):
    """mapInPandas function over (prompt_id, model, prompt); failures become error values."""
    columns = ["prompt_id", *_ANSWER, "usage"]

    def timed(respond, texts):
        begun = time.perf_counter()
        answers = counted(respond(texts), len(texts)).reset_index(drop=True)
        share = (time.perf_counter() - begun) * 1000 / len(texts)
        given = answers["latency_ms"].astype("float64") if "latency_ms" in answers else share
        return answers.assign(latency_ms=given).fillna({"latency_ms": share})

    def counted(answers, n):
        """Answers go by position: another number of them cannot be told apart."""
        if len(answers) != n:
            raise ValueError(f"{len(answers)} answers for {n} prompts")
        return answers

    def one_by_one(respond, texts):
        import pandas as pd

        frames = []
        for text in texts:
            try:
                frames.append(timed(respond, pd.Series([text])))
            except Exception as problem:
                frames.append(pd.DataFrame([{"error": (str(problem) or repr(problem))[:200]}]))
        return pd.concat(frames, ignore_index=True)

    def call(batches):
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                respond = _with_settings(responder[model] if isinstance(responder, dict) else responder, settings)
                texts = group["prompt"].reset_index(drop=True)
                try:
                    answers = timed(respond, texts)
                except Exception:  # find the prompts at fault, keep the others
                    answers = one_by_one(respond, texts)
                answers["prompt_id"] = group["prompt_id"].reset_index(drop=True)
                answers = answers.reindex(columns=columns)
                for name in ("tokens_in", "tokens_out"):
                    answers[name] = answers[name].astype("float64").astype("Int32")
                answers["latency_ms"] = answers["latency_ms"].astype("float64")
                texts_of = ["text", "error", "usage"]
                answers[texts_of] = answers[texts_of].astype(object).where(answers[texts_of].notna(), None)
                yield answers

    return call


def ask(objects, key, build, responder, answers_path=None, concurrency=None, identity=(), kind="evaluation",
        temperature=None):
    """(key, prompt_id, answer columns) for every row of ``objects``.

    ``build`` adds a ``prompt`` column to (a part of) ``objects``. Each distinct prompt is sent once;
    ``identity`` names columns, such as the run, that make equal texts distinct. ``responder`` is a
    function, or a dict of functions by the ``model`` column; ``kind`` and ``temperature`` name the settings
    it is told. ``concurrency`` bounds the number of tasks that call at the same time.

    Prompts are long, so they are never shuffled: hashes decide what is to be asked, and the prompts
    are built again in the stage that sends them. Answers are appended to a table before anything
    reads them; a rerun with the same ``answers_path`` asks only what has no good answer yet.
    """
    spark, key = objects.sparkSession, list(key)
    path = answers_path or f"{shared_dir(spark)}/metadoc/answers-{uuid.uuid4().hex}"
    spark.createDataFrame([], schemas.RESPONSES).write.mode("append").parquet(path)
    model = F.col("model") if "model" in objects.columns else F.lit("")
    parts = [F.col(name).cast("string") for name in identity]
    identified = F.concat_ws("\n", model, *parts, "prompt") if identity or "model" in objects.columns \
        else F.col("prompt")
    ids = materialize(build(objects).select(*key, prompt_id(identified).alias("prompt_id")), "prompt-ids")
    known = spark.read.schema(schemas.RESPONSES).parquet(path).filter(F.col("error").isNull())
    todo = ids.dropDuplicates(["prompt_id"]).join(known.select("prompt_id"), "prompt_id", "left_anti")
    calls = build(objects.join(todo, key)).select("prompt_id", model.alias("model"), "prompt")
    if concurrency:
        calls = calls.coalesce(concurrency)
    given = calls.mapInPandas(
        _calls(responder, call_settings(kind, temperature)), T.StructType([*schemas.RESPONSES, T.StructField("usage", T.StringType())]))
    used = {"tokens_in": "prompt_tokens", "tokens_out": "completion_tokens"}
    given.select("prompt_id", *[
        F.coalesce(name, tokens_from_usage(F.col("usage"), used[name])).alias(name) if name in used else name for name in _ANSWER
    ]).write.mode("append").parquet(path)
    answers = latest_answers(spark.read.schema(schemas.RESPONSES).parquet(path))
    return ids.join(answers, "prompt_id", "left")


def latest_answers(responses):
    """One answer per prompt: a good one if there is any."""
    return responses.groupBy("prompt_id").agg(
        F.min_by(F.struct(*_ANSWER), F.col("error").isNotNull()).alias("answer")
    ).select("prompt_id", "answer.*")


def split_answers(rows):
    """(good, bad): rows with a stripped ``comentario``, and rows with the reason there is none."""
    rows = rows.withColumn("comentario", strip(F.col("text")))
    missing = F.coalesce(F.col("error"), F.when(F.col("text").isNull(), "no answer"))
    good = rows.filter(missing.isNull())
    bad = rows.filter(missing.isNotNull()).withColumn("error", F.substring(missing, 1, 200))
    return good, bad
