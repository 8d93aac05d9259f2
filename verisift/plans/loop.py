"""Verification of claims, all claims of a table round by round.

The state of the claims is a table; one round asks the model once for every active claim (with its
retries inside), decides by native expressions over stored vectors whether queries or evidence repeat,
searches for the survivors and appends what was found. Every round is cut at a reliable checkpoint, so
model and search are called once for each row; a lost executor repeats only its own unfinished tasks.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.config import LoopSettings, ModelSettings
from verisift.functions import prompts
from verisift.functions.decisions import decision_of, final_answer_of
from verisift.functions.similarity import Encoder, HashedNgrams, encode, repeats_evidence, repeats_query, similar_lately
from verisift.functions.snippets import NO_RESULT
from verisift.functions.text import not_blank
from verisift.operators.defense import QUARANTINE, scan_risk
from verisift.operators.evidence import queries_of, results_of
from verisift.session import cut_lineage
from verisift.sources.models import Generator, RecordedAnswers, RecordedModel, load_model
from verisift.sources.search import Searcher, TableSearch

LOGGER = logging.getLogger(__name__)

ACTIVE, FALLBACK, FINAL, NO_VERDICT, ERROR = "active", "fallback", "final", "no_verdict", "error"
# Why a claim leaves the rounds without a verdict.
ALL_ROUNDS = "maximum decision rounds reached"
NO_ROUNDS = "no retrieval rounds configured"
REPEATED = "repeated query or evidence"
NO_DECISION = "decision output retries exhausted."

USAGE = "struct<input_tokens: bigint, output_tokens: bigint, unreported_calls: bigint>"
STATE = (
    "claim_id bigint, claim string, searches array<struct<query: string, result: string>>, "
    "query_vecs array<array<float>>, result_vecs array<array<float>>, status string, "
    "answer struct<response: string, answer: string>, fallback_reason string, error string, " + f"usage {USAGE}, rounds int"
)
CALLED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("unreported_calls", T.LongType()),
        T.StructField("calls", T.LongType()),
    ]
)


def call_model(generator: Generator, prompt: str, context: dict[str, Any], retries: int) -> tuple:
    """One decision or final answer of one claim, in the order of CALLED: the model is asked until its
    output is valid, at most 1 + ``retries`` times. Errors end the asking and are returned."""
    tokens, unreported, calls = {"input_tokens": 0, "output_tokens": 0}, 0, 0
    kind, value, response, error = "invalid", None, None, None
    for attempt in range(1, retries + 2):
        calls += 1
        try:
            response, usage = generator.generate(prompt, context | {"attempt": attempt})
        except Exception as problem:  # the claim fails, not the job
            unreported += 1
            kind, error = "error", f"{type(problem).__name__}: {problem}"
            break
        usage = usage or {}
        for name in tokens:
            tokens[name] += usage.get(name) or 0
        unreported += any(usage.get(name) is None for name in tokens)
        try:
            if context["phase"] == "decide":
                kind, value = decision_of(response)
            else:
                value = final_answer_of(response)
                kind = "answer" if value else "invalid"
        except Exception as problem:
            kind, error = "error", f"{type(problem).__name__}: {problem}"
            break
        if kind != "invalid":
            break
    return kind, value, response, error, tokens["input_tokens"], tokens["output_tokens"], unreported, calls


#: Calls of a model or a search in one task; a lost task makes no more than these again.
CALLS_OF_TASK = 500


def spread(rows: DataFrame) -> DataFrame:
    """The rows (cut) in tasks of about CALLS_OF_TASK, and in as many tasks as there are cores while there are fewer."""
    tasks = max(-(-rows.count() // CALLS_OF_TASK), 1)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), "claim_id")


def _together(calls: list[Callable[[], tuple]], at_once: int) -> list[tuple]:
    """Results of calls, in their order, of which ``at_once`` are under way at a time."""
    if at_once <= 1 or len(calls) <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda call: call(), calls))


def ask(rows: DataFrame, prompt: Column, model: Callable[[], Generator] | RecordedModel, phase: str, step: int, settings: LoopSettings) -> DataFrame:
    """``rows`` with what the model answers to ``prompt`` in a column ``called`` of the form of CALLED."""
    retries, at_once = settings.max_retries, settings.calls_at_once
    knowledge = prompts.knowledge(results_of(F.col("searches")), "")
    if isinstance(model, RecordedModel):
        none = F.array().cast(RecordedModel.CALLS)
        recorded = model.recorded(phase, step, retries + 1)
        asked = rows.join(recorded, "claim_id", "left").withColumn("recorded", F.coalesce("recorded", none))

        @F.pandas_udf(CALLED)
        def replay(ids: pd.Series, texts: pd.Series, recorded: pd.Series) -> pd.DataFrame:
            context = {"phase": phase, "step": step}
            found = [
                call_model(RecordedAnswers(list(calls)), p, context | {"claim_id": i}, retries)
                for i, p, calls in zip(ids, texts, recorded, strict=True)
            ]
            return pd.DataFrame(found, columns=CALLED.names)

        return asked.withColumn("called", replay("claim_id", prompt, "recorded")).drop("recorded")

    @F.pandas_udf(CALLED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        generator = model()
        most = min(at_once, getattr(generator, "at_once", None) or at_once)

        def call(i: int, c: str, p: str, k: str) -> Callable[[], tuple]:
            return lambda: call_model(generator, p, {"claim_id": i, "claim": c, "knowledge": k, "phase": phase, "step": step}, retries)

        for columns in batches:
            yield pd.DataFrame(_together([call(*row) for row in zip(*columns, strict=True)], most), columns=CALLED.names)

    # not deterministic, else a later filter would ask again
    return spread(rows).withColumn("called", run.asNondeterministic()("claim_id", "claim", prompt, knowledge))


def _searcher(searcher: Searcher, at_once: int):
    @F.pandas_udf("result string, error string")
    def run(queries: pd.Series) -> pd.DataFrame:
        def call(query: str) -> Callable[[], tuple]:
            def one() -> tuple:
                try:
                    return searcher.run(query), None
                except Exception as problem:
                    return None, f"{type(problem).__name__}: {problem}"

            return one

        return pd.DataFrame(_together([call(q) for q in queries], at_once), columns=["result", "error"])

    return run.asNondeterministic()


def start(claims: DataFrame) -> DataFrame:
    """The state before the first round. Null and blank claims are errors of their own row."""
    none = F.lit(None)
    blank = ~not_blank(F.col("claim"))
    return claims.select(
        F.col("claim_id").cast("bigint"),
        F.col("claim"),
        F.array().cast("array<struct<query: string, result: string>>").alias("searches"),
        F.array().cast("array<array<float>>").alias("query_vecs"),
        F.array().cast("array<array<float>>").alias("result_vecs"),
        F.when(blank, ERROR).otherwise(ACTIVE).alias("status"),
        none.cast("struct<response: string, answer: string>").alias("answer"),
        none.cast("string").alias("fallback_reason"),
        F.when(blank, "ValueError: a claim must hold a word").alias("error"),
        F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("input_tokens", "output_tokens", "unreported_calls")]).alias("usage"),
        F.lit(0).alias("rounds"),
    )


def _with_usage(state: DataFrame) -> DataFrame:
    added = F.struct(
        *[(F.col(f"usage.{n}") + F.col(f"called.{n}")).alias(n) for n in ("input_tokens", "output_tokens", "unreported_calls")]
    )
    return state.withColumn("usage", added)


def decide(active: DataFrame, settings: LoopSettings, model: Callable[[], Generator] | RecordedModel, step: int) -> DataFrame:
    """The active claims with the decision of this round in a column ``called``."""
    results = results_of(F.col("searches"))
    prompt = prompts.decision_prompt(F.col("claim"), results)
    if settings.diverse_prompt:
        t, limit = settings.tolerance, settings.threshold
        prompt = F.concat(
            prompt,
            prompts.hints(
                queries_of(F.col("searches")),
                similar_lately(F.col("result_vecs"), t, limit),
                similar_lately(F.col("query_vecs"), t, limit),
            ),
        )
    return ask(active, prompt, model, "decide", step, settings)


def one_round(
    active: DataFrame, settings: LoopSettings, model: Callable[[], Generator] | RecordedModel, search: TableSearch | Searcher, encoder: Encoder, step: int
) -> DataFrame:
    """The active claims after one more round: decision, repetition checks, search, history. With the guard, a
    result with a window of risk is kept away: the fixed text for no result stands for it."""
    columns = active.columns
    called = cut_lineage(_with_usage(decide(active, settings, model, step)))
    kind = F.col("called.kind")
    judged = called.where(kind != "query").withColumns(
        {
            "status": F.when(kind == "answer", FINAL).when(kind == "error", ERROR).otherwise(FALLBACK),
            "answer": F.when(kind == "answer", F.struct(F.col("called.response").alias("response"), F.col("called.value").alias("answer"))),
            "fallback_reason": F.when(kind == "invalid", NO_DECISION),
            "error": F.col("called.error"),
            "rounds": F.lit(step),
        }
    )
    asked = called.where(kind == "query").withColumn("query", F.col("called.value"))
    asked = cut_lineage(asked.withColumn("vector", encode(F.col("query"), encoder)))
    repeated = repeats_query(F.col("vector"), F.col("query_vecs"), settings.tolerance, settings.threshold) | repeats_evidence(
        F.col("result_vecs"), settings.tolerance, settings.threshold
    )
    stopped = asked.where(repeated).withColumns(
        {"status": F.lit(FALLBACK), "fallback_reason": F.lit(REPEATED), "rounds": F.lit(step)}
    )
    going = asked.where(~repeated)
    if isinstance(search, TableSearch):
        results = search.search(going, "claim_id", "query", step)
        found = going.join(results, "claim_id").withColumn("failed", F.lit(None).cast("string"))
    else:
        answered = cut_lineage(spread(going).withColumn("answered", _searcher(search, settings.calls_at_once)("query")))
        found = answered.withColumns({"result": F.col("answered.result"), "failed": F.col("answered.error")})
    if settings.guard:
        found = found.withColumn("result", F.when(scan_risk(F.col("result")) >= QUARANTINE, NO_RESULT).otherwise(F.col("result")))
    found = cut_lineage(found.withColumn("result_vector", encode(F.col("result"), encoder)))
    ok = F.col("failed").isNull()
    pair = F.struct(F.col("query"), F.col("result"))
    appended = found.withColumns(
        {
            "searches": F.when(ok, F.array_append("searches", pair)).otherwise(F.col("searches")),
            "query_vecs": F.when(ok, F.array_append("query_vecs", F.col("vector"))).otherwise(F.col("query_vecs")),
            "result_vecs": F.when(ok, F.array_append("result_vecs", F.col("result_vector"))).otherwise(F.col("result_vecs")),
            "status": F.when(ok, ACTIVE).otherwise(ERROR),
            "error": F.col("failed"),
            "rounds": F.lit(step),
        }
    )
    return judged.select(columns).unionByName(stopped.select(columns)).unionByName(appended.select(columns))


def final_verification(waiting: DataFrame, settings: LoopSettings, model: Callable[[], Generator] | RecordedModel, step: int) -> DataFrame:
    """The claims without a decision after a last prompt that takes no search query."""
    prompt = prompts.final_prompt(F.col("claim"), results_of(F.col("searches")))
    called = ask(waiting, prompt, model, "final", step, settings)
    kind = F.col("called.kind")
    return (
        _with_usage(cut_lineage(called))
        .withColumns(
            {
                "status": F.when(kind == "answer", FINAL).when(kind == "error", ERROR).otherwise(NO_VERDICT),
                "answer": F.when(kind == "answer", F.struct(F.col("called.response").alias("response"), F.col("called.value").alias("answer"))),
                "error": F.col("called.error"),
            }
        )
        .select(waiting.columns)
    )


def verify(
    claims: DataFrame,
    settings: LoopSettings,
    search: TableSearch | Searcher,
    model: ModelSettings | Generator | RecordedModel | None = None,
    encoder: Encoder | None = None,
) -> DataFrame:
    """Verified claims: one row for each of ``claims`` (claim_id, claim), whose ids are unique.

    Columns: claim_id, claim, status (final, no_verdict, error), answer (response, answer), searches,
    usage, fallback_reason, error, rounds. Claims leave the rounds with a verdict, an early stop, or no
    valid decision; all without a verdict get one final verification. Errors keep what was done so far.
    """
    given = model or ModelSettings()
    if isinstance(given, ModelSettings):
        asked = lambda: load_model(given)
    else:
        asked = given if isinstance(given, RecordedModel) else lambda: given
    encoder = encoder or HashedNgrams()
    state = cut_lineage(start(claims))
    done = [state.where(F.col("status") != ACTIVE)]
    active = state.where(F.col("status") == ACTIVE)
    for step in range(1, settings.max_steps + 1):
        if active.isEmpty():
            break
        state = cut_lineage(one_round(active, settings, asked, search, encoder, step))
        done.append(state.where(F.col("status") != ACTIVE))
        active = state.where(F.col("status") == ACTIVE)
        LOGGER.info("round %s of %s done", step, settings.max_steps)
    reason = ALL_ROUNDS if settings.max_steps else NO_ROUNDS
    whole = active.withColumns({"status": F.lit(FALLBACK), "fallback_reason": F.lit(reason)})
    for part in done:
        whole = whole.unionByName(part)
    waiting = final_verification(whole.where(F.col("status") == FALLBACK), settings, asked, settings.max_steps)
    ended = whole.where(F.col("status") != FALLBACK).unionByName(waiting)
    return ended.select("claim_id", "claim", "status", "answer", "searches", "usage", "fallback_reason", "error", "rounds")


def as_json(verified: DataFrame) -> DataFrame:
    """(claim_id, json): claim, result, searches, usage and, for errors, error; nulls kept."""
    kept = {"ignoreNullFields": "false"}
    parts = [F.col("claim"), F.col("answer").alias("result")]
    tail = [F.struct(F.col("searches").alias("google_searches")).alias("searches"), F.col("usage")]
    good = F.to_json(F.struct(*parts, *tail), kept)
    bad = F.to_json(F.struct(*parts, F.col("error"), *tail), kept)
    return verified.select("claim_id", F.when(F.col("status") == ERROR, bad).otherwise(good).alias("json"))


def readable(row_json: str) -> str:
    """A result for people: two spaces of indentation, characters as they are."""
    return json.dumps(json.loads(row_json), indent=2, ensure_ascii=False)
