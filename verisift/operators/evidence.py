"""Evidence records and the search history of claims as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.prompts import NO_KNOWLEDGE
from verisift.functions.text import fingerprint, not_blank, source_host

FIELDS = ("text", "url", "title", "provider")
#: What a missing field is taken as.
DEFAULTS = {"url": "", "title": "", "provider": "unknown"}


def ingest(records: DataFrame, fail: bool = True) -> DataFrame:
    """Evidence documents of raw records: the four known columns (absent ones get their default), all
    given, the text not blank, with derived ``source`` and ``fingerprint``.

    With ``fail`` one bad record ends the job, as a null in a given column or a blank text is an error;
    without, bad records are left out (see :func:`rejected`).
    """
    given = _known(records)
    good = _valid(given)
    if fail:
        checked = F.when(good, F.col("text")).otherwise(
            F.raise_error(F.lit("evidence needs a text that is not blank, and no nulls in url, title and provider"))
        )
        given = given.withColumn("text", checked)
    else:
        given = given.where(good)
    return given.withColumn("source", source_host(F.col("url"))).withColumn("fingerprint", fingerprint(F.col("text")))


def rejected(records: DataFrame) -> DataFrame:
    """The known columns of the records that :func:`ingest` does not take."""
    given = _known(records)
    return given.where(~_valid(given))


def _known(records: DataFrame) -> DataFrame:
    present = set(records.columns)
    return records.select(*[records[c] if c in present else F.lit(DEFAULTS.get(c)).cast("string").alias(c) for c in FIELDS])


def _valid(given: DataFrame) -> Column:
    valid = not_blank(given["text"])
    for name in FIELDS[1:]:
        valid = valid & given[name].isNotNull()
    return valid


def dedup(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(fingerprint, key, copies): one row for each text, with its smallest key. Map-side sums only."""
    rows = documents.where(F.col(text).isNotNull()).select(fingerprint(F.col(text)).alias("fingerprint"), F.col(key))
    return rows.groupBy("fingerprint").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def history(searches: DataFrame, claim: str = "claim_id", order: tuple[str, ...] = ("step", "search_id")) -> DataFrame:
    """(claim, searches): each claim's searches (query, result) in the order of ``order``. A claim makes a
    bounded number of searches; null claims have no history."""
    row = F.struct(*order, "query", "result")
    gathered = searches.where(F.col(claim).isNotNull()).groupBy(claim).agg(F.array_sort(F.collect_list(row)).alias("s"))
    return gathered.select(
        claim, F.transform("s", lambda s: F.struct(s["query"].alias("query"), s["result"].alias("result"))).alias("searches")
    )


def queries_of(searches: Column) -> Column:
    """The queries of a history in their order."""
    return F.transform(searches, lambda s: s["query"])


def results_of(searches: Column) -> Column:
    """The results of a history in their order."""
    return F.transform(searches, lambda s: s["result"])


def knowledge(searches: DataFrame, claim: str = "claim_id", empty: str = NO_KNOWLEDGE) -> DataFrame:
    """(claim, knowledge): the results of each claim in their order, a line each."""
    ordered = history(searches.where(F.col("result").isNotNull()), claim)
    text = F.nullif(F.array_join(results_of(F.col("searches")), "\n"), F.lit(""))
    return ordered.select(claim, F.coalesce(text, F.lit(empty)).alias("knowledge"))


def search_dicts(searches: Column) -> Column:
    """The history as JSON: {"google_searches": [{"query": ..., "result": ...}, ...]}."""
    return F.to_json(F.struct(searches.alias("google_searches")), {"ignoreNullFields": "false"})


def usage_totals(calls: DataFrame, by: list[str], raised: Column) -> DataFrame:
    """(by, input_tokens, output_tokens, unreported_calls, calls): token sums, nulls as 0; a call that
    raised, or lacks either count, is unreported."""
    missing = raised | F.col("input_tokens").isNull() | F.col("output_tokens").isNull()
    return calls.groupBy(*by).agg(
        F.sum(F.when(~raised, F.coalesce("input_tokens", F.lit(0))).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(~raised, F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias("output_tokens"),
        F.count_if(missing).alias("unreported_calls"),
        F.count("*").alias("calls"),
    )
