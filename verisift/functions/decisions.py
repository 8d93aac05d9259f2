"""Reading a decision out of free model output.

Free text is read by a Python function over Arrow batches, as no native parser of JSON follows the
same rules; all that is decided on what was read are native expressions.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.text import normalize_label, not_blank, strip

ANSWER_KEY, QUERY_KEY = "final_answer", "search_query"

#: What is read: whether there is an object at all, which keys it has, and their values with their kinds.
DECISION = T.StructType(
    [
        T.StructField("keys", T.IntegerType()),
        T.StructField("has_answer", T.BooleanType()),
        T.StructField("answer", T.StringType()),
        T.StructField("has_query", T.BooleanType()),
        T.StructField("query", T.StringType()),
    ]
)


def read_object(output: str | None) -> dict | None:
    """The JSON object of a model's output: the whole text if it is JSON (null if that is no object), else
    the last object that stands in it and is not part of another."""
    if not isinstance(output, str) or not output.strip():
        return None
    try:
        whole = json.loads(output)
    except json.JSONDecodeError:
        whole = _last_object(output)
    return whole if isinstance(whole, dict) else None


def _last_object(output: str) -> dict | None:
    read, found, at = json.JSONDecoder().raw_decode, None, output.find("{")
    while at >= 0:
        try:
            found, after = read(output, at)
        except json.JSONDecodeError:
            after = at + 1
        at = output.find("{", after)
    return found


def label(value: Any) -> str | None:
    """'True' or 'False' for a truth value or one of these words in any case, padded or not; else null."""
    word = str(value).strip().lower() if isinstance(value, bool | str) else ""
    return {"true": "True", "false": "False"}.get(word)


def decision_of(output: str | None) -> tuple[str, str | None]:
    """(kind, value) of a decision: ('answer', label), ('query', query) or ('invalid', null)."""
    found = read_object(output)
    if found is None or (ANSWER_KEY in found) == (QUERY_KEY in found):
        return "invalid", None
    if ANSWER_KEY in found:
        answer = label(found[ANSWER_KEY])
        return ("answer", answer) if answer else ("invalid", None)
    query = found[QUERY_KEY]
    return ("query", query.strip()) if isinstance(query, str) and query.strip() else ("invalid", None)


def final_answer_of(output: str | None) -> str | None:
    """The label of a final answer; null for output without one, or with a search query."""
    found = read_object(output)
    return label(found.get(ANSWER_KEY)) if found and QUERY_KEY not in found else None


def _row(output: str | None) -> tuple:
    try:
        found = read_object(output)
    except (RecursionError, ValueError):  # nested too deeply, or a number of too many digits
        found = None
    if found is None:
        return None, False, None, False, None
    answer, query = found.get(ANSWER_KEY), found.get(QUERY_KEY)
    return (
        len(found),
        ANSWER_KEY in found,
        str(answer) if isinstance(answer, bool | str) else None,
        QUERY_KEY in found,
        query if isinstance(query, str) else None,
    )


@F.pandas_udf(DECISION)
def read_decision(output: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame([_row(o) for o in output], columns=DECISION.names)
    frame["keys"] = frame["keys"].astype("Int32")
    return frame


def decision_kind(read: Column) -> Column:
    """'answer', 'query' or 'invalid' of what :data:`read_decision` gives: exactly one of the two keys, and
    its value is a label or a text that is not blank."""
    one = read["has_answer"] != read["has_query"]
    return (
        F.when(one & read["has_answer"] & normalize_label(read["answer"]).isNotNull(), "answer")
        .when(one & read["has_query"] & not_blank(read["query"]), "query")
        .otherwise("invalid")
    )


def decision_value(read: Column) -> Column:
    """The label or the stripped query; null for an invalid decision."""
    kind = decision_kind(read)
    return F.when(kind == "answer", normalize_label(read["answer"])).when(kind == "query", strip(read["query"]))


def final_label(read: Column) -> Column:
    """The label of a final answer; null where there is none, or a search query beside it."""
    valid = (read["keys"] > 0) & ~read["has_query"]
    return F.when(valid, normalize_label(read["answer"]))
