"""Texts out of the answers of search providers, by native JSON functions.

Answers are read leniently: what is not of the expected kind is skipped, element by element. Columns
hold the provider's JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions.text import not_blank, strip

# Fixed value: what stands for the result of a search that found nothing.
NO_RESULT = "No good Google Search result was found"
#: Where each kind of search has its results.
RESULT_KEYS = {"search": "organic", "news": "news", "places": "places", "images": "images"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _text(parsed: Column, path: str) -> Column:
    """A field of a parsed answer if it is a text, else null."""
    field = F.try_variant_get(parsed, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(parsed, path, "string"))


def _printed(value: Column) -> Column:
    """A value as Python prints it: the words for truth values and null are its own."""
    return (
        F.when(value.isNull(), "None").when(value == "true", "True").when(value == "false", "False").otherwise(value)
    )


def _attributes(entries: Column, subject: Column | None) -> Column:
    """'name: value.' of each attribute in their order, behind the subject if there is one."""
    name = lambda e: e["key"] if subject is None else F.concat(subject, F.lit(" "), e["key"])
    lines = F.transform(F.map_entries(entries), lambda e: F.concat(name(e), F.lit(": "), _printed(e["value"]), F.lit(".")))
    return F.coalesce(lines, F.array().cast("array<string>"))


def _given(value: Column) -> Column:
    return F.when(value != "", value)


#: Parts of an answer as JSON text; attributes as a map, which keeps their order.
_PARTS = "answerBox string, knowledgeGraph string, {} array<string>"
_ATTRIBUTES = "attributes map<string,string>"


def _box_texts(box: Column) -> Column:
    return F.array(
        _given(_text(box, "$.answer")),
        F.replace(_given(_text(box, "$.snippet")), F.lit("\n"), F.lit(" ")),
        _given(_text(box, "$.snippetHighlighted")),
    )


def _marked_texts(box: Column) -> Column:
    marked = F.try_variant_get(box, "$.snippetHighlighted", "array<variant>")
    texts = F.transform(marked, lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string")))
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), not_blank)


def _graph_texts(graph: Column) -> Column:
    """Of (parsed, attributes) of a knowledge graph."""
    parsed = graph["parsed"]
    title = _printed(F.try_variant_get(parsed, "$.title", "string"))
    kind, about = F.try_variant_get(parsed, "$.type", "string"), _text(parsed, "$.description")
    said = F.array(
        F.when(_given(kind).isNotNull(), F.concat(title, F.lit(": "), kind, F.lit("."))), F.when(not_blank(about), about)
    )
    return F.concat(said, _attributes(graph["attributes"], title))


def _result_texts(result: Column) -> Column:
    """Of (text, attributes) of one result."""
    snippet = F.array(F.when(not_blank(result["text"]), result["text"]))
    return F.concat(snippet, _attributes(result["attributes"], None))


def keyed_snippets(json: Column, k: int, kind: str = "search") -> Column:
    """Texts of an answer with answer box, knowledge graph and results, in this order; of the results the
    first ``k`` are looked at. An answer with nothing gives the fixed text for no result."""
    key = RESULT_KEYS[kind]
    none = F.array().cast("array<string>")

    def found(parts: Column) -> Column:
        box = _let(F.try_parse_json(parts["answerBox"]), lambda v: F.concat(_box_texts(v), _marked_texts(v)))
        graph = F.struct(
            F.try_parse_json(parts["knowledgeGraph"]).alias("parsed"),
            F.from_json(parts["knowledgeGraph"], _ATTRIBUTES)["attributes"].alias("attributes"),
        )
        results = F.transform(
            F.slice(parts[key], 1, k),
            lambda r: F.struct(
                _text(F.try_parse_json(r), "$.snippet").alias("text"), F.from_json(r, _ATTRIBUTES)["attributes"].alias("attributes")
            ),
        )
        of_results = F.flatten(F.transform(results, _result_texts))
        return F.concat(F.coalesce(box, none), F.coalesce(_let(graph, _graph_texts), none), F.coalesce(of_results, none))

    texts = F.filter(_let(F.from_json(json, _PARTS.format(key)), found), lambda t: t.isNotNull())
    return _let(texts, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(NO_RESULT))))


def keyed_result(json: Column, k: int, kind: str = "search") -> Column:
    """The texts of :func:`keyed_snippets`, joined by spaces."""
    return F.array_join(keyed_snippets(json, k, kind), " ")


def listed_result(json: Column, k: int) -> Column:
    """Contents of the first ``k`` results of an answer that is a list of results: stripped, blank ones left
    out, joined by blank lines. An answer without such a list is an error."""
    results = F.from_json(json, "results string")["results"]
    listed = F.when(results.startswith("["), F.from_json(results, "array<string>"))
    contents = F.transform(F.slice(listed, 1, k), lambda r: strip(_text(F.try_parse_json(r), "$.content")))
    text = F.array_join(F.filter(contents, not_blank), "\n\n")
    no_list = F.raise_error(F.lit("the answer of the search has no list of results"))
    return joined_or_default(F.when(listed.isNull(), no_list).otherwise(text))


def joined_or_default(text: Column) -> Column:
    """The text, or the fixed text for no result where it is empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_RESULT))
