import hashlib
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verisift.functions import decisions, prompts, similarity, snippets, text


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("o")).collect()[0].o


def many(spark, values, function, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, f"i int, v {kind}").select("i", function(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(found, key=lambda r: r.i)]


def test_strip_and_blank(spark):
    values = [f"{c}x y{c}" for c in text.WHITESPACE] + ["", "   ", None, "\u200bx"]
    assert many(spark, values, text.strip) == [None if v is None else v.strip() for v in values]
    assert many(spark, values, text.not_blank) == [bool(v and v.strip()) for v in values]


def test_labels(spark):
    values = ["true", " FALSE ", "True", "1", "yes", "", None, "\u00a0true\u2003"]
    assert many(spark, values, text.normalize_label) == ["True", "False", "True", None, None, None, None, "True"]
    assert [decisions.label(v) for v in (True, False, 1, 0, None, " tRue ")] == ["True", "False", None, None, None, "True"]


def test_hosts(spark):
    expected = {
        "https://User:pw@WWW.Ex.com:8080/p": "www.ex.com", "http://ex.com/a b|c": "ex.com", "http://a_b.com/x": "",
        "ftp://ex.com": "", "ex.com/x": "", "http://[::1]/": "", "http://münchen.de/": "", "": "", None: "",
        "http://ex.com:abc/": "ex.com", "http://a@b@c.com/": "c.com", "HTTPS://A.B?x": "a.b", " \thttp://ex.com#f": "ex.com",
    }
    assert dict(zip(expected, many(spark, list(expected), text.source_host), strict=True)) == expected


def test_hosts_like_the_standard_library(spark):
    urls = ["http://Ex.com", "http://u@h.io:1/p?q#f", "https://h-1.io?x=@y", "http://h", "http:///p", "https://h:/", "http://h\tx.io/"]

    def expected(url):
        parts = urlsplit(url)
        host = parts.hostname or ""
        return host if parts.scheme in ("http", "https") and all(c.isalnum() or c in ".-" for c in host) else ""

    assert many(spark, urls, text.source_host) == [expected(u) for u in urls]


def test_fingerprint(spark):
    values = ["", "a", "né 漢字", None]
    assert many(spark, values, text.fingerprint) == [v and hashlib.sha256(v.encode()).hexdigest()[:16] or (None if v is None else hashlib.sha256(b"").hexdigest()[:16]) for v in values]


def test_backoff_postamble_segments(spark):
    assert many(spark, [0, 1, 3, 7], text.backoff_seconds, "int") == [[], [1], [1, 2, 4], [1, 2, 4, 8, 16, 30, 30]]
    assert one(spark, "q", lambda c: text.with_postamble(c, "site:x")) == "q site:x"
    assert one(spark, "q", text.with_postamble) == "q"
    assert one(spark, " a ", lambda c: text.segment_join([c, [F.lit(" b ")], F.lit("c ")], "|")) == "a| b |c"


def test_prompts(spark):
    assert one(spark, ["see [STATEMENT]"], lambda r: prompts.fill("K:[KNOWLEDGE] S:[STATEMENT] ", F.lit(" c  "), r[0]), "array<string>") == "K:see [STATEMENT] S: c"
    assert many(spark, [[], [""], ["", ""], ["a", "b"]], prompts.knowledge, "array<string>") == ["N/A", "N/A", "\n", "a\nb"]
    whole = one(spark, [], lambda r: prompts.decision_prompt(F.lit("The claim."), r), "array<string>")
    assert "\nN/A\n" in whole and whole.endswith("The claim.")
    assert "N/A" not in one(spark, [], lambda r: prompts.final_prompt(F.lit("c"), r), "array<string>")


@pytest.mark.parametrize(
    ("output", "expected"),
    [
        ('{"final_answer":"True"}', ("answer", "True")),
        ('[{"final_answer":"True"}]', ("invalid", None)),
        ('a {"search_query":"q"} b {"final_answer":"False"}', ("answer", "False")),
        ('x {"a":{"final_answer":"True"}}', ("invalid", None)),
        ('x { bad {"final_answer":"True"}', ("answer", "True")),
        ("{'final_answer':'True'}", ("invalid", None)),
        ('{"final_answer":"True"} done', ("answer", "True")),
        ("", ("invalid", None)),
        (None, ("invalid", None)),
        ('{"final_answer":true}', ("answer", "True")),
        ('{"final_answer":1}', ("invalid", None)),
        ('{"final_answer":"True","search_query":"q"}', ("invalid", None)),
        ('{"search_query":"  "}', ("invalid", None)),
        ('{"search_query":" q "}', ("query", "q")),
        ('{"search_query":5}', ("invalid", None)),
        ('{"search_query":"a","search_query":"b"}', ("query", "b")),
    ],
)
def test_decisions(spark, output, expected):
    assert decisions.decision_of(output) == expected
    read = one(spark, output, lambda c: F.struct(decisions.decision_kind(decisions.read_decision(c)), decisions.decision_value(decisions.read_decision(c))))
    assert tuple(read) == expected


def test_final_answers(spark):
    outputs = ['{"final_answer":"True","search_query":""}', "{}", '{"final_answer":"false"}', '{"other":1}', None]
    expected = [None, None, "False", None, None]
    assert [decisions.final_answer_of(o) for o in outputs] == expected
    assert many(spark, outputs, lambda c: decisions.final_label(decisions.read_decision(c))) == expected


def history(spark, vectors, function):
    return one(spark, vectors, function, "array<array<float>>")


@pytest.mark.parametrize(
    ("tolerance", "length", "query", "evidence"),
    [(2, 0, False, False), (2, 1, True, False), (2, 2, True, True), (3, 1, False, False), (3, 2, True, False), (3, 3, True, True)],
)
def test_early_stops(spark, tolerance, length, query, evidence):
    vector = F.array(F.lit(1.0), F.lit(0.0))
    past = [[1.0, 0.0]] * length
    assert history(spark, past, lambda h: similarity.repeats_query(vector, h, tolerance)) is query
    assert history(spark, past, lambda h: similarity.repeats_evidence(h, tolerance)) is evidence


def test_threshold_is_strict(spark):
    exact = [[0.6, 0.8]]
    count = lambda limit: history(spark, exact, lambda h: similarity.count_similar(F.array(F.lit(1.0), F.lit(0.0)), h, limit))
    cos = history(spark, exact, lambda h: similarity.cosine(h[0], F.array(F.lit(1.0), F.lit(0.0))))
    assert count(cos) == 0 and count(cos - 1e-6) == 1
    assert history(spark, [], lambda h: similarity.count_similar(F.array(F.lit(1.0)), h)) == 0
    assert history(spark, [[0.0, 0.0]], lambda h: similarity.cosine(h[0], h[0])) == 0.0


def test_hints(spark):
    assert history(spark, [[1.0, 0.0]], lambda h: similarity.similar_lately(h, 2)) is True
    assert history(spark, [], lambda h: similarity.similar_lately(h, 2)) is False
    assert history(spark, [[1.0, 0.0], [0.0, 1.0]], lambda h: similarity.similar_lately(h, 3)) is False
    shown = one(spark, ["a", "b"], lambda q: prompts.hints(q, F.lit(True), F.lit(True)), "array<string>")
    assert shown == prompts.DIVERSE_HINT + prompts.EVIDENCE_HINT + prompts.QUERY_HINT
    assert one(spark, ["a"], lambda q: prompts.hints(q, F.lit(False), F.lit(False)), "array<string>") == ""


def test_encoder(spark):
    values = ["Hello world", "hello WORLD!", "", None]
    found = many(spark, values, lambda c: similarity.encode(c, similarity.HashedNgrams(32)))
    assert found[0] == found[1] and found[3] is None and set(found[2]) == {0.0}


def test_keyed_snippets(spark):
    answers = [
        "{}", '{"knowledgeGraph":{"type":"City"}}', "nonsense", None,
        '{"answerBox":{"answer":"a","snippet":"x\\ny","snippetHighlighted":["h"," ",5]},"organic":[{"snippet":"s\\n1","attributes":{"b":true,"a":null}},5,{"snippet":"late"}]}',
        '{"answerBox":{"answer":5,"snippetHighlighted":"one"}}',
    ]
    found = many(spark, answers, lambda c: snippets.keyed_result(c, 2))
    assert found == [snippets.NO_RESULT, "None: City.", snippets.NO_RESULT, snippets.NO_RESULT, "a x y h s\n1 b: True. a: None.", "one"]
    assert one(spark, '{"news":[{"snippet":"n"}],"organic":[{"snippet":"o"}]}', lambda c: snippets.keyed_result(c, 1, "news")) == "n"


def test_listed_snippets(spark):
    assert one(spark, '{"results":[{"content":" a "},{"content":""},{"content":"c"}]}', lambda c: snippets.listed_result(c, 3)) == "a\n\nc"
    assert one(spark, '{"results":[]}', lambda c: snippets.listed_result(c, 3)) == snippets.NO_RESULT
    with pytest.raises(Exception, match="no list of results"):
        one(spark, '{"results":{}}', lambda c: snippets.listed_result(c, 3))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}"final_swerquhyTF:, \\n[]', max_size=60))
def test_reading_never_fails(output):
    assert decisions.decision_of(output)[0] in ("answer", "query", "invalid")


def test_output_nested_too_deeply_is_invalid(spark):
    deep = '[{"a":' * 10_000
    read = lambda c: decisions.decision_kind(decisions.read_decision(c))
    assert many(spark, [deep, "1" * 10_000, '{"final_answer": "True"}'], read) == ["invalid", "invalid", "answer"]


def test_letter_counts():
    assert similarity.LetterCounts().encode(["aAbz É"])[0] == [2.0, 1.0] + [0.0] * 23 + [1.0]
