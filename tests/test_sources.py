import json

import pytest

from verisift import config
from verisift.config import LoopSettings, ModelSettings, Settings
from verisift.functions.snippets import NO_RESULT
from verisift.sources import models, search


def sender(answers):
    calls = []

    def send(url, headers, body, timeout):
        calls.append((url, headers, body))
        answer = answers[min(len(calls), len(answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return json.dumps(answer).encode()

    return send, calls


def test_retries():
    waits = []
    send, calls = sender([search.HttpError(429, "x"), ConnectionError(), TimeoutError(), {"ok": 1}])
    assert search.post_json("u", {}, {}, send=send, wait=waits.append) == {"ok": 1} and waits == [1, 2, 4] and len(calls) == 4
    for error in (search.HttpError(404, "x"), ValueError("y")):
        send, calls = sender([error])
        with pytest.raises(type(error)):
            search.post_json("u", {}, {}, send=send, wait=waits.append)
        assert len(calls) == 1
    send, calls = sender([search.HttpError(503, "x")])
    with pytest.raises(search.HttpError):
        search.post_json("u", {}, {}, max_retries=7, send=send, wait=waits.append)
    assert len(calls) == 8 and waits[-1] == 30
    send, _ = sender([[1]])
    with pytest.raises(ValueError, match="no object"):
        search.post_json("u", {}, {}, send=send)
    with pytest.raises(ValueError, match="max_retries"):
        search.post_json("u", {}, {}, max_retries=True)


def test_keyed_search():
    seen = {}

    def post(url, headers, body, timeout):
        seen.update(url=url, body=body)
        return {"knowledgeGraph": {"type": "City"}, "organic": [{"snippet": "s", "attributes": {"a": None}}, {"snippet": "late"}]}

    client = search.KeyedSearch("key", k=1, post=post)
    assert client.run("q") == "None: City. s a: None."
    assert seen["url"].endswith("/search") and seen["body"] == {"q": "q", "gl": "us", "hl": "en", "num": 1}
    assert search.KeyedSearch("key", post=lambda *a: {}).run("q") == NO_RESULT
    for bad in ({"k": 0}, {"k": True}, {"timeout": 0}, {"kind": "maps"}):
        with pytest.raises(ValueError):
            search.KeyedSearch("key", **bad)
    for key, query in (("your_key", "q"), (" ", "q"), ("key", " ")):
        with pytest.raises(ValueError):
            search.KeyedSearch(key, post=post).run(query)


def test_listed_search():
    client = search.ListedSearch(" key ", k=2, post=lambda *a: {"results": [{"content": " a "}, 5, {"content": "late"}]})
    assert client.run("q") == "a"
    assert search.ListedSearch("key", post=lambda *a: {"results": [{"content": " "}]}).run("q") == NO_RESULT
    with pytest.raises(ValueError, match="no list"):
        search.ListedSearch("key", post=lambda *a: {}).run("q")
    with pytest.raises(ValueError, match="at most 20"):
        search.ListedSearch("key", k=21)


def test_call_search_adds_the_postamble():
    asked = []
    post = lambda url, headers, body, *a: asked.append(body["q"]) or {}
    assert search.call_search("q", "serper", 1, "site:x", key="k", post=post) == NO_RESULT and asked == ["q site:x"]


def test_keys(monkeypatch):
    for value in ("", "your_key", "  "):
        monkeypatch.setenv("SERPER_API_KEY", value)
        with pytest.raises(ValueError):
            config.api_key("SERPER_API_KEY")
    monkeypatch.setenv("SERPER_API_KEY", " abc ")
    assert config.api_key("SERPER_API_KEY") == "abc"


def test_settings(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text(
        "model: {name: 'agnes:m', temperature: 0.5, max_tokens: 10, request_timeout: 60, max_api_retries: 2}\n"
        "search: {type: serper, num_searches: 3}\nrounds: {max_steps: 5, max_retries: 10, max_tolerance: 2, diverse_prompt: false}\n"
    )
    read = config.settings(config.load(file))
    assert isinstance(read, Settings) and read.loop.tolerance == 2 and read.model.organization == "agnes"
    assert read.with_provider("tavily").loop.search_type == "tavily"
    assert json.loads(read.model.as_json())["model_id"] == "m"
    file.write_text("- 1")
    with pytest.raises(ValueError):
        config.load(file)
    for bad in ({}, {"model": {}, "search": {}, "x": {"max_steps": 1, "surprise": 2}}):
        with pytest.raises(ValueError):
            config.settings(bad)


@pytest.mark.parametrize("bad", [{"max_steps": -1}, {"max_steps": True}, {"tolerance": 1}, {"num_searches": 0}, {"diverse_prompt": 1}, {"search_type": "x"}])
def test_bad_loop_settings(bad):
    with pytest.raises(ValueError):
        LoopSettings(**bad)


@pytest.mark.parametrize("bad", [{"model_name": "x"}, {"model_name": ":m"}, {"model_name": "p: "}, {"temperature": 2.1}, {"temperature": True}, {"max_tokens": 0}, {"request_timeout": float("inf")}, {"max_api_retries": -1}])
def test_bad_model_settings(bad):
    with pytest.raises(ValueError):
        ModelSettings(**bad)


def test_messages():
    assert models.message_text(["a", {"type": "text", "text": "b"}, {"type": "image"}, 5]) == "a\nb"
    assert models.message_text(None) == ""
    message = type("M", (), {"response_metadata": {"token_usage": {"prompt_tokens": 3, "completion_tokens": 4}}})()
    assert models.message_usage(message) == {"input_tokens": 3, "output_tokens": 4}
    with pytest.raises(ValueError, match="unknown model provider"):
        models.load_model(ModelSettings("nobody:m"))


def test_corpus_search(spark):
    rows = [(1, "alpha bridge tunnel"), (2, "alpha bridge"), (3, "gamma"), (4, None)] + [(i, "filler words") for i in range(5, 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = search.CorpusSearch(docs, "doc_id", "text", 2)
    asked = spark.createDataFrame([(1, "Alpha BRIDGE tunnel"), (2, "nothing here"), (3, None), (4, "bridge filler")], "q int, query string")
    ranked = sorted((r.q, r["rank"], r.document, r.score) for r in found.ranked(asked, "q", "query").collect())
    assert ranked == [(1, 1, 1, 3), (1, 2, 2, 2), (4, 1, 1, 1), (4, 2, 2, 1)]
    texts = {r.q: r.result for r in found.search(asked, "q", "query").collect()}
    assert texts[1] == "alpha bridge tunnel alpha bridge" and texts[2] == texts[3] == NO_RESULT


def test_corpus_search_counts_frequent_terms(spark):
    docs = spark.createDataFrame([(i, "bridge tunnel" if i == 9 else "bridge") for i in range(20)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "bridge tunnel"), (2, "bridge")], "q int, query string")
    ranked = search.CorpusSearch(docs, "doc_id", "text", 2).ranked(asked, "q", "query").collect()
    assert sorted((r.q, r["rank"], r.document, r.score) for r in ranked) == [(1, 1, 9, 2), (1, 2, 0, 1), (2, 1, 0, 1), (2, 2, 1, 1)]


def test_data_source(spark):
    search.register(spark)
    rows = spark.read.format("websearch").option("queries", '["a", "b"]').option("provider", "serper").load().collect()
    assert sorted(r.query for r in rows) == ["a", "b"] and all("SERPER_API_KEY" in r.error for r in rows)
