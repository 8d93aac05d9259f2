"""Search providers: clients of web services, a search over a corpus table, a Python data source.

A searcher for use in a worker gives the text of one query. The corpus searcher works on whole tables.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verisift.config import SEARCH_KEYS, api_key, check_search
from verisift.functions.snippets import NO_RESULT, RESULT_KEYS
from verisift.operators.joins import sized_join
from verisift.session import cut_lineage

# Addresses of the services.
KEYED_URL = "https://google.serper.dev"
LISTED_URL = "https://api.tavily.com/search"
#: Answers after which a request is made again, beside all of 500 to 599.
AGAIN = (408, 429)
LONGEST_WAIT = 30


class Searcher(Protocol):
    """Gives the text found for a query."""

    def run(self, query: str) -> str: ...


class HttpError(OSError):
    """An answer with an error status."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(f"HTTP {status}: {message}")
        self.status = status


def _send(url: str, headers: dict[str, str], body: dict, timeout: float) -> bytes:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.read()
    except urllib.error.HTTPError as error:
        raise HttpError(error.code, str(error.reason)) from error


def post_json(
    url: str, headers: dict[str, str], body: dict, timeout: float = 30, max_retries: int = 3,
    send: Callable[[str, dict[str, str], dict, float], bytes] = _send, wait: Callable[[float], None] = time.sleep,
) -> dict:
    """The JSON object a service answers with. Lost connections, timeouts and the statuses of AGAIN and 5xx
    are tried again up to ``max_retries`` times, after 1, 2, 4 and so on, at most 30 seconds; other
    statuses and answers that are no object are errors."""
    if type(max_retries) is not int or max_retries < 0:
        raise ValueError("max_retries must be an integer of at least 0")
    for attempt in range(max_retries + 1):
        try:
            read = json.loads(send(url, headers, body, timeout))
            break
        except HttpError as error:
            passing = error.status in AGAIN or 500 <= error.status < 600
            if not passing or attempt == max_retries:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if attempt == max_retries:
                raise
        wait(min(2**attempt, LONGEST_WAIT))
    if not isinstance(read, dict):
        raise ValueError("the service answered with JSON that is no object")
    return read


def _need(name: str, value: str) -> str:
    if not isinstance(value, str) or not value.strip() or (name == "key" and value.strip().lower().startswith("your_")):
        raise ValueError(f"{name} must be a text that is not blank")
    return value


def _texts(box: Any, graph: Any, results: list, k: int) -> Iterator[str]:
    """Texts of an answer with answer box, knowledge graph and results; the row-wise twin of
    functions.snippets.keyed_snippets, for use inside a worker."""
    if box:
        for name in ("answer", "snippet"):
            value = box.get(name)
            if isinstance(value, str) and value:
                yield value.replace("\n", " ") if name == "snippet" else value
        marked = box.get("snippetHighlighted") or []
        yield from [marked] if isinstance(marked, str) else [m for m in marked if isinstance(m, str) and m.strip()]
    if graph:
        title = graph.get("title")
        if graph.get("type"):
            yield f"{title}: {graph['type']}."
        about = graph.get("description")
        if isinstance(about, str) and about.strip():
            yield about
        yield from (f"{title} {name}: {value}." for name, value in (graph.get("attributes") or {}).items())
    for result in filter(lambda r: isinstance(r, dict), results[:k]):
        text = result.get("snippet")
        if isinstance(text, str) and text.strip():
            yield text
        yield from (f"{name}: {value}." for name, value in (result.get("attributes") or {}).items())


class KeyedSearch:
    """Web search whose answers have an answer box, a knowledge graph and keyed results."""

    def __init__(
        self, key: str | None = None, k: int = 1, gl: str = "us", hl: str = "en", tbs: str | None = None,
        kind: str = "search", timeout: float = 30, post: Callable[..., dict] = post_json,
    ) -> None:
        check_search("serper", k)
        if isinstance(timeout, bool) or not isinstance(timeout, int | float) or not 0 < timeout < float("inf"):
            raise ValueError("timeout must be finite and positive")
        if kind not in RESULT_KEYS:
            raise ValueError(f"kind of search must be one of {', '.join(RESULT_KEYS)}")
        self.key, self.k, self.gl, self.hl, self.tbs, self.kind, self.timeout, self.post = key, k, gl, hl, tbs, kind, timeout, post

    def fetch(self, query: str, **more: Any) -> dict:
        key = _need("key", self.key if self.key is not None else api_key(SEARCH_KEYS["serper"]))
        body = {"q": _need("query", query), "gl": self.gl, "hl": self.hl, "num": self.k, "tbs": self.tbs} | more
        given = {name: value for name, value in body.items() if value is not None}
        return self.post(f"{KEYED_URL}/{self.kind}", {"X-API-KEY": key}, given, self.timeout)

    def run(self, query: str) -> str:
        answer = self.fetch(query)
        found = list(_texts(answer.get("answerBox"), answer.get("knowledgeGraph"), answer.get(RESULT_KEYS[self.kind]) or [], self.k))
        return " ".join(found or [NO_RESULT])


class ListedSearch:
    """Web search whose answers are a list of results."""

    def __init__(self, key: str | None = None, k: int = 3, timeout: float = 30, post: Callable[..., dict] = post_json) -> None:
        check_search("tavily", k)
        if isinstance(timeout, bool) or not isinstance(timeout, int | float) or not 0 < timeout < float("inf"):
            raise ValueError("timeout must be finite and positive")
        self.key, self.k, self.timeout, self.post = key, k, timeout, post

    def run(self, query: str, max_retries: int = 3) -> str:
        key = _need("key", self.key if self.key is not None else api_key(SEARCH_KEYS["tavily"])).strip()
        body = {
            "query": _need("query", query), "max_results": self.k, "topic": "general", "search_depth": "basic",
            "auto_parameters": False, "include_answer": False, "include_raw_content": False, "include_images": False,
        }
        answer = self.post(LISTED_URL, {"Authorization": f"Bearer {key}"}, body, self.timeout, max_retries)
        results = answer.get("results")
        if not isinstance(results, list):
            raise ValueError("the answer of the search has no list of results")
        contents = [r.get("content") for r in results[: self.k] if isinstance(r, dict)]
        found = [c.strip() for c in contents if isinstance(c, str) and c.strip()]
        return "\n\n".join(found) if found else NO_RESULT


def searcher(provider: str, k: int, **options: Any) -> Searcher:
    """The client of a web provider."""
    check_search(provider, k)
    clients = {"serper": KeyedSearch, "tavily": ListedSearch}
    if provider not in clients:
        raise ValueError(f"{provider} is no web search; give its table to CorpusSearch")
    return clients[provider](k=k, **options)


def call_search(query: str, provider: str = "serper", k: int = 3, postamble: str = "", **options: Any) -> str:
    """The text a web provider finds for a query, to which ``postamble`` is added behind a space."""
    return searcher(provider, k, **options).run(f"{query} {postamble}" if postamble else query)


class ScriptedSearch:
    """Answers from a mapping of queries to texts; an exception in it is raised. For tests and replays."""

    def __init__(self, answers: dict[str, str | Exception], default: str = NO_RESULT) -> None:
        self.answers, self.default = answers, default

    def run(self, query: str) -> str:
        answer = self.answers.get(query, self.default)
        if isinstance(answer, Exception):
            raise answer
        return answer


#: Letters of a word that counts in a corpus search.
TERM_LETTERS = 5


#: Terms of the queries that are compared with all documents in one pass, and bytes of a batch's scores.
BLOCK_TERMS, SCORE_BYTES = 200_000, 8 << 20


class CorpusSearch:
    """Search over a table of documents: the ``k`` documents with most of the query's distinct terms.

    Terms are words of at least five letters without case, however many documents they stand in; they are
    compared by a hash of 64 bits. The documents' terms are cut once, by the first search. Each block of
    queries, of at most about BLOCK_TERMS terms, is broadcast and scored against every document where the
    document is; what is shuffled is the ``k`` best documents of each query in each task, never the
    pairs of queries and documents. Documents without an id are left out; each row is a document.
    """

    def __init__(self, documents: DataFrame, key: str, text: str, k: int = 3) -> None:
        self.k = k
        self.texts = documents.select(F.col(key).alias("document"), F.col(text).alias("text"))
        self._postings: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(document, terms): hashes of each document's distinct terms, cut."""
        if self._postings is None:
            hashed = self.texts.select("document", term_hashes(F.col("text")).alias("terms"))
            self._postings = cut_lineage(hashed.where((F.size("terms") > 0) & F.col("document").isNotNull()))
        return self._postings

    def ranked(self, queries: DataFrame, key: str, query: str) -> DataFrame:
        """(key, rank, document, score): the best documents of each query, ties by the smaller document. Null
        queries and those without a term have none; queries of one key count as one."""
        asked = cut_lineage(queries.select(F.col(key).alias("query"), F.explode(term_hashes(F.col(query))).alias("term")).distinct())
        blocks = -(-asked.count() // BLOCK_TERMS)
        schema = f"query {dict(asked.dtypes)['query']}, document {dict(self.texts.dtypes)['document']}, score bigint"
        best = queries.sparkSession.createDataFrame([], schema)
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
            shared = queries.sparkSession.sparkContext.broadcast(_by_term(part.toArrow()))  # a block
            found = self.postings.mapInArrow(_best_of_task(shared, self.k), schema)
            if blocks > 1:  # so that one block at a time is held
                found = cut_lineage(found)
                shared.destroy()
            best = best.unionAll(found)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "document")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select(
            F.col("query").alias(key), "rank", "document", "score"
        )

    def search(self, queries: DataFrame, key: str, query: str, step: int = 1) -> DataFrame:
        """(key, result): texts of the best documents in their order, joined by spaces; the fixed text for
        queries that find nothing."""
        ranked = cut_lineage(self.ranked(queries, key, query))
        texts = sized_join(self.texts, ranked, ["document"]).groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found")  # at most k
        )
        joined = F.array_join(F.transform("found", lambda f: f["text"]), " ")
        return queries.select(key).distinct().join(texts, key, "left").select(
            key, F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_RESULT)).alias("result")
        )


class RecordedSearch:
    """Results of a table of searches (search_id, claim_id, step, result): that of the claim and step, of the smallest
    id where there are several; the fixed text where it is null, empty or missing."""

    def __init__(self, searches: DataFrame) -> None:
        named = searches.where("claim_id IS NOT NULL").groupBy("claim_id", "step")
        self.results = named.agg(F.min_by("result", "search_id").alias("recorded"))

    def search(self, queries: DataFrame, key: str, query: str, step: int = 1) -> DataFrame:
        here = self.results.where(F.col("step") == step).select(F.col("claim_id").alias(key), "recorded")
        return queries.select(key).join(here, key, "left").select(
            key, F.coalesce(F.nullif(F.col("recorded"), F.lit("")), F.lit(NO_RESULT)).alias("result")
        )


#: Searchers that answer a whole table of queries.
TableSearch = CorpusSearch | RecordedSearch


def terms(text):
    """Distinct words of at least five letters, without case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{TERM_LETTERS},}}"), F.lit(0))
    return F.array_distinct(words)


def term_hashes(text):
    """Hashes of the distinct terms; null for null."""
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def _by_term(asked: pa.Table) -> tuple:
    """Of (query, term): the queries, the terms in order, where the queries of each begin and end, and their
    numbers in the order of the terms."""
    coded = asked.column("query").combine_chunks().dictionary_encode()
    numbers, hashes = coded.indices.to_numpy(zero_copy_only=False), asked.column("term").to_numpy()
    order = np.lexsort((numbers, hashes))
    vocabulary, starts = np.unique(hashes[order], return_index=True)
    return coded.dictionary, vocabulary, starts, np.append(starts[1:], len(order)), numbers[order]


def _best_of_task(shared: Any, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of (document, terms) that gives (query, document, score) of the ``k`` best
    documents in a task for each query of a block (as of _by_term, broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, starts, ends, owners = shared.value
        documents, kind = [], None
        scores, places = np.zeros((len(names), k), np.int32), np.full((len(names), k), -1)
        rows = max(1, SCORE_BYTES // (4 * len(names)))
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                first = len(documents)
                documents += part.column(0).to_pylist()
                found = _scores(part.column(1), vocabulary, starts, ends, owners, len(names))
                scores, places = _merged(scores, places, found, first, documents, k)
        if kind is None:
            return
        query, nth = np.nonzero(scores)
        taken = pa.array([documents[p] for p in places[query, nth]], kind)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), taken, pa.array(scores[query, nth], pa.int64())], ["query", "document", "score"])

    return run


def _scores(terms: pa.Array, vocabulary: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, queries: int) -> np.ndarray:
    """How many of a query's terms each document has, as a matrix of queries and documents."""
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    document = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    at, document = at[known], document[known]
    counts = ends[at] - starts[at]
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    query = owners[np.repeat(starts[at], counts) + nth]
    cells = np.bincount(query * len(terms) + np.repeat(document, counts), minlength=queries * len(terms))
    return cells.reshape(queries, len(terms))


def _merged(scores: np.ndarray, places: np.ndarray, found: np.ndarray, first: int, documents: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of what was best so far and of the documents from number ``first`` on; ties by the
    smaller document."""
    kept = np.unique(places[places >= 0])
    present = np.concatenate([kept, np.arange(first, len(documents))])
    order = sorted(range(len(present)), key=lambda i: documents[present[i]])
    rank = np.empty(len(present), np.int64)
    rank[order] = np.arange(len(present))
    of = lambda p: rank[np.searchsorted(present, p)]
    width = len(present) + 1
    before = np.where(places >= 0, scores * np.int64(width) - of(np.maximum(places, present[0])), 0)
    now = np.where(found > 0, found * np.int64(width) - of(np.arange(first, len(documents))), 0)
    keys = np.concatenate([before, now], axis=1)
    numbers = np.concatenate([places, np.broadcast_to(np.arange(first, len(documents)), found.shape)], axis=1)
    best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
    keys, numbers = np.take_along_axis(keys, best, 1), np.take_along_axis(numbers, best, 1)
    return np.where(keys > 0, -(-keys // width), 0).astype(np.int32), np.where(keys > 0, numbers, -1)


class WebSearchSource(DataSource):
    """Data source ``websearch``: options ``queries`` (a JSON list), ``provider``, ``k`` and ``postamble``;
    one partition, so one request at a time, for each query. Read it once and write it: reading again
    asks again."""

    @classmethod
    def name(cls) -> str:
        return "websearch"

    def schema(self) -> str:
        return "query string, result string, error string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _WebSearchReader(dict(self.options))


class _WebSearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        query, result, error = partition.value, None, None
        try:
            result = call_search(
                query, self.options.get("provider", "serper"), int(self.options.get("k", "3")), self.options.get("postamble", "")
            )
        except Exception as problem:  # one failed query is a row
            error = f"{type(problem).__name__}: {problem}"
        yield pa.RecordBatch.from_pydict(
            {"query": [query], "result": [result], "error": [error]},
            pa.schema([("query", pa.string()), ("result", pa.string()), ("error", pa.string())]),
        )


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("websearch")`` known."""
    spark.dataSource.register(WebSearchSource)
