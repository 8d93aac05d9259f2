"""Problem 6: evaluation texts leaking into training text.

Method: latent semantic retrieval. The held-out items are cut into passages; their TF-IDF matrix, with
document frequencies counted over the whole corpus, gets a distributed randomised SVD (sketches A'AQ summed
over partitions by blocks of terms, one subspace iteration, Rayleigh-Ritz). Windows of all documents are
projected into the latent space and compared by the cosine there with the passages, of which an index of
centroids gives the near ones. What that search may miss is found whatever frequency, rank and index are:
documents that share a run of words with an item, looked up by hash, and documents that hold two thirds of an
item's words, by a prefix of its rarest words. All candidates are checked by the longest common run and the
longest common subsequence of words over the whole document; a latent candidate that has half of the words in
order, and the item's answer word by word, is a paraphrase, if few items have that answer.

The corpus is read once: its words are encoded as numbers of the items' vocabulary and kept in the
checkpoint folder for the two passes that follow, one for the frequencies, one for search and check, however
many items there are. Nothing of the corpus is shuffled but counts and the leaks; items, vocabulary and
latent space are of the size of the held-out set, which is checked.

Defined results for odd input: null and blank texts, of documents as of items, leak nothing; items
shorter than the shortest run can only be found by two thirds of their words; copies of a document are
found one by one, copies of an item too; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verisift.llm.lookalikes import _PY, SUSPECT_RANGES, looks_like
from verisift.session import cut_lineage

#: Consecutive words of an item that are a leak by themselves.
MIN_RUN = 15
#: Share of an item's words in order that is a leak.
MIN_SHARE = 2 / 3
#: Words of a window of a document, and the step from one to the next. A run of MIN_RUN words has all
#: but two of its words in one window.
WINDOW, STEP = 20, 8
#: Words of a passage of an item, and the step.
PASSAGE, PASSAGE_STEP = 80, 40
#: Dimensions of the latent space at most, those the sketch has besides, and terms of a block of its sums.
RANK, OVERSAMPLING, SKETCH_TERMS = 512, 16, 2048
#: Cosine in the latent space from which a window and a passage are candidates, and the centroids whose passages
#: are looked at for a window: so many at least, and this part of them.
MIN_COSINE, PROBES, PROBED_PART = 0.4, 32, 0.375
#: Part of the runs of the items that may weigh less than a window that is looked at.
LIGHT = 0.01
#: Least weight of a term, also of one that stands in every document.
MIN_WEIGHT = 0.1
#: Share of an item's words that a document must have among the item's rarest words before all are counted.
PREFIX_SHARE = 0.2
#: Share of a paraphrased item's words in order, and the part of the items that may have the same answer.
PARAPHRASE_SHARE, SAME_ANSWER = 0.5, 0.01
#: Largest number of held-out items of one call: vocabulary and latent space are of their size.
MAX_ITEMS = 20_000

_SUSPECT = _PY(SUSPECT_RANGES)
_SIGN = re.compile(r"[^\w\s]|_")


def normal_words(text: str | None) -> list[str]:
    """The words between white space, without case, punctuation, look-alike and invisible characters."""
    if not text:
        return []
    if _SUSPECT.search(text):
        text = "".join(map(looks_like, re.split(r"(\s+)", text)))
    return _SIGN.sub("", text.casefold()).split()


def without_instructions(texts: list[str | None]) -> list[str]:
    """Texts without a standing instruction: a start up to a colon that several items share."""
    starts = Counter(m[0] for t in texts if t and (m := re.match(r"[^:\n]{4,120}:\s*", t)))
    enough = max(3, len(texts) // 100)
    return [
        t[len(m[0]) :] if t and (m := re.match(r"[^:\n]{4,120}:\s*", t)) and starts[m[0]] >= enough else t or ""
        for t in texts
    ]


def longest_run(document: list, item: list) -> int:
    """Length of the longest run of consecutive words common to both."""
    places: dict = {}
    for i, word in enumerate(item):
        places.setdefault(word, []).append(i)
    best, before = 0, {}
    for word in document:
        now = {i: before.get(i - 1, 0) + 1 for i in places.get(word, ())}
        best = max(best, *now.values()) if now else best
        before = now
    return best


def common_words_in_order(document: list, item: list) -> int:
    """Length of the longest common subsequence of words, by bit-parallel dynamic programming."""
    places: dict = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in document:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def cut_passages(words: np.ndarray, length: int, step: int) -> list[np.ndarray]:
    """Overlapping passages that together are all of ``words``."""
    if not len(words):
        return []
    last = max(0, len(words) - length)
    return [words[i : i + length] for i in [*range(0, last, step), last]]


class HeldOut:
    """The held-out items on the driver: words as codes of one vocabulary, passages, answers."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows`` are (id, text without instruction, answer)."""
        self.ids = [r[0] for r in rows]
        words, answers = [normal_words(r[1]) for r in rows], [normal_words(r[2]) for r in rows]
        terms = sorted({w for part in (words, answers) for ws in part for w in ws})
        self.codes = {w: i + 1 for i, w in enumerate(terms)}
        self.kind = np.uint16 if len(terms) < 65_535 else np.uint32
        self.words, self.answers = list(map(self.encode, words)), list(map(self.encode, answers))
        same = Counter(map(tuple, answers))
        most = max(2, int(SAME_ANSWER * len(rows)))
        self.telling = [bool(a) and same[tuple(a)] <= most for a in answers]  # answers that few items have
        self.passages = [(i, p) for i, ws in enumerate(self.words) for p in cut_passages(ws, PASSAGE, PASSAGE_STEP)]

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.codes.get(w, 0) for w in words), self.kind, len(words))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, items) of the runs of MIN_RUN words of all items, in the order of the hashes."""
        hashes = [np.unique(run_hashes(words)) for words in self.words]
        owners = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        return flat[order], owners[order]


def held_out(items: DataFrame, key: str, text: str, answer: str | None = None) -> HeldOut:
    """The items in the order of their ids; null ids are left out."""
    columns = [F.col(key).alias("id"), F.col(text).alias("text")]
    columns.append(F.col(answer).alias("answer") if answer else F.lit(None).cast("string").alias("answer"))
    rows = items.select(*columns).where("id IS NOT NULL").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} held-out items; give them in several calls")
    rows.sort(key=lambda r: (r["id"], r["text"] or ""))
    texts = without_instructions([r["text"] for r in rows])
    return HeldOut([(r["id"], t, r["answer"]) for r, t in zip(rows, texts, strict=True)])


@dataclass
class Lists:
    """Numbers in lists one after the other: list n is values[starts[n]:starts[n + 1]], with a count each."""

    starts: np.ndarray
    values: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, lists: int) -> "Lists":
        """Of (list, value, count) as columns of three rows."""
        order = np.argsort(rows[0], kind="stable")
        return cls(np.searchsorted(rows[0][order], np.arange(lists + 1)), rows[1][order], rows[2][order])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ``numbers``, value, count) of all members of these lists."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        place = np.repeat(np.arange(len(numbers)), sizes)
        at = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[numbers], sizes)
        return place, self.values[at], self.counts[at]


class WordIndex:
    """Finds the documents that hold MIN_SHARE of an item's words, whatever the frequency of the words is.

    Of an item of n words a document must have m. Outside the rarest words that make up n - m + k there are
    m - k, so the document must have k of the rarest; only then all are counted.
    """

    def __init__(self, words: list[np.ndarray], weights: np.ndarray) -> None:
        terms, rare = [np.empty((3, 0), np.int64)], [np.empty((3, 0), np.int64)]
        sizes = np.array([len(w) for w in words], np.int64)
        self.terms, self.sizes = len(weights), sizes
        self.least = np.maximum(1, np.ceil(MIN_SHARE * sizes - 1e-6)).astype(np.int64)
        self.first = np.maximum(1, np.ceil(PREFIX_SHARE * sizes)).astype(np.int64)
        for i, ws in enumerate(words):
            here, times = np.unique(ws, return_counts=True)
            order = np.argsort(-weights[here], kind="stable")
            here, times = here[order].astype(np.int64), times[order]
            before = np.cumsum(times) - times
            prefix = before < sizes[i] - self.least[i] + self.first[i]
            number = np.full(len(here), i)
            terms.append(np.stack([number, here, times]))
            rare.append(np.stack([here, number, times])[:, prefix])
        self.of_item = Lists.of(np.concatenate(terms, axis=1), len(words))
        self.of_term = Lists.of(np.concatenate(rare, axis=1), len(weights))

    def present(self, codes: list[np.ndarray]) -> np.ndarray:
        """The terms of each document, as document * terms + term in order."""
        document = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        return np.unique(document * self.terms + np.concatenate(codes).astype(np.int64))

    def shared(self, present: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """How many of the item's words the document of each pair has."""
        place, term, times = self.of_item.take(pairs[1])
        keys = pairs[0][place] * self.terms + term
        at = np.minimum(np.searchsorted(present, keys), len(present) - 1)
        return np.bincount(place, times * (present[at] == keys), pairs.shape[1]).astype(np.int64)

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """(documents, items) as two rows: the pairs with enough of the item's rarest words."""
        place, item, times = self.of_term.take(present % self.terms)
        items = len(self.sizes)
        keys, inverse = np.unique(present[place] // self.terms * items + item, return_inverse=True)
        enough = np.bincount(inverse, times, len(keys)) >= self.first[keys % items]
        return np.stack([keys[enough] // items, keys[enough] % items])


def encoded(documents: DataFrame, key: str, text: str, held: HeldOut) -> DataFrame:
    """(id, codes) of each document: its words as numbers of the items' vocabulary, 0 for others."""
    codes, kind = held.codes, held.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (normal_words(t) for t in batch.column(1).to_pylist())
            packed = [np.fromiter((codes.get(w, 0) for w in words), kind, len(words)).tobytes() for words in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "codes"])

    given = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"id {dict(given.dtypes)['id']}, codes binary")


def document_frequencies(coded: DataFrame, held: HeldOut) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents; sums over partitions."""
    size, kind = len(held.codes) + 1, held.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros(size, np.int64), 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts[np.unique(np.frombuffer(packed, kind))] += 1
                documents += 1
        counts[0] = documents
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["term", "documents"])

    parts = coded.select("codes").mapInArrow(run, "term bigint, documents bigint")
    rows = parts.groupBy("term").agg(F.sum("documents").alias("documents")).collect()  # one row for each term of the items
    counts = np.zeros(size)
    for r in rows:
        counts[r["term"]] = r["documents"]
    return counts, int(counts[0])


def term_weights(counts: np.ndarray, documents: int) -> np.ndarray:
    """Smoothed inverse document frequencies, at least MIN_WEIGHT, so that no leak, however often it
    stands in the corpus, takes the weight from its own words; 0 for no term."""
    weights = np.maximum(np.log((documents + 1) / (counts + 1)), MIN_WEIGHT)
    weights[0] = 0
    return weights.astype(np.float32)


def _passage_rows(held: HeldOut, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, values) of the TF-IDF row of each passage, divided by its length."""
    for _, passage in held.passages:
        terms, times = np.unique(passage, return_counts=True)
        row = times * weights[terms]
        yield terms, (row / max(np.linalg.norm(row), 1e-9)).astype(np.float32)


def _sketch(passages: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the TF-IDF matrix A of the passages (codes): each task adds up its own, and the sums are
    added by blocks of SKETCH_TERMS terms."""
    shared = passages.sparkSession.sparkContext.broadcast((weights, basis))
    size, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        total = np.zeros((size, width), np.float32)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                terms, times = np.unique(np.frombuffer(packed, np.int64), return_counts=True)
                row = times * weights[terms]
                row = (row / max(np.linalg.norm(row), 1e-9)).astype(np.float32)
                total[terms] += np.outer(row, row @ basis[terms])
        for at in range(0, size, SKETCH_TERMS):
            block = total[at : at + SKETCH_TERMS]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = passages.mapInArrow(run, "block bigint, sums binary").groupBy("block").applyInArrow(add, "block bigint, sums binary")
    sums = np.zeros((size, width), np.float32)
    for r in parts.collect():  # together one matrix of terms and dimensions
        block = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
        sums[r["block"] : r["block"] + len(block)] = block
    shared.destroy()
    return sums


def _orthonormal(matrix: np.ndarray) -> np.ndarray:
    """A basis of the space of the columns, without directions that are next to nothing."""
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    kept = values > 1e-10 * max(values.max(initial=0.0), 1e-30)
    return (matrix @ (vectors[:, kept] / np.sqrt(values[kept]))).astype(np.float32)


def latent_space(spark, held: HeldOut, weights: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(basis, points): right singular vectors of the passages' TF-IDF matrix, and the passages' directions in
    their space.

    A random sketch is multiplied by A'A over all partitions of the passages, made orthonormal, multiplied
    once more, and turned to the singular vectors by the eigenvectors of the small matrix (Rayleigh-Ritz).
    """
    size = len(weights)
    rank = min(RANK, len(held.passages), size)
    width = min(rank + OVERSAMPLING, size)
    omega = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    rows = [(i, p.astype(np.int64).tobytes()) for i, (_, p) in enumerate(held.passages)]
    slices = -(-len(rows) // 1024)
    passages = spark.createDataFrame(rows, "passage bigint, codes binary").repartition(slices, "passage").select("codes")
    basis = _orthonormal(_sketch(passages, weights, omega))
    image = _sketch(passages, weights, basis)
    core = basis.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    best = np.argsort(-values)[:rank]
    basis = (basis @ vectors[:, best[values[best] > 1e-9]]).astype(np.float32)
    points = np.zeros((len(held.passages), basis.shape[1]), np.float32)
    for i, (terms, row) in enumerate(_passage_rows(held, weights)):
        points[i] = row @ basis[terms]
    return basis, _directions(points)


def _directions(points: np.ndarray) -> np.ndarray:
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


class LatentIndex:
    """Finds the passages near a window of a document by their cosine in the latent space."""

    def __init__(self, held: HeldOut, weights: np.ndarray, basis: np.ndarray, points: np.ndarray, seed: int = 7) -> None:
        self.weights, self.projection = weights, weights[:, None] * basis
        # windows that weigh less than nearly all runs of the items are not looked at
        runs = [np.sort(weights[ws][r : r + MIN_RUN])[:-2].sum() for ws in held.words for r in range(0, max(1, len(ws) - MIN_RUN + 1), 4) if len(ws)]
        self.least = float(np.quantile(runs, LIGHT)) if runs else 0.0
        centroids = points[np.random.default_rng(seed).choice(len(points), max(1, int(len(points) ** 0.5)), replace=False)]
        for _ in range(6):
            nearest = np.argmax(points @ centroids.T, axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, points)
            centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _directions(sums), centroids)
        nearest = np.argmax(points @ centroids.T, axis=1)
        owner = np.array([i for i, _ in held.passages])
        self.centroids = centroids
        self.lists = [(points[nearest == c], owner[nearest == c]) for c in range(len(centroids))]

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the pairs with a cosine of MIN_COSINE, in blocks of windows."""
        found = [np.empty((2, 0), np.int64)]
        heavy = np.flatnonzero(self.weights[rows].sum(axis=1) >= self.least)
        for at in range(0, len(heavy), 1024):
            numbers = heavy[at : at + 1024]
            places = _directions(self.projection[rows[numbers]].sum(axis=1))
            cosines = places @ self.centroids.T
            probes = min(max(PROBES, int(PROBED_PART * len(self.centroids))), len(self.centroids))
            bound = -np.partition(-cosines, probes - 1, axis=1)[:, probes - 1 : probes]
            probed = cosines >= bound
            for c, (points, owner) in enumerate(self.lists):
                here = np.flatnonzero(probed[:, c])
                if len(here) and len(points):
                    window, passage = np.nonzero(places[here] @ points.T >= MIN_COSINE)
                    found.append(np.stack([numbers[here[window]], owner[passage]]))
        return tuple(np.concatenate(found, axis=1))

    def candidates(self, codes: list[np.ndarray]) -> np.ndarray:
        """(documents, items) as two rows: all pairs with a window near a passage."""
        rows, documents = windows(codes)
        window, item = self.near(rows)
        return np.unique(np.stack([documents[window], item]), axis=1)


def windows(codes: list[np.ndarray], width: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(windows, documents): the windows of a batch's documents as rows of ``width`` codes, padded with
    0, and the number of the document each is of."""
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    counts = np.where(lengths > width, -(-(lengths - width) // step) + 1, 1)
    documents = np.repeat(np.arange(len(codes)), counts)
    nth = np.arange(len(documents)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.minimum(nth * step, np.maximum(lengths - width, 0)[documents])
    flat = np.concatenate([*codes, np.zeros(width, codes[0].dtype)])
    places = starts[:, None] + np.arange(width)
    inside = places < lengths[documents][:, None]
    offsets = (np.cumsum(lengths) - lengths)[documents][:, None]
    return np.where(inside, flat[np.where(inside, places + offsets, 0)], 0), documents


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of MIN_RUN consecutive codes, equal for equal runs."""
    hashes = np.zeros(max(0, len(codes) - MIN_RUN + 1), np.uint64)
    for i in range(MIN_RUN):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(hashes)].astype(np.uint64)
    return hashes


def sharing_runs(codes: list[np.ndarray], hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """(documents, items) as two rows: all pairs that share a run of MIN_RUN words. ``hashes`` are those of
    the items' runs in their order, ``owners`` the items; no run of an item has a 0, so none of two documents'
    words is one."""
    gap = np.zeros(1, codes[0].dtype)
    flat = np.concatenate([x for c in codes for x in (c, gap)])
    document = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
    here = run_hashes(flat)
    first = np.searchsorted(hashes, here)
    hits = np.flatnonzero(first < len(hashes))
    hits = hits[hashes[first[hits]] == here[hits]]
    found = np.unique(np.stack([document[hits], first[hits]]), axis=1)
    counts = np.searchsorted(hashes, hashes[found[1]], "right") - found[1]
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.stack([np.repeat(found[0], counts), owners[np.repeat(found[1], counts) + nth]])


@dataclass
class Index:
    """All that a task needs to find and check the leaks of its documents."""

    held: HeldOut
    latent: LatentIndex
    words: WordIndex
    runs: tuple[np.ndarray, np.ndarray]

    def leaks(self, codes: list[np.ndarray]) -> Iterator[tuple]:
        """(document, item, kind, way, run, share, answer found) of a batch of documents, both by number."""
        items, present = len(self.held.words), self.words.present(codes)
        latent = self.latent.candidates(codes)
        numbers = lambda pairs: pairs[0] * items + pairs[1]
        by_latent, by_run = numbers(latent), numbers(sharing_runs(codes, *self.runs))
        every = np.unique(np.concatenate([by_latent, by_run, numbers(self.words.candidates(present))]))
        pairs = np.stack([every // items, every % items])
        shared, size = self.words.shared(present, pairs), self.words.sizes[pairs[1]]
        proposed, same_run = np.isin(every, by_latent), np.isin(every, by_run)
        enough = (shared >= self.words.least[pairs[1]]) | same_run
        telling = np.array(self.held.telling, bool)[pairs[1]] & proposed & (shared >= PARAPHRASE_SHARE * size)
        for at in np.flatnonzero(enough | telling):
            document, item = codes[pairs[0][at]], self.held.words[pairs[1][at]]
            known = np.isin(document, item)
            run = longest_run(np.where(known, document, 0).tolist(), item.tolist())
            share = common_words_in_order(document[known].tolist(), item.tolist()) / len(item)
            answered = contains(document, self.held.answers[pairs[1][at]])
            if run >= MIN_RUN:
                kind = "run"
            elif share >= MIN_SHARE:
                kind = "reworked"
            elif telling[at] and answered and share >= PARAPHRASE_SHARE:
                kind = "paraphrase"
            else:
                continue
            yield int(pairs[0][at]), int(pairs[1][at]), kind, "latent" if proposed[at] else "exact", run, share, answered


def contains(document: np.ndarray, words: np.ndarray) -> bool:
    """Whether the words stand in the document one after the other; false for no words."""
    if not len(words) or len(words) > len(document):
        return False
    starts = np.flatnonzero(document[: len(document) - len(words) + 1] == words[0])
    return any(np.array_equal(document[s : s + len(words)], words) for s in starts)


def find(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, answer: str | None = None
) -> DataFrame:
    """(key, item_key, kind, way, run, share, answer_found): each document that carries at least MIN_RUN
    consecutive words of an item (kind run), MIN_SHARE of its words in order (reworked), or PARAPHRASE_SHARE of
    them and its answer (paraphrase); way tells whether the latent search proposed it or only an exact one."""
    spark = documents.sparkSession
    id_type, item_type = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {id_type}, `{item_key}` {item_type}, kind string, way string, run int, share double, answer_found boolean"
    held = held_out(items, item_key, item_text, answer)
    if not held.passages:
        return spark.createDataFrame([], schema)
    coded = cut_lineage(encoded(documents, key, text, held))
    index = spark.sparkContext.broadcast(_index(spark, coded, held))
    found = coded.mapInArrow(_finder(index, schema, to_arrow_type(items.schema[item_key].dataType)), schema)
    return found.dropDuplicates([key, item_key])


def _index(spark, coded: DataFrame, held: HeldOut) -> Index:
    weights = term_weights(*document_frequencies(coded, held))
    return Index(held, LatentIndex(held, weights, *latent_space(spark, held, weights)), WordIndex(held.words, weights), held.runs())


#: Documents that a task looks at together.
BATCH = 512


def _finder(index: Broadcast, schema: str, item_kind: pa.DataType):
    names = T._parse_datatype_string(schema).names
    kinds = [item_kind, pa.string(), pa.string(), pa.int32(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value.held
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                codes = [np.frombuffer(packed, held.kind) for packed in batch.column(1).to_pylist()]
                out = [(at, held.ids[item], *rest) for at, item, *rest in index.value.leaks(codes)]
                at, *columns = map(list, zip(*out, strict=True)) if out else [[]] * 7
                rest = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *rest], names)

    return run
