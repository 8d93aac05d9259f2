"""Problem 7: mixing sources to target weights.

Method: capped water-filling. The wanted total is shared by the target weights; a source whose share
is more than its largest number of repetitions gives is clamped there, and the excess is spread over the
others in proportion, until nothing changes. Every document is then used the whole number of times, and
a seeded sample of each source, of as many tokens as its fraction asks for, once more.

Only sizes are shuffled, as sums. The fractional sample is exact to half a document: a histogram of
the seeded hashes, with bins of some thousand documents whatever the size of a source, gives the bin in
which the wanted number of tokens is reached, and only the documents of that bin are ordered.

Defined results for odd input: null and blank sources take no part, as sources without a target; null
and empty texts have no tokens and are used 0 times, as all documents of sources that take no part;
rows with the same id and text have the same hash and follow each other; sources compare without case
and padding; a target without documents, or clamped, is reported with its shortfall; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.text import strip
from verisift.session import cut_lineage

#: Vocabulary of the public tokenizer whose tokens are counted: byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest number of targets; they are handled on the driver.
MAX_TARGETS = 100_000
#: Documents of a bin of the fractional sample, about.
BIN_DOCUMENTS = 20_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null. The vocabulary, a file of the driver, is sent to the executors."""
    context = SparkSession.active().sparkContext
    context.addFile(vocabulary)
    name = Path(vocabulary).name

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(SparkFiles.get(name))
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return run(text)


@dataclass(frozen=True)
class Share:
    """What one source gives: the tokens it has and gives, whole repetitions and the rest in tokens."""

    source: str
    target: float
    max_repeats: int
    available: int
    allotted: float
    whole: int
    rest: float
    clamped: bool


def water_fill(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Allot ``total`` tokens (default: all tokens of the sources with a target, once) to the sources.

    ``targets`` has weight and largest number of repetitions of each source. Sources at their cap are
    clamped and the excess goes to the others in proportion to their weights, until it fits or all are
    clamped.
    """
    weights = {s: max(0.0, w) for s, (w, _) in targets.items()}
    caps = {s: float(available.get(s, 0) * max(0, targets[s][1])) for s in targets}
    if total is None:
        total = float(sum(available.get(s, 0) for s in targets if weights[s] > 0))
    allotted, clamped, left = dict.fromkeys(targets, 0.0), set(), total
    free = {s for s in targets if weights[s] > 0}
    while free:
        weight = sum(weights[s] for s in sorted(free))
        full = {s for s in free if left * weights[s] / weight >= caps[s]}
        if not full:
            for s in free:
                allotted[s] = left * weights[s] / weight
            break
        for s in sorted(full):
            allotted[s] = caps[s]
            left -= caps[s]
        clamped |= full
        free -= full
    shares = []
    for s in sorted(targets):
        have, most = available.get(s, 0), max(0, targets[s][1])
        whole = min(int(allotted[s] / have + 1e-9), most) if have else 0
        rest = max(0.0, allotted[s] - whole * have) if whole < most else 0.0
        shares.append(Share(s, targets[s][0], targets[s][1], have, allotted[s], whole, rest, s in clamped))
    return shares


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weights and caps by source in lower case; weights add up where a source is named twice, and the
    smallest cap holds. Null sources, weights and caps count as no target, 0 and 1."""
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    found: dict[str, tuple[float, int]] = {}
    for r in rows:
        source = (r["source"] or "").strip().lower()
        if source:
            weight, cap = found.get(source, (0.0, 2**31 - 1))
            repeats = 1 if r["max_repeats"] is None else int(r["max_repeats"])
            found[source] = (weight + float(r["target_share"] or 0), min(cap, repeats))
    return found


def sizes(df: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY, seed: int = 1) -> DataFrame:
    """(id, source, tokens, draw) of every document: its source in lower case (null: takes no part) and a
    seeded draw."""
    name = F.nullif(F.lower(strip(F.col(source))), F.lit(""))
    return df.select(
        F.col(key).alias("id"), name.alias("source"), token_count(F.col(text), vocabulary).alias("tokens")
    ).withColumn("draw", F.xxhash64(F.lit(seed), "id", "tokens"))


def plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> list[Share]:
    """The share of each target."""
    wanted = read_targets(targets)
    named = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in wanted], "source string"))  # at most MAX_TARGETS
    sums = sized.join(named, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return water_fill(wanted, {r["source"]: int(r["tokens"]) for r in sums.collect()}, total)  # one row a target


def uses(sized: DataFrame, shares: list[Share]) -> DataFrame:
    """(id, source, tokens, times) of every document of ``sized`` (cut)."""
    spark = sized.sparkSession
    rows = [(s.source, s.whole, s.rest) for s in shares]
    plans = F.broadcast(spark.createDataFrame(rows, "source string, whole int, rest double"))  # at most MAX_TARGETS
    bins = max(1024, sized.count() // BIN_DOCUMENTS)
    known = sized.join(plans, "source", "left").withColumn("bin", F.pmod("draw", F.lit(bins)))
    drawn = known.where("rest > 0 AND tokens > 0")
    up_to = Window.partitionBy("source").orderBy("bin")
    sums = drawn.groupBy("source", "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    last = cut_lineage(
        sums.withColumn("before", F.sum("tokens").over(up_to) - F.col("tokens"))
        .where("before < rest AND before + tokens >= rest")
        .select("source", F.col("bin").alias("last"), "before")
    )  # at most one row a source
    marked = known.join(F.broadcast(last), "source", "left")
    inside = F.coalesce((F.col("bin") == F.col("last")) & (F.col("rest") > 0) & (F.col("tokens") > 0), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.where(inside).withColumn("middle", F.col("before") + F.sum("tokens").over(in_order) - F.col("tokens") / 2)
    once = F.when(F.col("middle") <= F.col("rest"), 1).otherwise(0)
    clear = marked.where(~inside).withColumn("middle", F.lit(None).cast("double"))
    sampled = F.when((F.col("rest") > 0) & (F.col("last").isNull() | (F.col("bin") < F.col("last"))), 1).otherwise(0)
    columns = ["id", "source", "tokens"]

    def times(extra: Column) -> Column:
        used = F.coalesce("whole", F.lit(0)) + extra
        return F.when(F.col("tokens") > 0, used).otherwise(0).cast("int").alias("times")

    return edge.select(*columns, times(once)).unionAll(clear.select(*columns, times(sampled)))


def report(used: DataFrame, shares: list[Share]) -> DataFrame:
    """(source, target_share, max_repeats, documents, available_tokens, used_tokens, actual_share,
    missing_share, state) of each target and each source without one."""
    spark = used.sparkSession
    rows = [(s.source, s.target, s.max_repeats, s.clamped) for s in shares]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, clamped boolean")
    sums = used.where("source IS NOT NULL").groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("tokens").alias("available_tokens"),
        F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"),
    )
    joined = sums.join(F.broadcast(targets), "source", "full").na.fill(0, ["documents", "available_tokens", "used_tokens"])
    total = used.where("times > 0").agg(F.sum(F.col("tokens") * F.col("times")).alias("total")).collect()[0]["total"] or 0
    share = (F.col("used_tokens") / F.lit(total)) if total else F.lit(0.0)
    state = (
        F.when(F.col("target_share").isNull(), "no target")
        .when(F.col("target_share") <= 0, "target zero")
        .when(F.col("available_tokens") == 0, "no documents")
        .when(F.col("clamped"), "all repetitions used")
        .otherwise("free")
    )
    missing = F.greatest(F.coalesce("target_share", F.lit(0.0)) - F.col("actual_share"), F.lit(0.0))
    return (
        joined.withColumn("actual_share", share)
        .select(
            "source", "target_share", "max_repeats", "documents", "available_tokens", "used_tokens", "actual_share",
            missing.alias("missing_share"), state.alias("state"),
        )
    )


def mix(
    df: DataFrame, key: str, text: str, source: str, targets: DataFrame,
    total: float | None = None, vocabulary: str = VOCABULARY, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(uses, report): the times each document is used, and the shares reached by source."""
    sized = cut_lineage(sizes(df, key, text, source, vocabulary, seed))
    shares = plan(sized, targets, total)
    used = uses(sized, shares)
    return used.withColumnRenamed("id", key), report(used, shares)
