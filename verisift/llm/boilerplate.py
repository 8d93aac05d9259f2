"""Problem 5: lines repeated across one site's documents.

Method: lines that stand in enough records of their source are the nodes of a graph weighted by the
number of records; pairs of them on consecutive lines, of the same support, are its edges; connected
components are the blocks of boilerplate; and their occurrences are deleted from each text.

Texts are read and hashed once, into a table of records with the hashes of their lines in the checkpoint
folder, from which nodes, edges and occurrences come; only :func:`clean` and :func:`lines_of_sources`, which
give texts, read them again. Lines travel as 64-bit hashes with their source; counts are combined on the map
side, so a source with a third of all rows is many partial sums. What is gathered for one source is its nodes
and edges only: each node takes at least the share ``min_share`` of the source's records, so a source has at
most lines-per-record / min_share of them, whatever its size.

Defined results for odd input: null texts and records without a source have no cases and keep their
text; blank lines are never cases; a line twice in one record counts once; equal rows count as several
records; other columns pass through :func:`clean` under whatever name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import source_host
from verisift.operators.joins import sized_join
from verisift.session import cut_lineage

MIN_RECORDS = 10
MIN_SHARE = 0.04


def line_hashes(text: Column) -> Column:
    """Hash of each line by its letters' lower case and single spaces; 0 for a blank line."""
    spaced = F.regexp_replace(F.lower(text), r"[\s\p{Z}\x{0085}&&[^\n]]+", " ")
    return F.transform(
        F.split(spaced, "\n"), lambda line: F.when(F.btrim(line) == "", F.lit(0)).otherwise(F.xxhash64(F.btrim(line)))
    )


def hashed_lines(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(id, source, lines) of the records with a source and a text."""
    return df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), source_host(F.col(url)).alias("source"), line_hashes(F.col(text)).alias("lines")
    ).where("source <> ''")


def supported(items: DataFrame, totals: DataFrame, names: list[str], min_records: int, min_share: float) -> DataFrame:
    """Rows of ``items`` (source, names) in enough records of their source (``totals``, cut), with that number."""
    counted = items.groupBy("source", *names).agg(F.count("*").alias("records")).where(F.col("records") >= min_records)
    enough = F.col("records") >= F.col("total") * F.lit(min_share)
    return sized_join(counted, totals, ["source"]).where(enough).drop("total")


def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one source's edges (a node alone is an edge to itself), named by their
    smallest node. A source's nodes are bounded by its lines per record, not by its records."""
    parent = {n: n for n in pd.unique(rows[["line", "after"]].to_numpy().ravel()).tolist()}

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in zip(rows.line.tolist(), rows.after.tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame(
        {"source": rows.source.iloc[0], "line": list(parent), "block": [root(n) for n in parent]},
    )


def blocks(
    records: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE
) -> DataFrame:
    """(source, line, records, block) of the excessive lines of ``records`` (as of hashed_lines, cut), cut."""
    totals = cut_lineage(records.groupBy("source").agg(F.count("*").alias("total")))
    distinct = F.filter(F.array_distinct("lines"), lambda h: h != 0)
    nodes = cut_lineage(
        supported(records.select("source", F.explode(distinct).alias("line")), totals, ["line"], min_records, min_share)
    )
    filled = records.select("source", F.filter("lines", lambda h: h != 0).alias("filled")).where(F.size("filled") > 1)
    steps = F.transform(
        F.slice("filled", F.lit(2), F.size("filled") - 1), lambda h, i: F.struct(F.get("filled", i).alias("line"), h.alias("after"))
    )
    pairs = filled.select("source", F.explode(F.array_distinct(steps)).alias("s")).select("source", "s.*").where("line <> after")
    keys = nodes.select("source", "line")
    pairs = sized_join(pairs, keys, ["source", "line"], "left_semi")
    pairs = sized_join(pairs, keys.withColumnRenamed("line", "after"), ["source", "after"], "left_semi")
    edges = supported(pairs, totals, ["line", "after"], min_records, min_share)
    graph = nodes.select("source", "line", F.col("line").alias("after")).unionByName(
        edges.select("source", "line", "after")
    )
    named = graph.groupBy("source").applyInPandas(_blocks, "source string, line long, block long")
    return cut_lineage(nodes.join(named, ["source", "line"]))


def find(df: DataFrame, key: str, url: str, text: str, **limits: float) -> DataFrame:
    """(key, line_no, block) of every occurrence of an excessive line, lines numbered from 1."""
    records = cut_lineage(hashed_lines(df, key, url, text))
    excessive = blocks(records, **limits)
    lines = records.select("id", "source", F.posexplode("lines").alias("at", "line")).where("line <> 0")
    return sized_join(lines, excessive.select("source", "line", "block"), ["source", "line"]).select(
        F.col("id").alias(key), (F.col("at") + 1).cast("int").alias("line_no"), "block"
    )


def lines_of_sources(df: DataFrame, key: str, url: str, text: str, **limits: float) -> DataFrame:
    """(source, line_text, records, block): the excessive lines of each source, with an example."""
    lower = df.where(F.col(text).isNotNull()).select(
        source_host(F.col(url)).alias("source"), F.explode(F.arrays_zip(
            F.split(text, "\n").alias("t"), line_hashes(F.col(text)).alias("h"))).alias("x"))
    excessive = blocks(cut_lineage(hashed_lines(df, key, url, text).drop("id")), **limits)
    shown = sized_join(
        lower.select("source", F.col("x.h").alias("line"), F.col("x.t").alias("text")), excessive, ["source", "line"]
    )
    return shown.groupBy("source", "line").agg(
        F.min(F.btrim(F.regexp_replace("text", r"\s+", " "))).alias("line_text"),
        F.min("records").alias("records"),
        F.min("block").alias("block"),
    ).drop("line")


def blocks_of_sources(df: DataFrame, key: str, url: str, text: str, **limits: float) -> DataFrame:
    """(source, block_text, lines, records): the blocks of each source: their lines in the order of the alphabet, and the
    records of the most frequent one. A block has no more lines than its source has excessive ones."""
    lines = lines_of_sources(df, key, url, text, **limits)
    return lines.groupBy("source", "block").agg(
        F.array_join(F.array_sort(F.collect_list("line_text")), "\n").alias("block_text"),
        F.count("*").alias("lines"),
        F.max("records").alias("records"),
    ).drop("block")


def clean(df: DataFrame, url: str, text: str, **limits: float) -> DataFrame:
    """``df`` with the excessive lines of each record's source deleted from ``text``."""
    rows = df.select(
        source_host(F.col(url)).alias("source"),
        line_hashes(F.col(text)).alias("lines"),
        F.struct(*[df[c] for c in df.columns]).alias("row"),
    )
    records = rows.where("source <> '' AND lines IS NOT NULL").select("source", "lines")
    excessive = blocks(cut_lineage(records), **limits)
    by_source = excessive.groupBy("source").agg(F.sort_array(F.collect_set("line")).alias("nodes"))
    split = F.split(F.col("row").getField(text), "\n")
    left = F.filter(split, lambda line, i: ~F.array_contains("nodes", F.get("lines", i)))
    cut = F.when(F.col("nodes").isNull() | F.col("lines").isNull(), F.col("row").getField(text)).otherwise(
        F.array_join(left, "\n")
    )
    return sized_join(rows, cut_lineage(by_source), ["source"], "left").select(F.col("row").withField(text, cut).alias("row")).select("row.*")
