"""The pN_ queries: each problem's operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import boilerplate, duplicates, leakage, lookalikes, mixing, quality, residue, truncation
from verisift.functions.text import WHITESPACE, provider_key, source_host
from verisift.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.find(table(spark, sf, "evidence"), "evidence_id", ["text", "title"])


def p1_normalized(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "evidence").select("evidence_id", "title", "text")
    return lookalikes.normalize(columns, ["text", "title"])


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence and searches as records (record_type, record_id, source, url, title, text); the source of
    evidence is its host, that of searches the provider, and a search's query stands for the title."""
    evidence, searches = table(spark, sf, "evidence"), table(spark, sf, "searches")
    url, none = F.col("url"), F.lit(None).cast("string")
    provider = provider_key(F.col("provider"))
    return residue.as_records("evidence", evidence, "evidence_id", source_host(url), url, F.col("title"), "text").unionAll(
        residue.as_records("search", searches, "search_id", provider, none, F.col("query"), "result")
    )


def function_words(spark: SparkSession, sf: str) -> frozenset[str]:
    bits, _ = quality.common_bits(table(spark, sf, "common_words"))
    return frozenset(bits)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.find(records(spark, sf), function_words(spark, sf))


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(records(spark, sf), function_words(spark, sf))


def p2_limits(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.limits_of_sources(records(spark, sf), function_words(spark, sf))


def p3_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find(records(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_residue(spark, sf).select("record_type", "record_id")


def p3_evidence_kept(spark: SparkSession, sf: str) -> DataFrame:
    return residue.keep_content(table(spark, sf, "evidence"), "evidence_id", p3_residue(spark, sf), "evidence")


def p3_searches_kept(spark: SparkSession, sf: str) -> DataFrame:
    return residue.keep_content(table(spark, sf, "searches"), "search_id", p3_residue(spark, sf), "search")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.find(table(spark, sf, "evidence"), "evidence_id", "text")


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "evidence").select("evidence_id", "text", "fingerprint")
    return duplicates.collapse(columns, "evidence_id", "text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = boilerplate.find(table(spark, sf, "evidence"), "evidence_id", "url", "text")
    return found.select("evidence_id", "line_no").distinct()


def p5_lines(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.lines_of_sources(table(spark, sf, "evidence"), "evidence_id", "url", "text").drop("block")


def p5_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.blocks_of_sources(table(spark, sf, "evidence"), "evidence_id", "url", "text")


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "evidence").select("evidence_id", "url", "text")
    return boilerplate.clean(columns, "url", "text")


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    documents, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    return leakage.find(documents, "doc_id", "text", items, "item_id", "text", "answer")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).where("kind <> 'paraphrase'").select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    leaks = p6_leaks(spark, sf).where("kind <> 'paraphrase'").groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("run").alias("longest_run"), F.max("share").alias("largest_share")
    )
    split = table(spark, sf, "eval_items").select("item_id", "split_name")
    return leaks.join(F.broadcast(split), "item_id")


def p7_uses(spark: SparkSession, sf: str) -> DataFrame:
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return mixing.mix(documents, "doc_id", "text", "source", targets)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return mixing.mix(documents, "doc_id", "text", "source", targets)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.find(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "common_words"))


def p8_quality(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "documents").select("doc_id", "text")
    return quality.measure(columns, "text", table(spark, sf, "common_words")).drop("text")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "documents").select("doc_id", "text")
    return quality.statistics(columns, "text", table(spark, sf, "common_words")).drop("text")


def p8_repetition(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "documents").select("doc_id", "text")
    judged = quality.judged(columns, "text", table(spark, sf, "common_words"))
    return judged.select("doc_id", "duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_normalized, p2_found, p2_rates, p2_limits, p3_found, p3_residue, p3_evidence_kept, p3_searches_kept, p4_found, p4_collapsed, p5_found, p5_lines, p5_blocks, p5_cleaned,
        p6_found, p6_leaks, p6_leaked_items, p7_uses, p7_shares, p8_found, p8_quality, p8_statistics, p8_repetition,
    )}


#: Lines of the texts with their source, as problem 5 compares them.
LINES = r"""
    WITH hosts AS (
        SELECT evidence_id, text, coalesce(substr(lower(regexp_extract(
                   regexp_replace(regexp_replace(url, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g'),
                   '^(?i:https?)://(?:[^/?#\[\]]*@)?([A-Za-z0-9.\-]+)(?::[^/?#\[\]@]*)?(?:[/?#]|$)', 1)), 1, 253), '') AS source
        FROM evidence WHERE text IS NOT NULL),
    records AS (SELECT * FROM hosts WHERE source <> ''),
    parts AS (
        SELECT evidence_id, source, unnest(string_split(text, chr(10))) AS part,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
        FROM records),
    lines AS (
        SELECT evidence_id, source, CAST(line_no AS INTEGER) AS line_no,
               trim(regexp_replace(lower(part), '[\s\pZ]+', ' ', 'g')) AS line
        FROM parts),
    counted AS (
        SELECT source, line, count(DISTINCT evidence_id) AS records FROM lines WHERE line <> '' GROUP BY ALL),
    excessive AS (
        SELECT c.* FROM counted c JOIN (SELECT source, count(*) AS total FROM records GROUP BY 1) t USING (source)
        WHERE records >= 10 AND records >= 0.04 * total)
"""


#: An example of each excessive line, and the blocks: what consecutive lines of enough support connect.
SHOWN = LINES + r""",
    shown AS (
        SELECT source, line, min(trim(regexp_replace(part, '\s+', ' ', 'g'))) AS line_text, min(e.records) AS records
        FROM parts JOIN lines USING (evidence_id, source, line_no) JOIN excessive e USING (source, line) GROUP BY ALL)
"""
BLOCKS = SHOWN.replace("WITH", "WITH RECURSIVE", 1) + r""",
    steps AS (
        SELECT evidence_id, source, line, lead(line) OVER (PARTITION BY evidence_id ORDER BY line_no) AS after FROM lines WHERE line <> ''),
    edges AS (
        SELECT source, line, after FROM (
            SELECT source, line, after, count(DISTINCT evidence_id) AS records
            FROM steps SEMI JOIN excessive USING (source, line) WHERE line <> after GROUP BY ALL)
        JOIN (SELECT source, count(*) AS total FROM records GROUP BY 1) USING (source)
        WHERE records >= 10 AND records >= 0.04 * total AND (source, after) IN (SELECT (source, line) FROM excessive)),
    joined AS (SELECT source, line, after FROM edges UNION SELECT source, after, line FROM edges),
    reached AS (
        SELECT source, line, line AS other FROM excessive
        UNION SELECT r.source, r.line, b.after FROM reached r JOIN joined b ON r.source = b.source AND r.other = b.line),
    named AS (SELECT source, line, min(other) AS block FROM reached GROUP BY ALL)
    SELECT source, string_agg(line_text, chr(10) ORDER BY line_text) AS block_text, count(*) AS lines, max(records) AS records
    FROM shown JOIN named USING (source, line) GROUP BY source, block
"""


#: The word, symbol, line-end and common-word statistics of problem 8.
STATISTICS = r"""
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS raw
        FROM documents WHERE text IS NOT NULL),
    parts AS (
        SELECT doc_id, unnest(raw) AS word FROM words),
    hits AS (
        SELECT doc_id, lang, count(*) AS hits
        FROM parts JOIN (SELECT DISTINCT lang, lower(word) AS known FROM common_words) c
          ON trim(lower(trim(word, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~“”‘’«»…–—¿¡·•'))) = known
        GROUP BY ALL),
    best AS (SELECT doc_id, max(hits) AS hits FROM hits GROUP BY 1),
    ends AS (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s', '', 'g')) <> '') AS lines
        FROM documents)
    SELECT d.doc_id,
           CASE WHEN d.text IS NULL THEN NULL ELSE CAST(len(raw) AS BIGINT) END AS word_count,
           CASE WHEN d.text IS NULL THEN NULL WHEN len(raw) = 0 THEN 0.0
                ELSE length(array_to_string(raw, '')) / len(raw) END AS mean_word_length,
           CASE WHEN d.text IS NULL THEN NULL WHEN len(raw) = 0 THEN 0.0
                ELSE length(regexp_replace(d.text, '[\pL\pN\pZ\s]', '', 'g')) / length(d.text) END AS symbol_ratio,
           CASE WHEN d.text IS NULL THEN NULL WHEN len(raw) = 0 THEN 0.0
                ELSE len(list_filter(lines, lambda x: regexp_matches(rtrim(x, chr(32) || chr(9) || chr(13)),
                     '[.!?…]["''“”‘’»)\]]*$'))) / len(lines) END AS punctuated_line_share,
           CASE WHEN d.text IS NULL THEN NULL WHEN len(raw) = 0 THEN 0.0
                ELSE coalesce(hits, 0) / len(raw) END AS common_word_share
    FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN ends USING (doc_id)
"""


_WHITE = "'" + WHITESPACE + "'"
#: The shares of repeated lines and paragraphs, and of the most frequent pair of words, of problem 8.
REPETITION = rf"""
    WITH texts AS (
        SELECT doc_id, text, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS solid FROM documents
        WHERE trim(coalesce(text, ''), {_WHITE}) <> ''),
    lines AS (
        SELECT doc_id, line, count(*) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE trim(line, {_WHITE}) <> '' GROUP BY ALL),
    twice AS (SELECT doc_id, sum((n - 1) * length(line)) / sum(n * length(line)) AS share FROM lines GROUP BY 1),
    paragraphs AS (
        SELECT doc_id, part, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS part FROM texts)
        WHERE trim(part, {_WHITE}) <> '' GROUP BY ALL),
    again AS (SELECT doc_id, sum((n - 1) * length(part)) AS chars FROM paragraphs GROUP BY 1),
    lists AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS raw FROM texts),
    words AS (
        SELECT doc_id, unnest(range(len(raw))) AS nth, trim(unnest(raw), '{quality.EDGE.replace("'", "''")}') AS word FROM lists),
    pairs AS (
        SELECT doc_id, word, after, count(*) AS n FROM (
            SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY nth) AS after FROM words) WHERE after IS NOT NULL GROUP BY ALL),
    top AS (
        SELECT doc_id, n, max(length(word) + length(after)) AS longest FROM pairs
        WHERE n >= 2 GROUP BY doc_id, n QUALIFY n = max(n) OVER (PARTITION BY doc_id))
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(twice.share, 0) END AS duplicate_line_share,
        CASE WHEN d.text IS NOT NULL THEN coalesce(again.chars / length(d.text), 0) END AS duplicate_paragraph_share,
        CASE WHEN d.text IS NOT NULL THEN coalesce(CASE WHEN n >= 2 THEN least(1.0, n * longest / solid) END, 0) END AS top_bigram_share
    FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN top USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_statistics": STATISTICS,
        "p8_repetition": REPETITION,
        "p5_found": LINES + "SELECT evidence_id, line_no FROM lines SEMI JOIN excessive USING (source, line)",
        "p5_lines": SHOWN + "SELECT source, line_text, records FROM shown",
        "p5_blocks": BLOCKS,
        "p5_cleaned": LINES
        + """, kept AS (
            SELECT evidence_id, string_agg(part, chr(10) ORDER BY p.line_no) AS kept
            FROM parts p JOIN lines l USING (evidence_id, source, line_no)
            WHERE (p.source, l.line) NOT IN (SELECT (source, line) FROM excessive)
            GROUP BY evidence_id)
        SELECT e.evidence_id, e.url,
               CASE WHEN r.evidence_id IS NULL THEN e.text ELSE coalesce(k.kept, '') END AS text
        FROM evidence e LEFT JOIN records r USING (evidence_id) LEFT JOIN kept k USING (evidence_id)""",
    }
