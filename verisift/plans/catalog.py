"""The registered queries over the project's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisift.config import LoopSettings
from verisift.functions import decisions, prompts, similarity, snippets, text
from verisift.operators import defense, evidence
from verisift.plans import loop
from verisift.session import table
from verisift.sources.models import RecordedModel
from verisift.sources.search import CorpusSearch, RecordedSearch

Query = Callable[[SparkSession, str], DataFrame]

#: Tolerances and threshold of the repetition queries over the table of embeddings, whose cosines are small. So many
#: vectors in a row are one conversation, within which a label is one history.
TOLERANCES, CLOSE, CONVERSATION = (2, 3, 4), 0.1, 100
#: Settings of the replays: with the first the rounds are used up, with the second queries and evidence repeat.
REPLAY, TIGHT = LoopSettings(max_retries=2, tolerance=3, threshold=0.96), LoopSettings(max_retries=6, tolerance=2, threshold=0.8)
#: Instructions that evidence is compared with.
INSTRUCTIONS = [defense.FAMILIES[f].format(answer="True") for f in ("override", "role_spoof", "authority")]
#: Cosines of letter counts from which evidence is relevant, and up to which it is no instruction.
RELEVANT, INSTRUCTION = 0.85, 0.92


def evidence_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("evidence_id", text.fingerprint(F.col("text")).alias("fingerprint"))


def evidence_source_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("evidence_id", text.source_host(F.col("url")).alias("source"))


def evidence_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.ingest(table(spark, sf, "evidence"), fail=False)


def evidence_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.rejected(table(spark, sf, "evidence"))


def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.dedup(table(spark, sf, "evidence"), "evidence_id", "text")


def build_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.knowledge(table(spark, sf, "searches"))


def final_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.knowledge(table(spark, sf, "searches"), empty="")


def query_history(spark: SparkSession, sf: str) -> DataFrame:
    past = evidence.history(table(spark, sf, "searches"))
    queries = evidence.queries_of(F.col("searches"))
    return past.select("claim_id", F.size(queries).cast("bigint").alias("turns"), F.array_join(queries, "\n").alias("queries"))


def search_history(spark: SparkSession, sf: str) -> DataFrame:
    past = evidence.history(table(spark, sf, "searches"))
    results = evidence.results_of(F.col("searches"))
    return past.select("claim_id", F.size(results).cast("bigint").alias("turns"), F.array_join(results, "\n").alias("results"))


def _claims_with_results(spark: SparkSession, sf: str) -> DataFrame:
    past = evidence.history(table(spark, sf, "searches").where("result IS NOT NULL"))
    known = table(spark, sf, "claims").select("claim_id", "claim").join(past, "claim_id", "left")
    none = F.array().cast("array<string>")
    return known.select("claim_id", "claim", F.coalesce(evidence.results_of(F.col("searches")), none).alias("results"))


def decision_prompt(spark: SparkSession, sf: str) -> DataFrame:
    known = _claims_with_results(spark, sf)
    return known.select("claim_id", prompts.decision_prompt(F.col("claim"), F.col("results")).alias("prompt"))


def final_prompt(spark: SparkSession, sf: str) -> DataFrame:
    known = _claims_with_results(spark, sf)
    return known.select("claim_id", prompts.final_prompt(F.col("claim"), F.col("results")).alias("prompt"))


def _vector_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with those before it in its conversation that share its label, as far as the checks look back."""
    before = Window.partitionBy("talk", "label").orderBy("vec_id").rowsBetween(-max(TOLERANCES), -1)
    seen = Window.partitionBy("talk", "label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    talks = table(spark, sf, "embeddings").withColumn("talk", F.floor(F.col("vec_id") / CONVERSATION))
    return talks.select("vec_id", "embedding", F.collect_list("embedding").over(before).alias("history"), F.count("*").over(seen).alias("turns"))


def similarity_count(spark: SparkSession, sf: str) -> DataFrame:
    last = F.slice("history", -3, 3)
    history = F.when(F.size("history") > 3, last).otherwise(F.col("history"))
    near = similarity.count_similar(F.col("embedding"), history, CLOSE).cast("bigint")
    strict = similarity.count_similar(F.col("embedding"), history, similarity.THRESHOLD).cast("bigint")
    return _vector_history(spark, sf).select("vec_id", near.alias("close"), strict.alias("very_close"))


def early_stop_query(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the vector, as a proposed query, repeats those before it, for each tolerance."""
    stops = {f"stop_{t}": similarity.repeats_query(F.col("embedding"), F.col("history"), t, CLOSE).cast("int") for t in TOLERANCES}
    return _vector_history(spark, sf).select("vec_id", *[c.alias(n) for n, c in stops.items()])


def early_stop_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the last of the vectors before, as results, repeats those before it, for each tolerance."""
    stops = {f"stop_{t}": similarity.repeats_evidence(F.col("history"), t, CLOSE).cast("int") for t in TOLERANCES}
    return _vector_history(spark, sf).select("vec_id", *[c.alias(n) for n, c in stops.items()])


def diversity_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The hints where the vectors up to this one are the queries, and those before it the results."""
    queries = F.array_append("history", F.col("embedding"))
    made = F.array_repeat(F.lit("q"), (F.col("turns") + 1).cast("int"))

    def hints(t: int):
        return prompts.hints(made, similarity.similar_lately(F.col("history"), t, CLOSE), similarity.similar_lately(queries, t, CLOSE))

    return _vector_history(spark, sf).select("vec_id", *[hints(t).alias(f"hints_{t}") for t in TOLERANCES])


def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    search = CorpusSearch(table(spark, sf, "documents"), "doc_id", "text", 3)
    asked = table(spark, sf, "claims").where("claim_id % 20 = 0")
    return search.ranked(asked, "claim_id", "claim").select(
        "claim_id", F.col("rank").cast("bigint").alias("rank"), F.col("document").alias("doc_id"), "score"
    )


def _joined(spark: SparkSession, sf: str, separator: str) -> DataFrame:
    past = evidence.history(table(spark, sf, "searches").where(text.not_blank(F.col("result"))))
    joined = F.array_join(evidence.results_of(F.col("searches")), separator)
    return past.select("claim_id", snippets.joined_or_default(joined).alias("result"))


def snippet_join_space(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, " ")


def snippet_join_para(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "\n\n")


def snippet_parse_keyed(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.to_json(
        F.struct(
            F.struct(F.col("title").alias("answer"), F.concat(F.col("source"), F.lit("\n"), F.col("lang")).alias("snippet")).alias("answerBox"),
            F.struct(F.col("source").alias("title"), F.col("lang").alias("type"), F.create_map(F.lit("chars"), "n_chars").alias("attributes")).alias("knowledgeGraph"),
            F.array(
                F.struct(F.col("text").alias("snippet"), F.create_map(F.lit("lang"), "lang").alias("attributes")),
                F.struct(F.col("url").alias("snippet"), F.lit(None).cast("map<string,string>").alias("attributes")),
            ).alias("organic"),
        )
    )
    return table(spark, sf, "documents").select("doc_id", snippets.keyed_result(answer, 1).alias("result"))


def snippet_parse_listed(spark: SparkSession, sf: str) -> DataFrame:
    content = lambda c: F.struct(F.col(c).alias("content"))
    answer = F.to_json(F.struct(F.array(content("title"), content("text"), content("url")).alias("results")))
    return table(spark, sf, "documents").select("doc_id", snippets.listed_result(answer, 2).alias("result"))


def no_result_default(spark: SparkSession, sf: str) -> DataFrame:
    shown = snippets.joined_or_default(text.strip(F.col("result")))
    return table(spark, sf, "searches").select("search_id", shown.alias("result"))


def query_postamble(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "searches").select("search_id", text.with_postamble(F.col("query"), "site:example").alias("query"))


def normalize_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("claim_id", text.normalize_label(F.col("verdict")).alias("label"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Model calls, each once: some are delivered again unchanged."""
    return table(spark, sf, "model_calls").dropDuplicates(["call_id"])


def extract_decision(spark: SparkSession, sf: str) -> DataFrame:
    read = _calls(spark, sf).select("call_id", decisions.read_decision("response").alias("read"))
    return read.select(
        "call_id", decisions.decision_kind(F.col("read")).alias("kind"), decisions.decision_value(F.col("read")).alias("value")
    )


def final_answer_valid(spark: SparkSession, sf: str) -> DataFrame:
    read = _calls(spark, sf).where("phase = 'final'").select("call_id", decisions.read_decision("response").alias("read"))
    return read.select("call_id", decisions.final_label(F.col("read")).alias("answer"))


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.usage_totals(_calls(spark, sf), ["claim_id"], F.col("raises").isNotNull())


def backoff_schedule(spark: SparkSession, sf: str) -> DataFrame:
    retries = spark.range(0, 9, 1, 1).select(F.col("id").alias("retries"))
    waits = text.backoff_seconds(F.col("retries").cast("int"))
    return retries.select("retries", F.array_join(waits.cast("array<string>"), ",").alias("seconds"))


def segment_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = text.segment_join([F.col("title"), [F.col("provider"), F.col("url")], F.col("text")])
    return table(spark, sf, "evidence").select("evidence_id", joined.alias("segments"))


def search_dicts(spark: SparkSession, sf: str) -> DataFrame:
    past = evidence.history(table(spark, sf, "searches"))
    return past.select("claim_id", evidence.search_dicts(F.col("searches")).alias("searches"))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    search = CorpusSearch(table(spark, sf, "documents"), "doc_id", "text", 3)
    return loop.verify(table(spark, sf, "claims").select("claim_id", "claim"), LoopSettings(), search)


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select(
        "claim_id", "claim", "status", F.col("answer.answer").alias("answer"), F.size("searches").alias("searches"),
        "fallback_reason", "error", "rounds",
    )


def verify_claims_usage(spark: SparkSession, sf: str) -> DataFrame:
    verified = _verified(spark, sf)
    names = ("input_tokens", "output_tokens", "unreported_calls")
    return verified.groupBy("status").agg(F.count("*").alias("claims"), *[F.sum(f"usage.{n}").alias(n) for n in names])


def verify_claims_json(spark: SparkSession, sf: str) -> DataFrame:
    return loop.as_json(_verified(spark, sf))


def _replayed(spark: SparkSession, sf: str, settings: LoopSettings) -> DataFrame:
    """The recorded model calls and searches through the loop: all its ends, with usage and errors."""
    model, search = RecordedModel(table(spark, sf, "model_calls")), RecordedSearch(table(spark, sf, "searches"))
    done = loop.verify(table(spark, sf, "claims").select("claim_id", "claim"), settings, search, model, similarity.LetterCounts())
    return done.select(
        "claim_id", "status", F.col("answer.answer").alias("answer"), F.size("searches").alias("searches"),
        "fallback_reason", "error", "rounds", "usage.*",
    )


def verify_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf, REPLAY)


def verify_replay_tight(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf, TIGHT)


def evidence_risk(spark: SparkSession, sf: str) -> DataFrame:
    scanned = defense.scan(table(spark, sf, "evidence"), "evidence_id", "text")
    return scanned.select("evidence_id", F.round("risk", 6).alias("risk"), F.array_join("hits", ",").alias("hits"))


def evidence_trust(spark: SparkSession, sf: str) -> DataFrame:
    rows = defense.scored(table(spark, sf, "evidence"), table(spark, sf, "claims"))
    return rows.select("evidence_id", "claim_id", "source", F.round("risk", 6).alias("risk"), F.round("trust", 6).alias("trust"))


def evidence_structured(spark: SparkSession, sf: str) -> DataFrame:
    return defense.structured(defense.scored(table(spark, sf, "evidence"), table(spark, sf, "claims")))


def evidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    measured = defense.embedding_filter(
        table(spark, sf, "evidence"), table(spark, sf, "claims"), similarity.LetterCounts(), INSTRUCTIONS, RELEVANT, INSTRUCTION
    )
    return measured.select(
        "evidence_id", "claim_id", F.round("relevance", 6).alias("relevance"), F.round("similarity", 6).alias("similarity"), F.col("kept").cast("int").alias("kept")
    )


def verification_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate where each claim cites the evidence of its second step, and, as some do, an id of the next claim."""
    rows = defense.scored(table(spark, sf, "evidence"), table(spark, sf, "claims"))
    evidence_rows = table(spark, sf, "evidence").where("step = 2")
    cited = evidence_rows.select("claim_id", "evidence_id").unionAll(
        evidence_rows.where("claim_id % 7 = 0").select((F.col("claim_id") - 1).alias("claim_id"), "evidence_id")
    )
    return defense.gated(rows, cited).withColumn("passes", F.col("passes").cast("int"))


def attack_detection(spark: SparkSession, sf: str) -> DataFrame:
    return defense.detection(table(spark, sf, "evidence"), "text")


def evidence_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of pages made of the evidence: its title, its text in a hidden element, its address in JSON-LD."""
    page = F.concat(
        F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit('</title><script type="application/ld+json">{"@id": "'),
        F.coalesce("url", F.lit("")), F.lit('"}</script></head><body><p style="display:none">'), F.coalesce("provider", F.lit("")),
        F.lit("</p><!-- "), F.coalesce("fingerprint", F.lit("")), F.lit(" --></body></html>"),
    )
    return defense.parts_found(table(spark, sf, "evidence").select("evidence_id", page.alias("page")), "evidence_id", "page")


QUERIES: tuple[Query, ...] = (
    evidence_fingerprint, evidence_source_host, evidence_ingest, evidence_rejected, evidence_dedup, build_knowledge,
    final_knowledge, query_history, search_history, decision_prompt, final_prompt, diversity_hints, similarity_count,
    early_stop_query, early_stop_evidence, search_topk, snippet_join_space, snippet_join_para, snippet_parse_keyed,
    snippet_parse_listed, no_result_default, query_postamble, normalize_label, extract_decision, final_answer_valid,
    usage_totals, backoff_schedule, segment_join, search_dicts, evidence_risk, evidence_trust, evidence_structured, evidence_filter,
    verification_gate, attack_detection, evidence_parts, verify_claims, verify_claims_usage, verify_claims_json, verify_replay, verify_replay_tight,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(template: str, claim: str, known: str) -> str:
    """SQL that puts a template together around its values."""
    sql, rest = "", template
    for placeholder, value in ((prompts.KNOWLEDGE, known), (prompts.STATEMENT, claim)):
        before, rest = rest.split(placeholder)
        sql += f"{_quoted(before)} || {value} || "
    return f"trim({sql}{_quoted(rest)}, {WHITE})"


WHITE = _quoted(text.WHITESPACE)
HOST = f"""coalesce(substr(lower(regexp_extract(
    regexp_replace(regexp_replace(url, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g'), {_quoted(text.HOST_PATTERN)}, 1)), 1, 253), '')"""
VALID = f"trim(coalesce(text, ''), {WHITE}) <> '' AND url IS NOT NULL AND title IS NOT NULL AND provider IS NOT NULL"
RESULTS = """(SELECT claim_id, string_agg(result, chr(10) ORDER BY step, search_id) AS results
    FROM searches WHERE result IS NOT NULL AND claim_id IS NOT NULL GROUP BY 1)"""
COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
LAGS = "".join(f", lag(embedding, {n}) OVER w AS before{n}" for n in (1, 2, 3, 4))
VECTORS = f"""(SELECT vec_id, embedding, row_number() OVER w - 1 AS turns{LAGS}
    FROM embeddings WINDOW w AS (PARTITION BY vec_id // {CONVERSATION}, label ORDER BY vec_id))"""


def _near(n: int, threshold: float, of: str = "embedding") -> str:
    return f"coalesce({COSINE.format(of, f'before{n}')} > {threshold}, false)"


def _all_near(numbers: range, of: str) -> str:
    """Whether all of the vectors so many before are close to one."""
    return "(" + " AND ".join(["true", *(_near(n, CLOSE, of) for n in numbers)]) + ")"


def _label(value: str) -> str:
    low = f"lower(trim({value}, {WHITE}))"
    return f"CASE WHEN {low} = 'true' THEN 'True' WHEN {low} = 'false' THEN 'False' END"


#: The last object without inner objects in a response, and its two keys. All responses of the table are
#: free text around at most one such object.
READ = """(SELECT *, object ->> '$.final_answer' AS said, object ->> '$.search_query' AS asked,
        coalesce(json_exists(object, '$.final_answer'), false) AS has_answer,
        coalesce(json_exists(object, '$.search_query'), false) AS has_query FROM (
    SELECT call_id, phase, CASE WHEN json_valid(part) THEN part END AS object FROM (
        SELECT DISTINCT ON (call_id) call_id, phase, list_last(regexp_extract_all(response, '\\{[^{}]*\\}')) AS part FROM model_calls)))"""


#: The corpus search, and the default rule over what it finds.
RANKED = r"""
    WITH postings AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\pL{{5,}}')) AS term FROM documents),
    asked AS (SELECT DISTINCT claim_id, unnest(regexp_extract_all(lower(claim), '\pL{{5,}}')) AS term FROM claims {}),
    scores AS (SELECT claim_id, doc_id, count(*) AS score FROM asked JOIN postings USING (term) GROUP BY ALL),
    ranked AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
               FROM scores QUALIFY rank <= 3)
"""
VERDICTS = r""",
    results AS (SELECT claim_id, string_agg(text, ' ' ORDER BY rank) AS result FROM ranked JOIN documents USING (doc_id) GROUP BY 1),
    words AS (SELECT claim_id, claim, result, list_distinct(regexp_extract_all(lower(claim), '\pL{5,}')) AS wanted,
                     regexp_extract_all(lower(result), '\pL{5,}') AS known
              FROM claims LEFT JOIN results USING (claim_id)),
    judged AS (SELECT *, len(list_intersect(wanted, coalesce(known, []))) AS common,
                      len(wanted) > 0 AND len(list_intersect(wanted, coalesce(known, []))) >= 0.7 * len(wanted) AS verdict FROM words)
"""
VERIFIED = """
    SELECT claim_id, claim, 'final' AS status, CASE WHEN verdict THEN 'True' ELSE 'False' END AS answer,
           1 AS searches, CAST(NULL AS VARCHAR) AS fallback_reason, CAST(NULL AS VARCHAR) AS error, 2 AS rounds
    FROM judged
"""


def _tokens(value: str) -> str:
    """Number of words between white space."""
    return f"len(list_filter(regexp_split_to_array({value}, '[' || {WHITE} || ']+'), lambda x: x <> ''))"


#: What the default rule says and is asked, and the tokens of that: the query, spelled in ASCII as JSON, has no white
#: space but its spaces.
SAID = f""", said AS (
    SELECT *, 'Words found: ' || common || ' of ' || len(wanted) || '. {{"final_answer": "' || CASE WHEN verdict THEN 'True' ELSE 'False' END || '"}}' AS response,
           coalesce(nullif(result, ''), {_quoted(snippets.NO_RESULT)}) AS shown, trim(claim, {WHITE}) AS query FROM judged),
    counted AS (SELECT *,
        CAST({_tokens(_filled(prompts.DECISION_TEMPLATE, "claim", _quoted(prompts.NO_KNOWLEDGE)))}
            + {_tokens(_filled(prompts.DECISION_TEMPLATE, "claim", "shown"))} AS BIGINT) AS input_tokens,
        CAST(1 + len(list_filter(string_split(query, ' '), lambda x: x <> '')) + 7 AS BIGINT) AS output_tokens FROM said)
"""

def _letters(value: str) -> str:
    counted = f"length({value}) * 2 - length(replace({value}, chr(CAST(97 + i AS INTEGER)), '')) - length(replace({value}, chr(CAST(65 + i AS INTEGER)), ''))"
    return f"list_transform(range(26), lambda i: CAST({counted} AS DOUBLE))"


def _alike(a: str, b: str, threshold: float) -> str:
    """Whether the cosine is larger; that of no letters is none."""
    cosine = f"list_cosine_similarity({a}, {b})"
    return f"coalesce(CASE WHEN isnan({cosine}) THEN false ELSE {cosine} > {threshold} END, false)"


def _lags(name: str, count: int) -> str:
    return ", ".join(f"lag({name}, {n}) OVER w AS {name}{n}" for n in range(1, count + 1))


def _outcomes(settings: LoopSettings) -> str:
    """What came of the calls of a claim for each step and for the final answer: the first that raised or is valid ends
    the asking."""
    return f"""
    WITH read AS (SELECT * FROM (SELECT DISTINCT ON (call_id) * FROM model_calls)
                  JOIN (SELECT call_id, said, asked, has_answer, has_query FROM {READ}) USING (call_id)),
    numbered AS (
        SELECT *, CASE WHEN phase = 'decide' THEN step ELSE 0 END AS turn,
            row_number() OVER (PARTITION BY claim_id, phase, CASE WHEN phase = 'decide' THEN step ELSE 0 END ORDER BY step, attempt, call_id) AS nth,
            CASE WHEN raises IS NOT NULL THEN 'error'
                 WHEN phase = 'final' THEN CASE WHEN NOT has_query AND {_label('said')} IS NOT NULL THEN 'answer' ELSE 'invalid' END
                 WHEN has_answer = has_query THEN 'invalid'
                 WHEN has_answer THEN CASE WHEN {_label('said')} IS NOT NULL THEN 'answer' ELSE 'invalid' END
                 WHEN trim(coalesce(asked, ''), {WHITE}) <> '' THEN 'query' ELSE 'invalid' END AS kind,
            CASE WHEN has_query THEN trim(asked, {WHITE}) ELSE {_label('said')} END AS value
        FROM read WHERE claim_id IS NOT NULL),
    kept AS (
        SELECT *, coalesce(min(nth) FILTER (kind <> 'invalid') OVER (PARTITION BY claim_id, phase, turn), {settings.max_retries + 1}) AS last
        FROM numbered WHERE nth <= {settings.max_retries + 1}),
    places AS (SELECT claim_id, phase, turn FROM claims, (SELECT 'decide' AS phase, unnest(range(1, {settings.max_steps + 1})) AS turn
                                                         UNION ALL SELECT 'final', 0)),
    outcomes AS (
        SELECT claim_id, phase, turn, coalesce(max(kind) FILTER (nth = last), 'invalid') AS kind, max(value) FILTER (nth = last) AS value,
            max(raises) FILTER (nth = last) AS raised,
            coalesce(sum(input_tokens) FILTER (raises IS NULL), 0) AS input_tokens, coalesce(sum(output_tokens) FILTER (raises IS NULL), 0) AS output_tokens,
            count(*) FILTER (nth IS NOT NULL AND (raises IS NOT NULL OR input_tokens IS NULL OR output_tokens IS NULL))
            + CASE WHEN coalesce(bool_or(nth = last AND kind <> 'invalid'), false) THEN 0 ELSE {settings.max_retries + 1} - count(nth) END AS unreported
        FROM places LEFT JOIN (SELECT * FROM kept WHERE nth <= last) USING (claim_id, phase, turn) GROUP BY ALL)
"""


def _replay_sql(settings: LoopSettings) -> str:
    """The loop over the outcomes: a claim ends at its first step without a query, or whose query or evidence repeats."""
    return _outcomes(settings) + f""",
    found AS (SELECT claim_id, step AS turn, coalesce(nullif(min_by(result, search_id), ''), {_quoted(snippets.NO_RESULT)}) AS result
              FROM searches WHERE claim_id IS NOT NULL GROUP BY ALL),
    steps AS (
        SELECT o.*, {_letters("coalesce(value, '')")} AS q, {_letters(f"coalesce(result, {_quoted(snippets.NO_RESULT)})")} AS r
        FROM outcomes o LEFT JOIN found USING (claim_id, turn) WHERE phase = 'decide'),
    lagged AS (SELECT *, {_lags('q', settings.tolerance)}, {_lags('r', settings.tolerance)} FROM steps WINDOW w AS (PARTITION BY claim_id ORDER BY turn)),
    ends AS (
        SELECT *, (turn >= {settings.tolerance} AND {' AND '.join(_alike('q', f'q{n}', settings.threshold) for n in range(1, settings.tolerance))})
               OR (turn > {settings.tolerance} AND {' AND '.join(_alike('r1', f'r{n}', settings.threshold) for n in range(2, settings.tolerance + 1))}) AS early
        FROM lagged),
    last AS (SELECT claim_id, coalesce(min(turn) FILTER (kind <> 'query' OR early), {settings.max_steps + 1}) AS ended FROM ends GROUP BY 1),
    spent AS (
        SELECT claim_id, ended, sum(input_tokens) FILTER (turn <= ended) AS input_tokens, sum(output_tokens) FILTER (turn <= ended) AS output_tokens,
            sum(unreported) FILTER (turn <= ended) AS unreported, max(kind) FILTER (turn = ended) AS kind, max(value) FILTER (turn = ended) AS value,
            max(raised) FILTER (turn = ended) AS raised
        FROM ends JOIN last USING (claim_id) GROUP BY ALL),
    judged AS (
        SELECT s.*, f.kind AS final_kind, f.value AS final_value, f.raised AS final_raised, f.input_tokens AS final_in, f.output_tokens AS final_out,
            f.unreported AS final_unreported, coalesce(s.kind, 'query') IN ('query', 'invalid') AS fallen
        FROM spent s JOIN (SELECT * FROM outcomes WHERE phase = 'final') f USING (claim_id))
    SELECT claim_id,
        CASE WHEN blank THEN 'error' WHEN NOT fallen THEN CASE kind WHEN 'answer' THEN 'final' ELSE 'error' END
             WHEN final_kind = 'answer' THEN 'final' WHEN final_kind = 'error' THEN 'error' ELSE 'no_verdict' END AS status,
        CASE WHEN blank THEN NULL WHEN NOT fallen AND kind = 'answer' THEN value WHEN fallen AND final_kind = 'answer' THEN final_value END AS answer,
        CAST(CASE WHEN blank THEN 0 ELSE ended - 1 END AS INTEGER) AS searches,
        CASE WHEN blank OR NOT fallen THEN NULL WHEN ended > {settings.max_steps} THEN '{loop.ALL_ROUNDS}'
             WHEN kind = 'invalid' THEN '{loop.NO_DECISION}' ELSE '{loop.REPEATED}' END AS fallback_reason,
        CASE WHEN blank THEN 'ValueError: a claim must hold a word' WHEN NOT fallen THEN raised WHEN final_kind = 'error' THEN final_raised END AS error,
        CAST(CASE WHEN blank THEN 0 ELSE least(ended, {settings.max_steps}) END AS INTEGER) AS rounds,
        CAST(CASE WHEN blank THEN 0 ELSE j.input_tokens + CASE WHEN fallen THEN final_in ELSE 0 END END AS BIGINT) AS input_tokens,
        CAST(CASE WHEN blank THEN 0 ELSE j.output_tokens + CASE WHEN fallen THEN final_out ELSE 0 END END AS BIGINT) AS output_tokens,
        CAST(CASE WHEN blank THEN 0 ELSE j.unreported + CASE WHEN fallen THEN final_unreported ELSE 0 END END AS BIGINT) AS unreported_calls
    FROM judged j JOIN (SELECT claim_id, trim(coalesce(claim, ''), {WHITE}) = '' AS blank FROM claims) USING (claim_id)
"""


def _risk(value: str) -> str:
    weights = " + ".join(f"CASE WHEN regexp_matches({value}, {_quoted('(?i)' + p)}) THEN {defense.WEIGHTS[n]} ELSE 0 END" for n, p in defense.RULES.items())
    return f"CAST(coalesce(least({weights}, 1), 0) AS DOUBLE)"


def _scan_risk(value: str) -> str:
    """The largest risk of the windows of a text."""
    size, step = defense.WINDOW_WORDS, defense.WINDOW_STEP
    words = f"regexp_split_to_array({value}, '\\s+')"
    last = f"greatest(len({words}) - {size}, 0)"
    starts = f"list_append(range(0, {last} + 1, {step}), {last})"
    return f"coalesce(list_max(list_transform({starts}, lambda s: {_risk(f'array_to_string({words}[s + 1:s + {size}], chr(32))')})), 0)"


def _terms(value: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({value}), '\\pL{{5,}}'))"


#: Evidence with risk and trust, as the guards score it.
SCORED = f"""(SELECT evidence_id, e.claim_id, {HOST} AS source, text, risk,
        greatest(least({defense.TRUST[0]} * coalesce(CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, {_terms('text')})) / len(wanted) END, 0)
            + {defense.TRUST[1]} * least(length(text) / 200.0, 1) + {defense.TRUST[2]} * CAST({HOST} <> '' AS INTEGER) - {defense.TRUST[3]} * risk, 1), 0) AS trust
    FROM (SELECT *, {_risk('text')} AS risk FROM evidence WHERE trim(coalesce(text, ''), {WHITE}) <> '') e
    LEFT JOIN (SELECT claim_id, {_terms('claim')} AS wanted FROM claims) c ON e.claim_id = c.claim_id)"""


def _attacked(family: str) -> str:
    """A text with an instruction of a family in its middle."""
    plain = defense.FAMILIES["override"].format(answer="True")
    added = {"encoded": base64.b64encode(plain.encode()).decode(), "unicode": "\u200b".join(plain)}.get(family)
    added = added or defense.FAMILIES[family].format(answer="True")
    half = "CAST(floor(length(text) / 2) AS BIGINT)"
    return f"substr(text, 1, {half}) || chr(10) || {_quoted(added)} || chr(10) || substr(text, {half} + 1)"


PAGE = """'<html><head><title>' || coalesce(title, '') || '</title><script type="application/ld+json">{"@id": "' || coalesce(url, '')
    || '"}</script></head><body><p style="display:none">' || coalesce(provider, '') || '</p><!-- ' || coalesce(fingerprint, '') || ' --></body></html>'"""


def oracle_sql() -> dict[str, str]:
    joined = f"""SELECT claim_id, string_agg(result, {{}} ORDER BY step, search_id) AS result FROM searches
        WHERE trim(coalesce(result, ''), {WHITE}) <> '' AND claim_id IS NOT NULL GROUP BY 1"""
    knowledge = "SELECT claim_id, coalesce(nullif(results, ''), {}) AS knowledge FROM " + RESULTS
    asked = "SELECT c.claim_id, {} AS prompt FROM claims c LEFT JOIN " + RESULTS + " r USING (claim_id)"
    return {
        "evidence_fingerprint": "SELECT evidence_id, substr(sha256(text), 1, 16) AS fingerprint FROM evidence",
        "evidence_source_host": f"SELECT evidence_id, {HOST} AS source FROM evidence",
        "evidence_ingest": f"""SELECT text, url, title, provider, {HOST} AS source,
            substr(sha256(text), 1, 16) AS fingerprint FROM evidence WHERE {VALID}""",
        "evidence_rejected": f"SELECT text, url, title, provider FROM evidence WHERE NOT ({VALID})",
        "evidence_dedup": """SELECT substr(sha256(text), 1, 16) AS fingerprint, min(evidence_id) AS evidence_id,
            count(*) AS copies FROM evidence WHERE text IS NOT NULL GROUP BY 1""",
        "build_knowledge": knowledge.format("'N/A'"),
        "final_knowledge": knowledge.format("''"),
        "query_history": """SELECT claim_id, count(*) AS turns,
            coalesce(string_agg(query, chr(10) ORDER BY step, search_id), '') AS queries FROM searches
            WHERE claim_id IS NOT NULL GROUP BY 1""",
        "search_history": """SELECT claim_id, count(*) AS turns,
            coalesce(string_agg(result, chr(10) ORDER BY step, search_id), '') AS results FROM searches
            WHERE claim_id IS NOT NULL GROUP BY 1""",
        "decision_prompt": asked.format(_filled(prompts.DECISION_TEMPLATE, "claim", "coalesce(nullif(results, ''), 'N/A')")),
        "final_prompt": asked.format(_filled(prompts.FINAL_TEMPLATE, "claim", "coalesce(results, '')")),
        "diversity_hints": "SELECT vec_id, " + ", ".join(
            f"""CASE WHEN turns + 1 >= 2 THEN {_quoted(prompts.DIVERSE_HINT)} ELSE '' END
            || CASE WHEN turns >= {t - 1} AND {_all_near(range(2, t), 'before1')} THEN {_quoted(prompts.EVIDENCE_HINT)} ELSE '' END
            || CASE WHEN turns + 1 >= {t - 1} AND {_all_near(range(1, t - 1), 'embedding')} THEN {_quoted(prompts.QUERY_HINT)} ELSE '' END AS hints_{t}"""
            for t in TOLERANCES) + f" FROM {VECTORS}",
        "similarity_count": f"""SELECT vec_id,
            CAST({' + '.join(f'CAST({_near(n, CLOSE)} AS BIGINT)' for n in (1, 2, 3))} AS BIGINT) AS close,
            CAST({' + '.join(f'CAST({_near(n, similarity.THRESHOLD)} AS BIGINT)' for n in (1, 2, 3))} AS BIGINT) AS very_close
            FROM {VECTORS}""",
        "early_stop_query": "SELECT vec_id, " + ", ".join(
            f"CAST(turns >= {t - 1} AND {_all_near(range(1, t), 'embedding')} AS INTEGER) AS stop_{t}" for t in TOLERANCES) + f" FROM {VECTORS}",
        "early_stop_evidence": "SELECT vec_id, " + ", ".join(
            f"CAST(turns >= {t} AND {_all_near(range(2, t + 1), 'before1')} AS INTEGER) AS stop_{t}" for t in TOLERANCES) + f" FROM {VECTORS}",
        "search_topk": RANKED.format("WHERE claim_id % 20 = 0") + "SELECT * FROM ranked",
        "verify_claims": RANKED.format("") + VERDICTS + VERIFIED,
        "verify_claims_usage": RANKED.format("") + VERDICTS + SAID + """SELECT 'final' AS status, count(*) AS claims,
            CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
            CAST(0 AS BIGINT) AS unreported_calls FROM counted""",
        "verify_claims_json": RANKED.format("") + VERDICTS + SAID + """SELECT claim_id, CAST(to_json({
            'claim': claim, 'result': {'response': response, 'answer': CASE WHEN verdict THEN 'True' ELSE 'False' END},
            'searches': {'google_searches': [{'query': query, 'result': shown}]},
            'usage': {'input_tokens': input_tokens, 'output_tokens': output_tokens, 'unreported_calls': 0}}) AS VARCHAR) AS json FROM counted""",
        "verify_replay": _replay_sql(REPLAY),
        "verify_replay_tight": _replay_sql(TIGHT),
        "evidence_risk": f"""SELECT evidence_id, round({_scan_risk('text')}, 6) AS risk, coalesce(array_to_string(list_filter([
            {', '.join(f"CASE WHEN regexp_matches(text, {_quoted('(?i)' + p)}) THEN '{n}' END" for n, p in defense.RULES.items())}],
            lambda x: x IS NOT NULL), ','), '') AS hits FROM evidence""",
        "evidence_trust": f"SELECT evidence_id, claim_id, source, round(risk, 6) AS risk, round(trust, 6) AS trust FROM {SCORED}",
        "evidence_structured": f"""SELECT claim_id, CAST(to_json(list({{'id': evidence_id, 'source': source, 'risk': round(risk, 4),
            'trust': round(trust, 4), 'text': text}} ORDER BY trust DESC, evidence_id)) AS VARCHAR) AS evidence FROM (
            SELECT * FROM {SCORED} WHERE risk < {defense.QUARANTINE} AND claim_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY trust DESC, evidence_id) <= 5) GROUP BY 1""",
        "evidence_filter": f"""SELECT evidence_id, claim_id, round(relevance0, 6) AS relevance, round(similarity0, 6) AS similarity,
            CAST(relevance0 >= {RELEVANT} AND similarity0 <= {INSTRUCTION} AS INTEGER) AS kept FROM (
            SELECT evidence_id, claim_id, coalesce(list_cosine_similarity(v, c), 0) AS relevance0,
                greatest({', '.join(f'list_cosine_similarity(v, {similarity.LetterCounts().encode([i])[0]})' for i in INSTRUCTIONS)}, 0) AS similarity0
            FROM (SELECT *, {_letters('text')} AS v FROM evidence WHERE trim(coalesce(text, ''), {WHITE}) <> '') e
            LEFT JOIN (SELECT claim_id, {_letters('claim')} AS c FROM claims) USING (claim_id))""",
        "verification_gate": f"""WITH known AS (SELECT claim_id, evidence_id, risk FROM {SCORED} WHERE claim_id IS NOT NULL),
            second AS (SELECT claim_id, evidence_id FROM evidence WHERE step = 2 AND claim_id IS NOT NULL),
            asked AS (SELECT DISTINCT claim_id, evidence_id, true AS cited FROM (
                SELECT * FROM second UNION ALL SELECT claim_id - 1, evidence_id FROM second WHERE claim_id % 7 = 0))
            SELECT *, CAST(safe >= 1 AND unknown = 0 AND filtered = 0 AS INTEGER) AS passes FROM (
                SELECT claim_id, count(*) FILTER (risk < {defense.QUARANTINE}) AS safe, count(cited) AS cited,
                    count(*) FILTER (cited AND risk IS NULL) AS unknown, count(*) FILTER (cited AND risk >= {defense.QUARANTINE}) AS filtered
                FROM known FULL JOIN asked USING (claim_id, evidence_id) GROUP BY 1)""",
        "attack_detection": " UNION ALL ".join(
            f"""SELECT '{f}' AS family, count(*) AS texts, count(*) FILTER ({_risk('t')} > 0) AS detected,
            count(*) FILTER ({_scan_risk('t')} >= {defense.QUARANTINE}) AS quarantined FROM (SELECT {_attacked(f)} AS t FROM evidence WHERE text IS NOT NULL)"""
            for f in (*defense.FAMILIES, *defense.HIDDEN_FAMILIES)),
        "evidence_parts": "SELECT evidence_id, part, n, text, round(risk, 6) AS risk FROM (" + " UNION ALL ".join(
            f"""SELECT evidence_id, '{name}' AS part, CAST(n AS INTEGER) AS n, text, {_risk('text')} AS risk FROM (
            SELECT evidence_id, unnest(found) AS text, unnest(range(1, len(found) + 1)) AS n FROM (
            SELECT evidence_id, regexp_extract_all({PAGE}, {_quoted(pattern)}, 1) AS found FROM evidence))"""
            for name, pattern in defense.PARTS.items()) + ")",
        "snippet_join_space": joined.format("' '"),
        "snippet_join_para": joined.format("chr(10) || chr(10)"),
        "snippet_parse_keyed": f"""SELECT doc_id, coalesce(nullif(array_to_string(list_filter([
                nullif(title, ''), source || ' ' || lang, coalesce(source, 'None') || ': ' || lang || '.',
                coalesce(source, 'None') || ' chars: ' || coalesce(CAST(n_chars AS VARCHAR), 'None') || '.',
                CASE WHEN trim(coalesce(text, ''), {WHITE}) <> '' THEN text END, 'lang: ' || coalesce(lang, 'None') || '.'],
                lambda x: x IS NOT NULL), ' '), ''), {_quoted(snippets.NO_RESULT)}) AS result FROM documents""",
        "snippet_parse_listed": f"""SELECT doc_id, coalesce(nullif(array_to_string(list_filter(
                [trim(title, {WHITE}), trim(text, {WHITE})], lambda x: x <> ''), chr(10) || chr(10)), ''), {_quoted(snippets.NO_RESULT)}) AS result
            FROM documents""",
        "no_result_default": f"""SELECT search_id, coalesce(nullif(trim(result, {WHITE}), ''), {_quoted(snippets.NO_RESULT)}) AS result
            FROM searches""",
        "query_postamble": "SELECT search_id, query || ' site:example' AS query FROM searches",
        "normalize_label": f"SELECT claim_id, {_label('verdict')} AS label FROM claims",
        "extract_decision": f"""SELECT call_id, CASE WHEN has_answer = has_query THEN 'invalid'
                WHEN has_answer AND {_label('said')} IS NOT NULL THEN 'answer'
                WHEN has_query AND trim(asked, {WHITE}) <> '' THEN 'query' ELSE 'invalid' END AS kind,
            CASE WHEN has_answer = has_query THEN NULL WHEN has_answer THEN {_label('said')}
                ELSE nullif(trim(asked, {WHITE}), '') END AS value FROM {READ}""",
        "final_answer_valid": f"""SELECT call_id, CASE WHEN NOT has_query THEN {_label('said')} END AS answer FROM {READ}
            WHERE phase = 'final'""",
        "usage_totals": """SELECT claim_id,
            CAST(sum(CASE WHEN raises IS NULL THEN coalesce(input_tokens, 0) ELSE 0 END) AS BIGINT) AS input_tokens,
            CAST(sum(CASE WHEN raises IS NULL THEN coalesce(output_tokens, 0) ELSE 0 END) AS BIGINT) AS output_tokens,
            count(*) FILTER (raises IS NOT NULL OR input_tokens IS NULL OR output_tokens IS NULL) AS unreported_calls,
            count(*) AS calls FROM (SELECT DISTINCT ON (call_id) * FROM model_calls) GROUP BY 1""",
        "backoff_schedule": """SELECT retries, coalesce((SELECT string_agg(CAST(least(power(2, a), 30) AS INTEGER), ',' ORDER BY a)
            FROM range(0, 8) t(a) WHERE a < retries), '') AS seconds FROM range(0, 9) r(retries)""",
        "segment_join": f"""SELECT evidence_id, trim(trim(coalesce(title, 'None'), {WHITE}) || repeat(chr(10), 3) || coalesce(provider, 'None')
            || repeat(chr(10), 3) || coalesce(url, 'None') || repeat(chr(10), 3) || trim(coalesce(text, 'None'), {WHITE}), {WHITE}) AS segments
            FROM evidence""",
        "search_dicts": """SELECT claim_id, CAST(to_json({'google_searches': list({'query': query, 'result': result}
            ORDER BY step, search_id)}) AS VARCHAR) AS searches FROM searches WHERE claim_id IS NOT NULL GROUP BY 1""",
    }
