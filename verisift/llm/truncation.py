"""Problem 2: text cut off by field limits or in transfer.

Method: the length of every value is recomputed under several encodings (characters, UTF-8, UTF-16, with
entities, escaped for JSON, with CRLF line ends) and counted per source and encoding: a length at which
far more unfinished values lie than around it is a hidden limit of the source, unless a stronger limit of
the source explains it, as the same values have both lengths. Then the endings are inspected: marks of a
cut, open structures, and unfinished last sentences. An ending that is open is a cut where the value has the
length of a hidden limit and does not end in a line that recurs. What a finished ending looks like is
learned from the endings of all values: skeletons of sentences that end with a full stop, words that end
sentences, last lines that recur, and names and values of list fields.

Values are read once, in Arrow batches; what follows works on their endings. Skeletons are compared by
chained hashes of their words, so that all beginnings of one take as much work as its length. All counts are
combined on the map side; the learned tables are joined to the few unfinished values through size-checked
joins.

Defined results for odd input: null, empty and blank values are no cases and count in no rate; values of
a source without a limit are judged by their ending alone; null sources count as the empty one; equal ids are judged row by row and reported
once; extra columns are ignored, whatever their names. Work is linear in the length of a value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.text import not_blank
from verisift.llm.residue import local_kind
from verisift.operators.joins import sized_join
from verisift.session import cut_lineage

ENCODINGS = ("characters", "utf8", "utf16", "entities", "json", "crlf")
#: A length is a limit of its source when so many unfinished values have it, and so many times the mean
#: of the lengths up to SPAN around it.
LIMIT_VALUES, LIMIT_TIMES, SPAN = 6, 5, 10
#: Share of a limit's values that have the length of a stronger one, from which that explains it.
EXPLAINED = 0.6
#: Different values from which a last line recurs, share of the records of the sources where it stands that
#: they must be, and times by which the line it begins must be more frequent.
RECURRING, RECURRING_SHARE, BEGUN = 10, 0.001, 5
#: Times the usual share from which an unfinished form is a finished one of its own (a heading, a card).
UNUSUAL, UNUSUAL_LEAST = 6.0, 6
#: First words open no sentence when they open so many times as many unfinished endings as sentences.
UNUSUAL_OPENER = 0.5

_TERMINAL = r"[.!?…。؟]"
_CLOSING = r"[\"'”’»)\]}*_]"
_ENDED = re.compile(rf"{_TERMINAL}\s*{_CLOSING}*(?:\s*{_CLOSING})?$")
_DECORATED = re.compile(rf"{_TERMINAL}\s*{_CLOSING}*\s*[;,|·*_~=–—-]+$")
_MARKED = re.compile(r"(?:\[(?:…|\.\.\.|more|truncated|cut|continued)\]|\((?:\.\.\.|more|truncated|continued)\)|…|\.\.\.|»»|>>)$", re.IGNORECASE)
_FULL = re.compile(rf"(?<!\.\.)[.!?。؟]\s*{_CLOSING}*$")
_ASIDE = re.compile(r"\([^()]*\)$")
_ADDRESS = re.compile(r"(?:^|\s|[(<\"“])((?:https?://|www\.)\S*)$", re.IGNORECASE)
_WHOLE_ADDRESS = re.compile(r"^(?:https?://)?[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?:[/?#:]\S*)?$", re.IGNORECASE)
_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?$")
#: Three dots right after a word, as some write for a full stop.
_DOTS = re.compile(rf"[^\s.]\.\.\.\s*{_CLOSING}*$")
_ENTITY = re.compile(r"&(?:[A-Za-z]{0,8}|#\d{0,6}|#x[0-9A-Fa-f]{0,6})$")
_OPEN_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|/|!-*)?$")
_CLOSED_TAG = re.compile(r"</[A-Za-z][A-Za-z0-9]*>$")
_HANGING = re.compile(r"(?:[,:/(\[{“«„‘<&@#+=]|(?<=\w)[-–—])$")
_SYMBOL_END = re.compile("[←-⯿\U0001f000-\U0001faff️‍]$")
_SENTENCE = re.compile(rf"(?<!\b\d\.)(?<!\b\d\d\.)(?<={_TERMINAL})[\"'”’»)\]]*\s+")
_TRIM = "\"'“”‘’«»„()[]{}<>*_~·•-–—|=.!?…"
_PAIRS = (("“", "”"), ("«", "»"), ("(", ")"), ("[", "]"), ("{", "}"))
_LIST = re.compile(r"^\s*[^\s:=;|,][^:=;|\n]{0,40}?\s*[:=]\s*\S")
_FIELD = re.compile(r"^\s*([^:=]{1,40}?)\s*[:=]\s*(.*?)\s*$", re.DOTALL)

ENDING = T.StructType(
    [
        T.StructField("state", T.StringType()),  # whole, cut, field, dots, open
        T.StructField("tokens", T.IntegerType()),  # of the skeleton
        T.StructField("form", T.LongType()),  # hash of the skeleton
        T.StructField("parent", T.LongType()),  # of the skeleton without its last word
        T.StructField("last_word", T.StringType()),
        T.StructField("opener", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("finished", T.ArrayType(T.StringType())),
        T.StructField("final_words", T.ArrayType(T.StringType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
    ]
)


def lengths(value: str) -> list[int]:
    """Length of a value under each of ENCODINGS."""
    n, amp = len(value), value.count
    return [
        n,
        len(value.encode("utf-8", "surrogatepass")),
        len(value.encode("utf-16-le", "surrogatepass")) // 2,
        n + 4 * amp("&") + 3 * (amp("<") + amp(">")) + 5 * (amp('"') + amp("'")),
        n + sum(map(amp, '"\\\n\r\t')),
        n + amp("\n") - amp("\r\n"),
    ]


def skeleton(sentence: str, function_words: frozenset[str]) -> tuple[str, str]:
    """(cased, uncased) form of a sentence: function words as they are, numbers as 0, other words as w, or
    A where they start with a capital; commas and colons stay."""
    cased, uncased = [], []
    for token in sentence.split():
        word = token.strip(_TRIM + ",;:")
        if not word:
            if token in "-–—" and not cased:
                cased.append(token)
                uncased.append(token)
            continue
        low = word.lower()
        if "://" in low or low.startswith("www."):
            kind = "u"
        elif any(map(str.isdigit, word)):
            kind = "0"
        elif low in function_words:
            kind = low
        else:
            kind = "A" if word[0].isupper() else "w"
        sign = token[-1] if token[-1] in ",:;" else ""
        uncased.append(("w" if kind == "A" else kind) + sign)
        if kind == "A" and cased and cased[-1] == "A":
            cased[-1] = "A" + sign
        else:
            cased.append(kind + sign)
    return " ".join(cased), " ".join(uncased)


def _ordinary_case(line: str) -> bool:
    """Whether the line is neither in capitals nor in small letters nor in any case turned round."""
    letters = [w for w in line.split() if w[0].isalpha()]
    upper = sum(1 for w in letters if w[0].isupper())
    turned = sum(1 for w in letters if len(w) > 1 and w[0].islower() and w[1:].isupper())
    shouted = sum(1 for w in letters if len(w) > 1 and w.isupper())
    return bool(letters) and not (turned or shouted > 0.5 * len(letters) or upper > 0.85 * len(letters) > 3 or not upper)


def _last_word(text: str) -> str:
    """The last word without case and signs; digits as 9, so that numbers compare by their form."""
    words = text.split()
    return re.sub(r"\d", "9", words[-1].strip(_TRIM + ",;:").lower()) if words else ""


def _opener(text: str) -> str:
    """The first word as _last_word gives the last, behind a ^."""
    return "^" + _last_word(text.split(None, 1)[0]) if text.strip() else "^"


@lru_cache(maxsize=1 << 16)
def text_hash(text: str) -> int:
    """64 bits that stand for a text, as prefix_hashes gives last."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def chained(skeleton: str) -> list[int]:
    """Hashes of the beginnings of a skeleton, each a word longer; the last is that of the skeleton."""
    state, found = 0, []
    for word in skeleton.split(" "):
        state = (state * 0x9E3779B97F4A7C15 + text_hash(word)) & 0xFFFFFFFFFFFFFFFF
        found.append(state - (state >> 63 << 64))
    return found


def _form(skeleton: str) -> tuple[int, int, int | None]:
    """(tokens, form, parent) of a skeleton."""
    chain = chained(skeleton)
    return len(chain), chain[-1], chain[-2] if len(chain) > 1 else None


def prefix_hashes(text: str) -> list[int]:
    """64-bit hashes of the text's beginnings, each a character longer; the last is that of the text."""
    state, found = blake2b(digest_size=8), []
    for sign in text:
        state.update(sign.encode("utf-8", "surrogatepass"))
        found.append(int.from_bytes(state.copy().digest(), "big", signed=True))
    return found


def _last_lines(text: str) -> str:
    """The last line, with the lines before it of which it is the wrapped remainder."""
    lines = text.split("\n")
    at = len(lines) - 1
    while at and len(lines[at - 1].split()) >= 5 and 40 <= len(lines[at - 1].strip()) <= 100 and not _ENDED.search(lines[at - 1].rstrip()):
        at -= 1
    return " ".join(x.strip() for x in lines[at:])


def _open_structure(text: str) -> bool:
    """Whether the last line opens a quotation or bracket that it does not close."""
    line = text.rsplit("\n", 1)[-1]
    return any(line.count(a) > line.count(b) and line.rfind(a) > line.rfind(b) for a, b in _PAIRS)


def _json_state(text: str) -> str | None:
    """whole or cut for a text that begins as a JSON object or list, else null."""
    if not re.match(r"[\[{]\s*[\"{\[]|\{\s*$", text):
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text)
        return "whole" if not text[end:].strip() else None
    except (ValueError, RecursionError):  # broken, or nested too deeply to be read
        pass
    return "cut" if text[-1] not in "]}" or text.count("{") > text.count("}") else "whole"


def list_fields(text: str) -> list[str] | None:
    """The fields of a text that is a list of names and values on one line, else null."""
    if not _LIST.match(text) or text.count(":") + text.count("=") < 3:
        return None
    for separator in (";", "|", ", "):
        parts = text.split(separator)
        while parts and not parts[-1].strip():
            parts.pop()
        if len(parts) >= 3 and all(_FIELD.match(p) and len(_FIELD.match(p)[1].split()) <= 4 for p in parts[:-1]):
            return parts
    return None


def ending(value: str, function_words: frozenset[str]) -> tuple:
    """How a value ends, in the order of ENDING."""
    text = value.rstrip()
    flat = text.lstrip()
    size = lengths(value)

    def judged(state: str) -> tuple:
        return state, *[None] * 8, size if state == "cut" else None

    if not flat:
        return judged("whole")
    if text[-1] == "�":
        return judged("cut")
    structured = _json_state(flat)
    if structured:
        return judged(structured)
    if _CLOSED_TAG.search(text) or _SYMBOL_END.search(text):
        return judged("whole")
    if text.endswith("(…)"):
        return judged("whole" if _ENDED.search(text[:-3].rstrip()) else "cut")
    mark = _MARKED.search(text)
    dots = bool(mark) and bool(_DOTS.search(text))
    if mark and not dots:
        return judged("whole" if mark[0][0] not in "[(" and _ENDED.search(text[: mark.start()].rstrip()) else "cut")
    if dots:  # three dots may stand for the full stop of a finished sentence
        text = re.sub(rf"\.\.\.\s*{_CLOSING}*$", "", text)
        if _ENDED.search(text):
            return judged("whole")
    line = _last_lines(text)
    sentences = [s for s in _SENTENCE.split(line) if s.strip()]
    ended = bool(_ENDED.search(text) and not _bare_bracket(text)) or bool(_DECORATED.search(text))
    complete = sentences if ended else sentences[:-1]
    cased = _ordinary_case(line)
    finished, finals = [], []
    for s in complete:
        if not _FULL.search(s.rstrip(";,|·*_~=–—- ")):
            continue
        a, b = skeleton(s, function_words)
        finished += [a, "~" + b] if cased and a != b else ["~" + b]
        finals += [_last_word(s), _opener(s)]
    if ended:
        return "whole", *[None] * 6, finished, finals, None
    address = _ADDRESS.search(text)
    if _ENTITY.search(text) or _OPEN_TAG.search(text) or _ESCAPE.search(text) or _HANGING.search(text) or _open_structure(text):
        return "cut", *[None] * 6, finished, finals, size
    if address and not _WHOLE_ADDRESS.match(address[1]):
        return "cut", *[None] * 6, finished, finals, size
    if _ASIDE.search(text) and _ASIDE.fullmatch(sentences[-1].strip()):
        return "whole", *[None] * 6, finished, finals, None
    fields = list_fields(flat) if "\n" not in flat else None
    if fields:
        names = ["#" + _FIELD.match(p)[1].lower() for p in fields[:-1]]
        ends = [f"#{_FIELD.match(p)[1].lower()}#{_value_end(_FIELD.match(p)[2])}" for p in fields[:-1]]
        last = _FIELD.match(fields[-1])
        if not last or not last[2]:
            return "cut", *[None] * 6, names, ends, size
        name = "#" + last[1].lower()
        return "field", *_form(name), f"{name}#{_value_end(last[2])}", None, None, names, ends, size
    fragment = re.sub(r"\s[-–—|]+$", "", sentences[-1]).strip()
    a, b = skeleton(fragment, function_words)
    key = None if dots else " ".join(line.lower().split())
    return "dots" if dots else "open", *_form(a if cased and a != b else "~" + b), _last_word(fragment), _opener(fragment), key, finished, finals, size


def _bare_bracket(text: str) -> bool:
    """An end on a closing bracket or quotation mark without a full stop before it."""
    return not re.search(rf"{_TERMINAL}\s*{_CLOSING}*(?:\s*{_CLOSING})?$", text)


def _value_end(value: str) -> str:
    """What the end of a field's value is compared by: its last word, or 0 for a number."""
    word = _last_word(value)
    return "0" if any(map(str.isdigit, word)) else word


def endings(records: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(record_type, record_id, source, fields of ENDING) of records (record_type, record_id, source,
    text) that are not template residue by their own signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                if local_kind(text) is None:
                    kept.append(at)
                    found = ending(text, function_words)
                    line = found[ENDING.names.index("line")]
                    rows.append((*found, line and text_hash(line), line and text_hash(" ".join(text.lower().split()))))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(ENDING) + 2)
            taken = [batch.column(name).take(pa.array(kept, pa.int64())) for name in ("record_type", "record_id", "source")]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.string()] * 3 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.int32())] + [pa.int64()] * 2
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*taken, *arrays], ["record_type", "record_id", "source", *ENDING.names, "line_key", "value"])

    source = F.coalesce("source", F.lit("")).alias("source")
    given = records.select("record_type", "record_id", source, "text").where(not_blank(F.col("text")))
    schema = T.StructType(
        [
            T.StructField("record_type", T.StringType()),
            T.StructField("record_id", records.schema["record_id"].dataType),
            T.StructField("source", T.StringType()),
            *ENDING.fields,
            T.StructField("line_key", T.LongType()),  # hash of the line
            T.StructField("value", T.LongType()),  # hash of the whole value, equal for copies
        ]
    )
    return given.mapInArrow(run, schema)


def _lengths_of() -> Column:
    """The (encoding, length) pairs of a value as an array."""
    return F.transform("lengths", lambda n, i: F.struct(i.alias("encoding"), n.alias("length")))


def limits(ends: DataFrame) -> DataFrame:
    """(record_type, source, encoding, length, records, around): the hidden limits of each source, records
    being the unfinished values of that length and around the mean of those near it.

    One task orders the distinct lengths of one source and encoding, which no number of rows makes more
    than the longest value has characters.
    """
    by = ["record_type", "source"]
    unfinished = ends.where("lengths IS NOT NULL").select(*by, _lengths_of().alias("at"))
    counted = unfinished.select(*by, F.explode("at").alias("x")).select(*by, "x.*").groupBy(*by, "encoding", "length").agg(F.count("*").alias("records"))
    near = Window.partitionBy(*by, "encoding").orderBy("length").rangeBetween(-SPAN, SPAN)
    around = (F.sum("records").over(near) - F.col("records")) / (2.0 * SPAN)
    enough = (F.col("records") >= LIMIT_VALUES) & (F.col("records") >= LIMIT_TIMES * F.col("around"))
    possible = cut_lineage(counted.withColumn("around", around).where(enough))
    # What a value has of the possible limits, at most one for each encoding, and which go together.
    strength = F.struct(F.col("records"), (-F.col("encoding")).alias("first"), F.col("encoding"), F.col("length"))
    lists = cut_lineage(possible.groupBy(*by).agg(F.collect_list(strength).alias("possible")))  # a few for each encoding
    here = F.filter("possible", lambda p: F.array_contains("at", F.struct(p["encoding"].alias("encoding"), p["length"].alias("length"))))
    hits = sized_join(unfinished, lists, by).select(*by, here.alias("here"))
    pairs = hits.select(*by, F.explode("here").alias("a"), "here").select(*by, "a", F.explode("here").alias("b")).where("a < b")
    together = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= F.lit(EXPLAINED) * F.col("a.records"))
    explained = together.select(*by, "a.encoding", "a.length").distinct()
    return possible.join(explained, [*by, "encoding", "length"], "left_anti")


def _exploded(ends: DataFrame, column: str, name: str) -> DataFrame:
    return ends.where(F.col(column).isNotNull()).select(F.explode(column).alias(name))


def recurring_lines(ends: DataFrame, unsure: DataFrame) -> DataFrame:
    """(line_key, same, recurs): the different values that end with each last line, copies counted once, and
    whether they are many for the records of the sources where the line stands."""
    source = F.struct("record_type", "source").alias("of")
    sizes = cut_lineage(ends.select(source).groupBy("of").agg(F.count("*").alias("records")))
    same = unsure.select("line_key", "value").distinct().groupBy("line_key").agg(F.count("*").alias("same"))
    stands = sized_join(unsure.select(source, "line_key").distinct(), sizes, ["of"])
    over = stands.groupBy("line_key").agg(F.sum("records").alias("records"))
    recurs = (F.col("same") >= RECURRING) & (F.col("same") >= RECURRING_SHARE * F.col("records"))
    return same.join(over, "line_key").select("line_key", "same", recurs.alias("recurs"))


def begun_lines(unsure: DataFrame, recurring: DataFrame) -> DataFrame:
    """(line_key, longer): the beginnings of recurring lines, with the values of the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = pa.array(prefix_hashes(text)[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([same] * len(keys), pa.int64())], ["line_key", "same"])

    texts = sized_join(unsure.select("line_key", "line"), recurring, ["line_key"]).groupBy("line_key").agg(
        F.max("line").alias("line"), F.max("same").alias("same")
    )
    begun = texts.select("line", "same").mapInArrow(run, "line_key bigint, same bigint")
    return begun.groupBy("line_key").agg(F.max("same").alias("longer"))


def forms_of_sentences(ends: DataFrame, wanted: DataFrame) -> DataFrame:
    """(form, complete, begun) for the forms of ``wanted``: how many finished sentences have the form, and how many
    begin with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for skeleton, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chain = chained(skeleton)
                whole = [0] * (len(chain) - 1) + [count]
                if skeleton.startswith("#"):  # the name of a field begins nothing
                    chain, whole = chain[-1:], [count]
                begun = [count - n for n in whole]
                columns = [pa.array(c, pa.int64()) for c in (chain, whole, begun)]
                yield pa.RecordBatch.from_arrays(columns, ["form", "complete", "begun"])

    finished = _exploded(ends, "finished", "skeleton").groupBy("skeleton").agg(F.count("*").alias("complete"))
    parts = finished.mapInArrow(run, "form bigint, complete bigint, begun bigint")
    return sized_join(parts, wanted, ["form"], "left_semi").groupBy("form").agg(
        F.sum("complete").alias("complete"), F.sum("begun").alias("begun")
    )


def judged(records: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(record_type, record_id, source, cut, at_limit) of every value that is not template residue."""
    ends = cut_lineage(endings(records, function_words))
    by_source = limits(ends).groupBy("record_type", "source").agg(
        F.collect_set(F.struct("encoding", "length")).alias("limits")  # a few lengths for each encoding
    )
    named = ends.where("state IN ('open', 'dots', 'field')").drop("finished", "final_words")
    unsure = sized_join(named, cut_lineage(by_source), ["record_type", "source"], "left").select(
        "record_type", "record_id", "source", "state", "tokens", "form", "parent", "last_word", "opener", "line", "line_key", "value",
        F.coalesce(F.arrays_overlap("limits", _lengths_of()), F.lit(False)).alias("at_limit"),
    )
    unsure = cut_lineage(unsure)

    # What finished endings look like.
    words = _exploded(ends, "final_words", "last_word").groupBy("last_word").agg(F.count("*").alias("seen"))
    lines = cut_lineage(recurring_lines(ends, unsure.where("line IS NOT NULL")))
    longer = begun_lines(unsure.where("line IS NOT NULL"), cut_lineage(lines.where("recurs").select("line_key", "same")))
    asked = unsure.groupBy("form").agg(F.max("parent").alias("parent"), F.max("tokens").alias("tokens"))
    both = unsure.select(F.explode(F.array_compact(F.array("form", "parent"))).alias("form")).distinct()
    known = cut_lineage(forms_of_sentences(ends, cut_lineage(both)))
    open_forms = unsure.where("state = 'open'").select("form", "value").distinct().groupBy("form").agg(F.count("*").alias("unfinished"))
    parents = known.select(F.col("form").alias("parent"), F.col("begun").alias("parent_begun"))
    form = cut_lineage(
        asked.join(known, "form", "left").join(open_forms, "form", "left").join(parents, "parent", "left").drop("parent").na.fill(0)
    )
    usual = form.where("begun > 0 AND complete = 0 AND tokens >= 3").agg(
        (F.sum("unfinished") / F.sum("begun")).alias("share")
    ).collect()[0]["share"] or 0.0
    first = unsure.where("state = 'open'").select("opener", "value").distinct().groupBy("opener").agg(F.count("*").alias("opens"))
    first = cut_lineage(
        first.join(words.withColumnsRenamed({"last_word": "opener", "seen": "opened"}), "opener", "left").na.fill(0)
    )
    ends_with = cut_lineage(unsure.select("last_word").distinct().join(words, "last_word", "left").na.fill(0))
    line = cut_lineage(lines.join(longer, "line_key", "left").na.fill(0))
    joined = unsure
    for small, name in ((form.drop("tokens"), "form"), (ends_with, "last_word"), (first, "opener"), (line, "line_key")):
        joined = sized_join(joined, small, [name], "left")
    return ends.where("state IN ('whole', 'cut')").select(
        "record_type", "record_id", "source", (F.col("state") == "cut").alias("cut"), F.lit(False).alias("at_limit")
    ).unionAll(joined.select("record_type", "record_id", "source", unfinished(usual).alias("cut"), "at_limit"))


def unfinished(usual: float) -> Column:
    """Whether an open ending is a cut, from what is known of its length, line, form and last word."""
    same, longer = F.coalesce("same", F.lit(0)), F.coalesce("longer", F.lit(0))
    complete, seen = F.coalesce("complete", F.lit(0)), F.coalesce("seen", F.lit(0))
    # A form that begins no sentence may begin one and break off inside its last word.
    begun = F.greatest(F.coalesce("begun", F.lit(0)), F.coalesce("parent_begun", F.lit(0)))
    opens, opened = F.coalesce("opens", F.lit(0)), F.coalesce("opened", F.lit(0))
    # A word alone may itself be broken off; with one after it, it is whole.
    several = F.col("tokens") > 1
    no_sentence = several & (opens > F.lit(UNUSUAL_OPENER) * opened + F.lit(UNUSUAL_LEAST))
    own_form = no_sentence | (F.col("unfinished") > F.lit(UNUSUAL * usual) * begun + F.lit(UNUSUAL_LEAST))
    sentence = (
        F.when((complete > 0) & (seen > 0), F.col("at_limit") & ~own_form)
        .when((complete > 0) & ~own_form, True)
        .when(begun > 0, ~own_form)
        .otherwise(F.col("at_limit") & (F.col("unfinished") < UNUSUAL_LEAST))
    )
    field = (complete == 0) | (F.col("at_limit") & (seen == 0))
    return (
        F.when(F.col("state") == "field", field)
        .when(F.col("state") == "dots", F.col("at_limit") | (complete == 0) | (seen == 0))
        .when((longer > 0) & (longer >= BEGUN * same), True)
        .when(F.coalesce("recurs", F.lit(False)), False)
        .when(~several, True)  # a lone word that is no line of its own
        .otherwise(sentence)
    )


def find(records: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(record_type, record_id) of the values whose own end is missing."""
    return judged(records, function_words).where("cut").select("record_type", "record_id").distinct()


def rates(records: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(record_type, source, records, cut_records, cut_share) of each source."""
    return judged(records, function_words).groupBy("record_type", "source").agg(
        F.count("*").alias("records"),
        F.count_if("cut").alias("cut_records"),
        (F.count_if("cut") / F.count("*")).alias("cut_share"),
    )


def limits_of_sources(records: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(record_type, source, encoding, length, records, around): the hidden limits by the name of the encoding."""
    found = limits(cut_lineage(endings(records, function_words)))
    name = F.element_at(F.array(*map(F.lit, ENCODINGS)), F.col("encoding") + 1)
    return found.select("record_type", "source", name.alias("encoding"), "length", "records", "around")
