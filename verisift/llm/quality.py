"""Problem 8: per-document text quality statistics.

Method: word, symbol, line-end and common-word statistics, by themselves as native expressions; repetition
statistics on top (shares of duplicate lines and paragraphs, share of characters under the dominant run of 2 to 10 words;
sentences that are mostly repetition are boilerplate); and combined rules that tell lines of running sentences
from items of lists, rows of tables and junk. A document is not prose when more than half of its characters
belong to such lines.

Each document is measured alone; there is no shuffle and nothing is sent anywhere. Only what looks at lines
and their neighbours, or at repetition, runs in Python, over Arrow batches. Work is linear in the length of a
text.

Defined results for odd input: a null text has null statistics and kind ``empty``; an empty or blank
text has zeros and kind ``empty``; every row is measured, copies included; extra columns pass through
:func:`measure` unless named like a statistic, which then replaces them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.text import WHITESPACE, not_blank

#: Signs taken off the ends of a word before it is compared.
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡·•"
#: Statistics of words, signs and ends of lines, and those of lines and repetition.
PLAIN = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
JUDGED = ("duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share", "top_run_share", "prose_share", "kind")
STATISTICS = (*PLAIN, *JUDGED)
KINDS = dict.fromkeys(STATISTICS, "double") | {"word_count": "bigint", "kind": "string"}

_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Characters at which Python splits words, but these statistics do not.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_END = re.compile(r"[.!?…][\"'“”‘’»)\]]*$")
_ITEM = re.compile(r"^\s*(?:[-–—*•·+>]|\[[ xX]?\]|[(#]?\d{1,4}[.):\]]?|[a-zA-Z][.)])\s+\S")
_PAIR = re.compile(r"^\s*[^\W\d_][\w /'’-]{0,30}\s*[:=]\s*\S")
_ROW = re.compile(r"\t|\|.*\||(?:[^;]*;){2,}[^;]*$|\.{4,}|(?: [·>/|»] ).*(?: [·>/|»] )")
_GAPS = re.compile(r"\S {2,}\S")
_ADDRESS = re.compile(r"https?://|www\.")
_CLEAN = re.compile(r"[^\W_]+(?:['’.,:/&+°-]*[^\W_]+)*[%°²³‰]?")
_NO_LETTER = re.compile(r"[\W\d_]+")
_NAMES = re.compile(r"^[^,]{1,40}(?:, [^,]{1,40}){4,}$")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def line_is_prose(line: str, words: list[str], common: int) -> bool | None:
    """Whether a line is running text; None where it is too short to tell from its neighbours.

    ``words`` are the line's words without signs at their ends (some may be empty), ``common`` the
    number of them that are frequent words of one language.
    """
    n = len(words)
    least = 0.55 * len("".join(line.split()))
    if len("".join(filter(str.isalpha, words))) < least and len(_NO_LETTER.sub("", line)) < least:
        return False
    if n >= 4:
        odd = [w for w in words if not w.isalnum()]
        if len(odd) > 0.12 * n + 0.5 and sum(1 for w in odd if not _CLEAN.fullmatch(w)) > 0.12 * n + 0.5:
            return False
    ended = bool(_END.search(line.rstrip()))
    if not (ended and common >= 0.15 * n and n >= 8) and _ROW.search(line.strip()):
        return False
    if common < max(0.1 * n, 1) and _GAPS.search(line.strip()):
        return False
    if n < 12:
        if n < 6 and _ADDRESS.search(line):
            return False
        if not ended and (_ITEM.match(line) or _PAIR.match(line)):
            return False
    if n >= 8:
        return common >= 0.09 * n
    if n >= 5:
        return common >= 1 if ended else (True if common >= 2 else None)
    return True if ended and n >= 3 and common >= 1 else None


def prose_characters(lines: list[str], marks: list[bool | None]) -> int:
    """Characters of the lines that are running text. A line that is too short to tell follows the line
    before it where it can be the rest of its sentence, else it is a heading, item or remainder."""
    total, before = 0, False
    for line, mark in zip(lines, marks, strict=True):
        if mark is None:
            mark = before and not _ITEM.match(line) and not _PAIR.match(line)
        before = mark and not _END.search(line.rstrip())
        if mark:
            total += len(line)
    return total


def top_bigram(pairs: Counter, chars: int) -> float:
    """Share of the text's characters under its most frequent repeated pair of words."""
    count = max(pairs.values(), default=0)
    if count < 2:
        return 0.0
    longest = max(len(a) + len(b) for (a, b), c in pairs.items() if c == count)
    return min(1.0, count * longest / chars)


def covered(words: list[str], pairs: Counter, chars: int) -> float:
    """Largest share of the text's characters under the places of its most frequent run of 2 to 10 words."""
    best, counts = 0.0, pairs
    for n in range(2, 11):
        runs = list(zip(*(words[i:] for i in range(n)), strict=False))
        counts = counts if n == 2 else Counter(runs)
        top = max(counts.values(), default=0)
        if top < 2:
            break  # longer runs are no more frequent
        run = max((r for r, c in counts.items() if c == top), key=lambda r: sum(map(len, r)))
        if top * sum(map(len, run)) / chars <= best:
            continue  # at most that much is under it
        marked, end = 0, 0
        for at, here in enumerate(runs):
            if here == run:
                marked += sum(map(len, words[max(at, end) : at + n]))
                end = at + n
        best = max(best, marked / chars)
    return best


def _looked_at(text: str, common: dict[str, int], languages: int) -> tuple[list[str], list[str], list[bool | None], Counter]:
    """(lines, words, marks, hits): the lines that are not blank, all words without signs at their ends, whether each
    line is running text, and the number of frequent words for each set of languages."""
    plain = not _OTHER_SPACE.search(text)
    lines = [x for x in text.split("\n") if x.strip()]
    words: list[str] = []
    marks, hits = [], Counter()
    for line in lines:
        low = line.lower()
        here = [w.strip(EDGE) for w in (low.split() if plain else filter(None, _SPACE.split(low)))]
        known = Counter(filter(None, map(common.get, here)))
        marks.append(line_is_prose(line, here, _most(known, languages)))
        hits += known
        words += here
    return lines, words, marks, hits


def _solid(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\r\f\v"))


def _judged(text: str, solid: int, lines: list[str], words: list[str], marks: list[bool | None]) -> tuple:
    chars = sum(map(len, lines))
    share = prose_characters(lines, marks) / chars
    repeats = Counter(lines)
    twice = sum((c - 1) * len(x) for x, c in repeats.items() if c > 1) / chars
    paragraphs = Counter(p for p in _PARAGRAPH.split(text) if p.strip())
    pairs = Counter(zip(words, words[1:], strict=False))
    top, run = top_bigram(pairs, solid), covered(words, pairs, solid)
    again = sum((c - 1) * len(x) for x, c in paragraphs.items() if c > 1) / len(text)
    repeated = top > 0.5 or twice > 0.6 or again > 0.6 or run > 0.5
    running, share = share >= 0.5, 0.0 if repeated else share
    return twice, again, top, run, share, "prose" if share >= 0.5 else "boilerplate" if running else _kind(lines, marks)


def judged_text(text: str | None, common: dict[str, int], languages: int) -> tuple:
    """The statistics of lines and repetition of one text, in the order of JUDGED.

    ``common`` gives for each frequent word the languages it belongs to, as bits.
    """
    if text is None:
        return (None,) * 5 + ("empty",)
    solid = _solid(text)
    lines, words, marks, _ = _looked_at(text, common, languages)
    return _judged(text, solid, lines, words, marks) if solid and lines else (0.0,) * 5 + ("empty",)


def measure_text(text: str | None, common: dict[str, int], languages: int) -> tuple:
    """All statistics of one text, in the order of STATISTICS."""
    if text is None:
        return (None,) * 10 + ("empty",)
    solid = _solid(text)
    lines, words, marks, hits = _looked_at(text, common, languages)
    if not solid or not lines:
        return (0, *(0.0,) * 9, "empty")
    return (
        len(words),
        solid / len(words),
        len(_SYMBOL.findall(text)) / len(text),
        sum(1 for x in lines if _END.search(x.rstrip())) / len(lines),
        _most(hits, languages) / len(words),
        *_judged(text, solid, lines, words, marks),
    )


def _most(counts: Counter, languages: int) -> int:
    """Number of the words that are frequent in one language, for the language with the most. ``counts``
    has the number of words for each set of languages."""
    if not counts:
        return 0
    return max(sum(c for b, c in counts.items() if b >> k & 1) for k in range(languages))


def _kind(lines: list[str], marks: list[bool | None]) -> str:
    """What the lines without running text mostly are."""
    rest = [x for x, mark in zip(lines, marks, strict=True) if not mark]
    chars = sum(map(len, rest))
    if sum(len(x) for x in rest if len(_SYMBOL.findall(x)) > 0.5 * len(x)) > 0.5 * chars:
        return "junk"
    if sum(len(x) for x in rest if _ROW.search(x.strip()) or _GAPS.search(x.strip())) > 0.5 * chars:
        return "table"
    items = sum(len(x) for x in rest if _ITEM.match(x) or _PAIR.match(x) or _ADDRESS.search(x) or _NAMES.match(x))
    return "list" if items > 0.5 * chars else "junk"


def common_bits(common_words: DataFrame) -> tuple[dict[str, int], int]:
    """The frequent words with the languages of each as bits, and the number of languages; a fixed
    small table (its size is checked)."""
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("the table of common words has more than 20,000 rows")
    langs = sorted({r["lang"] for r in rows})
    bits: dict[str, int] = {}
    for r in rows:
        word = r["word"].lower()
        bits[word] = bits.get(word, 0) | 1 << langs.index(r["lang"])
    return bits, len(langs)


#: White space between words here.
_BETWEEN = r" \t\n\r\f\x0B"


def statistics(df: DataFrame, text: str, common_words: DataFrame) -> DataFrame:
    """``df`` with the statistics of PLAIN as further columns, by native expressions. Null for null, 0 for blank."""
    bits, languages = common_bits(common_words)
    value, words, lines = F.col(text), F.col("_p8_words"), F.col("_p8_lines")
    # in columns of their own, to be computed once
    cut = df.withColumns(
        {
            "_p8_words": F.split(F.btrim(F.lower(value), F.lit(" \t\n\r\f\x0b")), rf"[{_BETWEEN}]+"),
            "_p8_lines": F.filter(F.split(value, "\n"), lambda x: x.rlike(rf"[^{WHITESPACE}]")),
        }
    )
    cut = cut.withColumn("_p8_bare", F.transform(words, lambda w: F.btrim(w, F.lit(EDGE))))
    ended = F.filter(lines, lambda x: x.rlike(_END.pattern.removesuffix("$") + rf"[{WHITESPACE}]*$"))
    lists = [[w for w, b in bits.items() if b >> k & 1] for k in range(languages)]
    known = [F.size(F.filter("_p8_bare", _in(own))) for own in lists]
    most = F.greatest(*known, F.lit(0)) if known else F.lit(0)
    empty = (F.size(lines) == 0) | (F.get(words, 0) == "")

    def share(part: Column, whole: Column) -> Column:
        return F.when(value.isNull(), None).when(empty, 0.0).otherwise(part / whole)

    solid = F.length(F.regexp_replace(value, rf"[{_BETWEEN}]+", ""))
    symbols = F.length(F.regexp_replace(value, r"[\p{L}\p{N}\p{Z}\s\x1c-\x1f\x{0085}]+", ""))
    count = F.when(value.isNull(), None).when(empty, 0).otherwise(F.size(words)).cast("bigint")
    made = (count, share(solid, F.size(words)), share(symbols, F.length(value)), share(F.size(ended), F.size(lines)), share(most, F.size(words)))
    return cut.withColumns(dict(zip(PLAIN, made, strict=True))).drop("_p8_words", "_p8_lines", "_p8_bare")


def _in(own: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(own)


def _measurer(names: tuple[str, ...], measurer: Callable, common: dict[str, int], languages: int) -> Callable:
    schema = ", ".join(f"{name} {KINDS[name]}" for name in names)

    @F.pandas_udf(T._parse_datatype_string(schema))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measurer(t if isinstance(t, str) else None, common, languages) for t in batch]
            frame = pd.DataFrame(rows, columns=list(names))
            if "word_count" in frame:
                frame["word_count"] = frame["word_count"].astype("Int64")
            yield frame

    return run


def _measured(df: DataFrame, text: str, common_words: DataFrame, names: tuple[str, ...], measurer: Callable) -> DataFrame:
    kept = [F.col(c) for c in df.columns if c not in names]
    run = _measurer(names, measurer, *common_bits(common_words))
    return df.select(*kept, run(F.col(text)).alias("_measured")).select(*kept, *[F.col("_measured").getField(s).alias(s) for s in names])


def judged(df: DataFrame, text: str, common_words: DataFrame) -> DataFrame:
    """``df`` with the statistics of JUDGED as further columns."""
    return _measured(df, text, common_words, JUDGED, judged_text)


def measure(df: DataFrame, text: str, common_words: DataFrame) -> DataFrame:
    """``df`` with all statistics of ``text`` as further columns, in the pass over lines and words that JUDGED takes:
    the native expressions beside it would cut the texts a second time."""
    return _measured(df, text, common_words, STATISTICS, measure_text)


def find(df: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """(key) of the documents that are mostly a list, a table, junk or repetition. Null and blank texts are none."""
    found = judged(df.select(key, text), text, common_words)
    return found.where("kind NOT IN ('prose', 'empty')").select(key).distinct()
