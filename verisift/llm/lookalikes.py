"""Problem 1: text that looks the same but is spelled with other characters.

Method: the pieces (words, signs, spaces) of all values that hold a suspect character are mapped to
what they look like; the mapped pieces are grouped in SQL under an accent-sensitive Unicode
collation, which also makes compositions of one accent equal; every class gets one deterministic
canonical member; and that member is joined back to the pieces of the values.

Only values with a suspect character (a regular expression in the JVM) take part in any shuffle.

Defined results for odd input: null values stay null and are never cases; an empty value stays empty;
repeated rows give repeated results in :func:`normalize` and one row in :func:`find`; extra columns of
``normalize`` pass through under whatever name, as working columns live in a struct of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.operators.joins import fits_broadcast, sized_join
from verisift.session import cut_lineage

# Invisible characters (soft hyphen, joiners, directional marks, fillers, tags).
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
    r"\x{E0000}-\x{E0FFF}"
)
#: Characters that render as the ordinary space.
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}"
#: Characters that render as the ordinary hyphen; the minus does between letters.
HYPHENS, MINUS = r"\x{2010}\x{2011}", r"\x{2212}"
#: Full-width, half-width and small signs, ligatures, Kelvin and Angstrom sign, Roman numerals, mathematical
#: letters and digits.
STYLED = (
    r"\x{FF01}-\x{FF9F}\x{FFA1}-\x{FFDC}\x{FFE0}-\x{FFE6}\x{FE50}-\x{FE6B}\x{FB00}-\x{FB06}\x{212A}\x{212B}"
    r"\x{2160}-\x{217F}\x{1D400}-\x{1D7FF}"
)
#: Styled letters in a word of several letters: the mathematical ones that Unicode has elsewhere, and letters in
#: circles. Alone they are signs.
STYLED_IN_WORDS = (
    r"\x{2102}\x{210A}-\x{210E}\x{2110}-\x{2112}\x{2115}\x{2119}-\x{211D}\x{2124}\x{2128}\x{212C}\x{212D}"
    r"\x{212F}-\x{2131}\x{2133}\x{2134}\x{2145}-\x{2149}\x{24B6}-\x{24E9}"
)
#: Combining accents.
MARKS = r"\x{0300}-\x{034E}\x{0350}-\x{036F}"
#: Scripts with letters that can pass for Latin ones.
FOREIGN = (
    r"\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{0530}-\x{058F}\x{13A0}-\x{13FF}\x{1F00}-\x{1FFF}\x{2C80}-\x{2CFF}\x{A4D0}-\x{A4FF}"
)
#: Latin letters with the glyph of another one.
TWINS = r"\x{0251}\x{0261}\x{1D04}\x{1D0F}\x{1D20}-\x{1D22}\x{A731}"
SUSPECT_RANGES = f"{INVISIBLE}{SPACES}{HYPHENS}{MINUS}{STYLED}{STYLED_IN_WORDS}{MARKS}{FOREIGN}{TWINS}"
#: The first part lets go of ordinary Latin characters after a look at three ranges instead of fifty.
SUSPECT = rf"[[^\x00-\x{{009F}}\x{{00A1}}-\x{{00AC}}\x{{00AE}}-\x{{0250}}]&&[{SUSPECT_RANGES}]]"

# Letters of other scripts with the glyph of a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԁԛԝүҽӏ", "ABESIJKMHOPCTYXYGQWIaesijopcyxhdqwyel", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲν", "ABEZHIKMNOPTYXCjocv", strict=True))
ARMENIAN = dict(zip("ՕՍՏԼոսհցօյզ", "OUSLnuhgojq", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏞᏟᏢᏦᏴᏙᎩ", "DRTiAJEWMHGZRWSLCPKBVy", strict=True))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
#: Looks like a Latin letter only among Latin letters.
AMONG_LATIN = dict(zip("αικρυвкмнтг", "aikpuBKMHTr", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU
#: Latin letters inside a word of another script.
TO_CYRILLIC = {b: a for a, b in CYRILLIC.items()}
TO_GREEK = {b: a for a, b in GREEK.items()}
#: Latin letters that pass for others in a word of ASCII letters.
TWIN = dict(zip("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs", strict=True))

_CONFUSED = {
    "Cyrillic": "".join(CYRILLIC),
    "Greek": "".join(GREEK),
    "Armenian": "".join(ARMENIAN),
    "Cherokee": "".join(CHEROKEE),
    "Coptic": "".join(COPTIC),
    "Lisu": "".join(LISU),
}


def _own_use(script: str) -> str:
    """A run of words wholly in one script, at least one with a letter that no Latin letter looks like."""
    letter = rf"\p{{Is{script}}}"
    distinct = rf"[\p{{L}}&&{letter}&&[^{_CONFUSED[script]}]]"
    between = r"[ \t\r\n\p{P}]++"
    word = rf"{letter}++"
    one = rf"(?={letter}*{distinct}){word}"
    return rf"(?:{word}{between})*?{one}(?:{between}{word})*+"


_WORD = rf"\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}{HYPHENS}{MINUS}{STYLED}{STYLED_IN_WORDS}'’-"
_EDGE_BEFORE, _EDGE_AFTER = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}])", rf"(?![\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}])"
_EMOJI = r"[\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
_EMOJI_RUN = (
    rf"(?:[0-9#*]\x{{FE0F}}?\x{{20E3}}"
    rf"|{_EMOJI}(?:[\x{{FE0E}}\x{{FE0F}}\x{{20E3}}]|[\x{{E0020}}-\x{{E007F}}]|\x{{200D}}{_EMOJI}|{_EMOJI})*+)"
)
OWN_USE = rf"{_EDGE_BEFORE}(?:{'|'.join(_own_use(s) for s in _CONFUSED)}){_EDGE_AFTER}"
#: Cuts a value into pieces that together are the value: runs in a script's own use, emoji, words, the rest.
PIECE = rf"{OWN_USE}|{_EMOJI_RUN}|[{_WORD}]++|[^{_WORD}]"
#: A piece that needs no mapping whatever it holds.
PLAIN = rf"^(?:{OWN_USE}|{_EMOJI_RUN})$"

_PY = lambda spec: re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", spec) + "]")
_INVISIBLE, _SPACES, _HYPHENS, _STYLED = _PY(INVISIBLE), _PY(SPACES), _PY(HYPHENS), _PY(STYLED)
_STYLED_IN_WORDS, _FOREIGN = _PY(STYLED_IN_WORDS), _PY(FOREIGN)
_JOINING = re.compile("[\u0600-\u07ff\u0900-\u0dff\u1000-\u109f]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")


@lru_cache(maxsize=65536)
def looks_like(piece: str) -> str:
    """What a piece looks like, in ordinary characters and composed accents.

    Invisible characters go (joiners stay between letters of scripts that need them), look-alike
    spaces, hyphens, ligatures and full-width forms become the ordinary ones, look-alike letters
    become Latin, or the script's own in a word that has letters only this script has.
    """
    out = []
    several = sum(1 for ch in piece if ch.isalpha() or _STYLED_IN_WORDS.match(ch)) > 1
    for i, ch in enumerate(piece):
        if _INVISIBLE.match(ch):
            if ch in "\u200c\u200d" and 0 < i < len(piece) - 1 and _JOINING.match(piece[i - 1]):
                out.append(ch)
        elif _SPACES.match(ch):
            out.append(" ")
        elif _HYPHENS.match(ch):
            out.append("-")
        elif ch == "\u2212":
            out.append("-" if piece[i - 1 : i].isalpha() and piece[i + 1 : i + 2].isalpha() else ch)
        elif _STYLED.match(ch) or (several and _STYLED_IN_WORDS.match(ch)):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    words = re.split(r"([ -])", unicodedata.normalize("NFC", "".join(out)))
    return "".join(map(_one_script, words))


def _one_script(word: str) -> str:
    foreign = _FOREIGN.findall(word)
    if not foreign:
        plain = all(ch.isascii() or ch in TWIN for ch in word if ch.isalpha())
        return "".join(TWIN.get(ch, ch) for ch in word) if plain else word
    latin = [ch for ch in word if _LATIN.match(ch)]
    if all(ch in LOOKALIKE or (latin and ch in AMONG_LATIN) for ch in foreign):
        return "".join(LOOKALIKE.get(ch) or (AMONG_LATIN.get(ch) if latin else None) or ch for ch in word)
    back = TO_GREEK if "\u0370" <= foreign[0] <= "\u03ff" else TO_CYRILLIC
    if latin and len(latin) < len(foreign) and all(ch in back for ch in latin):
        return "".join(back.get(ch, ch) for ch in word)
    return "".join(LOOKALIKE.get(ch, ch) for ch in word) if len(latin) > len(foreign) else word


@F.pandas_udf(T.StringType())
def _mapped(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pieces:
        yield batch.map(looks_like)


def _pieces(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(PIECE), F.lit(0))


def suspect_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, value) of every value with a suspect character."""
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    suspect = F.filter(values, lambda v: F.coalesce(v["value"].rlike(SUSPECT), F.lit(False)))
    return df.select(F.col(key).alias("key"), F.explode(suspect).alias("v")).select("key", "v.field_name", "v.value")


def canonical_members(pieces: DataFrame) -> DataFrame:
    """(piece, canonical) for each suspect piece of ``pieces`` (a column ``piece``) that has another form.

    Plain pieces of the same values are members of the classes, too: where a class has one, it is the
    canonical member; else the member with the fewest mapped characters gives it, most frequent first,
    in its mapped form. Ties go to the smallest string, so any order of rows gives the same result.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("piece").agg(F.count("*").alias("copies"))
    mapped = counted.withColumn("suspect", F.col("piece").rlike(SUSPECT) & ~F.col("piece").rlike(PLAIN)).withColumn(
        "mapped", F.when(F.col("suspect"), _mapped("piece")).otherwise(F.col("piece"))
    )
    mapped = cut_lineage(mapped)
    return spark.sql(
        """
        SELECT m.piece, c.canonical
        FROM {mapped} m
        JOIN (
            SELECT class, min_by(mapped, rank) AS canonical FROM (
                SELECT collate(mapped, 'UNICODE') AS class, mapped,
                       struct(suspect AND piece <> mapped AS changed, -copies AS copies,
                              abs(length(piece) - length(mapped)) AS changes, mapped, piece) AS rank
                FROM {mapped})
            GROUP BY class
        ) c ON collate(m.mapped, 'UNICODE') = c.class
        WHERE m.suspect AND m.piece <> c.canonical
        """,
        mapped=mapped,
    )


def find(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name) of the values that hold a character which is invisible or passes for another.

    Null and empty values are no cases. Copies of a row give one row.
    """
    pieces = cut_lineage(
        suspect_values(df, key, fields).select(
            "key", "field_name", F.explode(F.array_distinct(_pieces(F.col("value")))).alias("piece")
        )
    )
    suspect = pieces.where(F.col("piece").rlike(SUSPECT))
    other = sized_join(suspect, cut_lineage(canonical_members(pieces)), ["piece"], "left_semi")
    return other.select(F.col("key").alias(key), "field_name").distinct()


def normalize(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with every value of ``fields`` in its one consistent form; all other columns unchanged.

    Rows without a suspect character pass by; the values of the others are cut into pieces, which get
    the canonical member of their class and are put together again in their order, value by value.
    """
    row = F.struct(*[df[c] for c in df.columns])
    suspects = [F.when(df[f].rlike(SUSPECT), df[f]) for f in fields]
    values = cut_lineage(df.select(F.explode(F.array_compact(F.array(*suspects))).alias("value")))
    exploded = values.select(*_value_hash(F.col("value")), F.posexplode(_pieces(F.col("value"))).alias("pos", "piece"))
    forms = cut_lineage(canonical_members(exploded.select("piece")))
    changed = sized_join(exploded.where(F.col("piece").rlike(SUSPECT)), forms, ["piece"])
    changes = cut_lineage(  # by value: the pieces that change, in sets, as values recur
        changed.groupBy("high", "low")
        .agg(F.collect_set(F.struct("pos", "canonical")).alias("changes"))
        .select("high", "low", F.map_from_entries("changes").alias("changes"))
    )
    # Where the changes are broadcast, all rows pass by them; else only rows that may change are shuffled.
    suspect = F.exists(F.array(*suspects), lambda v: v.isNotNull())
    one_pass = fits_broadcast(changes)
    rewritten = (df if one_pass else df.where(suspect)).select(row.alias("row"))
    for field in fields:
        value = F.col("row").getField(field)
        marked = rewritten.select("row", *_value_hash(F.when(value.rlike(SUSPECT), value)))
        put = F.array_join(
            F.transform(_pieces(value), lambda p, i: F.coalesce(F.try_element_at("changes", i), p)), ""
        )
        form = F.when(F.col("changes").isNotNull(), put).otherwise(value)
        rewritten = sized_join(marked, changes, ["high", "low"], "left").select(F.col("row").withField(field, form).alias("row"))
    if not one_pass:
        rewritten = df.where(~suspect).select(row.alias("row")).unionAll(rewritten)
    return rewritten.select("row.*")


def _value_hash(value: Column) -> tuple[Column, Column]:
    """128 bits that stand for a value in joins; null for null."""
    high = F.when(value.isNotNull(), F.xxhash64(value)).alias("high")
    return high, F.when(value.isNotNull(), F.xxhash64(F.lit(0x9E3779B9), value)).alias("low")
