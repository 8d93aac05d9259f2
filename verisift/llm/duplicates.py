"""Problem 4: duplicates hidden by formatting differences.

Method: characters, case, white space, punctuation and the order of named fields are brought to one
form in the JVM; that form is hashed to 128 bits; and groups are counted with map-side combining, the
length and a CRC-32 of the form standing in the key as a check against collisions. For finding, no text is
shuffled, no group is collected: a group of copies, however large, is one row of partial sums on every
task, and its members find their group through a join that is broadcast or salted by counted size. Only
:func:`collapse` shuffles rows, by their ids, where the members of groups are too many to be broadcast.

Defined results for odd input: null, empty and blank texts belong to no group and are kept as they
are, one by one; a text of signs only is its own content; equal ids in several rows count as several
copies; extra columns pass through :func:`collapse` under whatever name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import not_blank
from verisift.operators.joins import sized_join
from verisift.session import cut_lineage

#: Signs that separate or enclose. Those with a meaning of their own (% & @ + $ and the like) are content.
PUNCTUATION = r"[[\p{P}|=<>~^`´¨¦*#]&&[^%&@‰‱§¶]]"
SPACE = r"[\s\x{0085}\p{Z}\x{001c}-\x{001f}]"
#: A name of a field: some words before a colon or an equals sign.
PAIR = rf"(?s)^{SPACE}*[^:=]*[\p{{L}}\p{{N}}][^:=]{{0,60}}[:=].*[\p{{L}}\p{{N}}].*$"
#: A part that holds two names, or ends as a sentence: then the text is not a list but running text.
TWO_PAIRS = rf"(?s)[:=]{SPACE}.*[^:={SPACE[1:-1]}]{SPACE}*[:=]{SPACE}"
SENTENCE = rf"[.!?]['\"”»)]*{SPACE}*$"
#: What may stand between the fields of a list: one sign, or the ends of sentences of one field each.
SEPARATORS = (";", r"\|", r"\n", rf",(?={SPACE})", rf"[.;|…]+[,.;|…]*{SPACE}+|{SPACE}[-–—|]{SPACE}")


def _letters(text: Column) -> Column:
    """Lower-case text without white space and punctuation; a sign between two digits stays, and so
    does the gap between two numbers."""
    bare = F.regexp_replace(text, rf"(?<![0-9]){PUNCTUATION}+|{PUNCTUATION}+(?![0-9])|{PUNCTUATION}{{2,}}", " ")
    closed = F.regexp_replace(bare, rf"(?<=[0-9]){SPACE}+(?=[0-9])", "\u0001")
    low = F.lower(F.translate(F.regexp_replace(closed, rf"{SPACE}+", ""), "\u0001", " "))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ς", "σ")  # as capitals have them


def _fields(pairs: Column) -> Column:
    """Sorted fields of an array of (name, value) as one text."""
    named = F.transform(pairs, lambda p: F.concat(_letters(p["key"]), F.lit("\u0002"), _letters(p["value"])))
    return F.array_join(F.array_sort(named), "\u0003")


def _object_fields(text: Column) -> Column:
    """The (key, value) fields of a text that is a JSON object, else null. Objects within it have their fields in
    order and in lower case; the numbers of such a text become texts, as they are compared by their digits."""
    whole = F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text)
    nested = F.when(whole.rlike(r"[:\[,]\s*[\[{]"), whole)
    quoted = F.regexp_replace(nested, r"(?<=[:\[,\s])(-?[0-9][0-9.eE+-]*)(?=\s*[,\]}])", r'"$1"')
    read = lambda t: F.from_json(t, "map<string,string>", {"allowSingleQuotes": "false"})
    fields = F.map_entries(F.coalesce(read(quoted), read(whole)))
    inner = lambda v: F.to_json(F.try_parse_json(F.when(v.rlike(r"^[\[{]"), F.lower(v))))
    return F.transform(fields, lambda p: F.struct(p["key"].alias("key"), F.coalesce(inner(p["value"]), p["value"]).alias("value")))


def _list_pairs(text: Column) -> Column:
    """The (name, value) pairs of a text that is a list of such pairs, else null. Of the separators
    that cut the whole text into pairs, the one that gives the most is taken."""
    best = F.lit(None)
    tries = []
    for rank, separator in enumerate(SEPARATORS):
        parts = F.filter(F.split(text, separator), lambda p: p.rlike(r"[\p{L}\p{N}]"))
        whole = (
            (F.size(parts) >= 2)
            & F.forall(parts, lambda p: p.rlike(PAIR) & ~p.rlike(TWO_PAIRS))
            & ~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: p.rlike(SENTENCE))
        )
        tries.append(F.when(whole, F.struct(F.size(parts).alias("n"), F.lit(-rank).alias("rank"), parts.alias("parts"))))
    best = F.greatest(*tries)
    return F.transform(
        best["parts"],
        lambda p: F.struct(
            F.regexp_extract(p, r"(?s)^([^:=]*)[:=]", 1).alias("key"),
            F.regexp_extract(p, r"(?s)^[^:=]*[:=](.*)$", 1).alias("value"),
        ),
    )


def content(text: Column) -> Column:
    """One form of all texts that differ only in white space, case, punctuation or the order of named
    fields. JSON objects, lists of fields and running text never have the same form."""
    as_json = _object_fields(text)
    as_list = F.when(text.rlike(rf"(?s)^[^:=]{{1,80}}[:=].*[:=]"), _list_pairs(text))
    return F.coalesce(
        F.when(F.size(as_json) > 0, F.concat(F.lit("\u0004"), _fields(as_json))),
        F.when(F.size(as_list) > 0, F.concat(F.lit("\u0005"), _fields(as_list))),
        F.nullif(_letters(text), F.lit("")),
        F.regexp_replace(text, rf"{SPACE}+", ""),
    )


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, high, low, check) of every non-blank text: 128 bits of hash and a check of its form."""
    form = df.where(not_blank(F.col(text))).select(F.col(key).alias("id"), content(F.col(text)).alias("form"))
    return form.select(
        "id",
        F.xxhash64("form").alias("high"),
        F.xxhash64(F.lit(0x9E3779B9), "form").alias("low"),
        (F.length("form").cast("long") * F.lit(1 << 32) + F.crc32(F.col("form").cast("binary"))).alias("check"),
    )


GROUP = ["high", "low", "check"]


def groups(marks: DataFrame) -> DataFrame:
    """(high, low, check, keep_id, copies) of the contents that occur more than once."""
    return (
        marks.groupBy(*GROUP).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    )


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """(keep_id, copy_id): every member of a group of the same content but the smallest id, with that."""
    marks = cut_lineage(hashed(df, key, text))
    found = cut_lineage(groups(marks))
    return (
        sized_join(marks, found, GROUP)
        .where("id <> keep_id")
        .select("keep_id", F.col("id").alias("copy_id"))
        .distinct()
    )


def collapse(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row for each content, the one of the smallest id, and the number of its copies in
    a column ``copies`` (an existing column of that name is replaced). Rows of one id must be copies."""
    marks = cut_lineage(hashed(df, key, text))
    found = cut_lineage(groups(marks))
    members = sized_join(marks, found, GROUP).groupBy("id").agg(
        F.min("keep_id").alias("keep_id"), F.min("copies").alias("copies")
    )
    rows = df.select(F.col(key).alias("id"), F.struct(*[df[c] for c in df.columns if c != "copies"]).alias("row"))
    kept = sized_join(rows, cut_lineage(members), ["id"], "left").where("keep_id IS NULL OR id = keep_id")
    return kept.select("row.*", F.coalesce("copies", F.lit(1)).alias("copies"))
