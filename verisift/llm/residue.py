"""Problem 3: template residue and error-page text.

Method: each record is scored by several signs together. Detectors look for unfilled placeholders, filler
and for messages (errors, notices about scripts, announcements of content) at the beginnings of lines and
sentences. What is left of the body beside such messages is compared with the terms of address slug and
title, and its information is measured by its distinct terms. Bodies and messages are reduced to templates
(numbers, codes and paths masked) that are counted over all hosts: one response served for many addresses,
or one message in many different texts, is evidence against each of its records. A record is residue from
POINTS points on: a mark or a run of filler has all of them; a message has two, a body without a term of slug
and title one, one of little information one, a template that many hosts repeat two. So a sentence of an
ordinary text that begins like a message is none, and an unknown response is found without a detector.

Records are looked at one by one in Arrow batches; only hashes of templates are shuffled, combined on the
map side.

Defined results for odd input: null, empty and blank texts are no cases and are kept; null addresses and
titles give no terms and so count as matching nothing; equal ids are judged row by row and reported
once; extra columns pass through :func:`keep_content` under whatever name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import not_blank
from verisift.operators.joins import sized_join
from verisift.session import cut_lineage

#: Points from which a record is residue, and what each sign gives.
POINTS, MESSAGE, MISMATCH, LOW, REPEATED = 4, 2, 1, 1, 2
#: Distinct terms of a body of little information at most, whatever its length, and at least.
LOW_TERMS, FEWEST_TERMS = 40, 3
#: A template with request codes, paths or long numbers is repeated when it stands at so many different
#: addresses and at so many sources; a message when it stands in so many different values.
MIN_ADDRESSES, MIN_SOURCES = 5, 2
#: One without them may be a text that is copied: it must stand at so many sources, and nearly never where slug
#: or title have one of its terms.
PLAIN_SOURCES, PLAIN_MISMATCH = 25, 0.95

_NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,40}"
#: Marks of template languages around a name.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}?\s*\}}?\}}\}}|\$\{{\s*{_NAME}\}}|#\{{\s*{_NAME}\}}|\$\$\s?{_NAME}\$\$|@@\s?{_NAME}@@"
    rf"|%\({_NAME}\)[sd]|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}|\[\[\s*{_NAME}\]\]|<<\s*{_NAME}>>"
    r"|(?<![\w%])%[sd](?!\w)|(?<![\w%])%[A-Za-z][\w.]{2,40}%|__[A-Za-z][A-Za-z_]*__|(?<!\w)\{\d\}|\{[a-z]\w*[_.]\w+\}"
    r"|&(?!(?:amp|lt|gt|quot|apos|nbsp|copy|reg|trade|euro|shy|[a-z]+(?:acute|grave|uml|circ|tilde|cedil|slash|ring|lig)"
    r"|[lr][ad]?quo|[lr]squo|[nm]dash|hellip|deg|sup[123]|frac\d+|times|middot|bull|para|sect|szlig|laquo|raquo|thinsp|ensp|emsp)\b)"
    r"[a-z][a-z_]{3,40};"
)
#: The same with single signs, which have other uses: {name}, <name>, [NAME], (add name).
WEAK_PLACEHOLDER = re.compile(
    r"\{[a-z][a-z ]{2,30}\}|<(?:[a-z]+[_.][a-z_.]+|[a-z][a-z ]{2,40} (?i:TBC|TBD|TBA)|[a-z]{4,20})>"
    r"|\[(?:your|insert|add|enter|todo|tbc|tbd)\b[^\[\]\n]{0,60}\]|\((?:add|insert|enter|your|todo)(?: [a-z_]+){1,3}\)"
    r"|\[[A-Za-z]+(?:_[A-Za-z]+)+\]|\[[A-Z]{3,20}\]|\b(?:TBC|TBD)>|\bTBC\b(?=>)",
    re.IGNORECASE,
)
#: Elements of markup and bracketed words that are no placeholders.
_MARKUP = frozenset(
    "abbr address article aside audio blockquote body button canvas caption cite code data details div dialog embed "
    "figure footer form frame head header hgroup html iframe image input label legend link main mark menu meta meter "
    "nav noscript object option output param picture progress quote ruby samp script section select slot small span "
    "strong style summary table tbody template textarea tfoot thead time title track video".split()
)
_BRACKETED = frozenset("sic edit citation note notes applause laughter laughs music video photo image link ed".split())
#: Words after which a mark is spoken of, not left over.
_SPOKEN_OF = re.compile(
    r"(?:such as|like|marked|called|named|written|typed|symbol|tag|token|marker|variable|placeholder|syntax|the set|comme"
    r"|balise|wie|como|etiqueta|marcador)(?: as)?[\s\"“”'‘’«»`(]*$",
    re.IGNORECASE,
)

# The words of the customary filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et "
    "dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
KEYBOARD = frozenset("qwerty qwertz azerty asdf asdfg asdfgh zxcv foo bar baz qux xx xxx xxxx test testing bla blah blub lipsum abc lorem ipsum".split())
#: Filler words in a row from which a text is filler.
FILLER_RUN = 5
_WORD = re.compile(r"[^\W\d_]+")

# The phrases are looked for in text in lower case.
#: Where a phrase that stands as content begins. What it ends with is no letter or digit, as which all phrases begin.
_START = re.compile(r"(?:^|(?<=[.!?…])\s+|(?<=\n)|(?<=>))\s*(?:<[a-z0-9]+>\s*)*[«“\"'(*\-–—•\s]*")
FILLER_PHRASE = re.compile(
    r"(?:(?:dummy|sample|placeholder|filler|example) (?:paragraph|text|copy|body|content|title|headline)\b"
    r"|(?:your|insert|add|enter) (?:text|title|content|copy|headline|article|description)[\w ]{0,20} (?:goes )?here\b"
    r"|your (?:text|title|content|copy|headline) (?:goes|here)|(?:text|content|copy|details?|more) (?:to follow|coming soon|to come)\b"
    r"|(?:coming soon|under construction)(?=\s*(?:$|[\n.!:…(<])|\s+[–—-]\s)|todo: |tbd: |tbc: |fixme|this (?:is a )?(?:placeholder|sample|dummy)"
    r"|hier (?:steht|folgt) (?:ein )?(?:blind|platzhalter|beispiel)text|(?:blind|platzhalter|beispiel)text\b"
    r"|text folgt|inhalt folgt|(?:texte|contenu) (?:provisoire|fictif|factice|d[’']exemple|à venir|de remplissage)"
    r"|(?:votre|insérez votre) texte ici|(?:texto|contenido) (?:de (?:ejemplo|relleno|muestra|prueba)|provisional|pendiente)"
    r"|(?:su|tu|escriba su) texto aquí|próximamente\b)"
)
ERROR_PHRASE = re.compile(
    r"(?:(?:http )?(?:error|erreur|fehler) ?:? ?[45]\d\d\b|[45]\d\d(?: [-–—:])? (?:error|not found|forbidden|unauthorized|bad gateway|bad request"
    r"|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|gone)"
    r"|(?:404|403|500|502|503|504)[\s.:-]+(?:page|server|access|file|object|seite|página|la page)\b"
    r"|oops(?=\s*(?:$|[\n.!,:…–—<-])|\s+(?:something|that|this|the page|we|an error)\b)|(?:page|file|document|article|resource) not found|not found[.:!]|we can[’']?t find (?:that|the|this|your) page"
    r"|(?:the )?page you (?:requested|are looking for|were looking for)|sorry, (?:the|this|that|we|an)\b[\w ]{0,40}(?:page|error|found|unavailable|available)"
    r"|access (?:is )?denied[.:!]|permission denied|you do(?:n[’']t| not) have permission|forbidden[.:!]"
    r"|internal server error|(?:bad gateway|gateway time-?out|service (?:temporarily )?unavailable)(?=$|[\n.:!])"
    r"|(?:the )?upstream (?:host|server)(?: for [\w/-]+)? (?:did not|failed|could not|returned|reset|closed|sent|timed|is (?:un|not|down))|database (?:connection )?(?:failed|error)|error establishing|fatal error|uncaught \w*exception"
    r"|(?:php )?(?:warning|notice|deprecated|fatal error|parse error): [^\n]{0,120}\bon line \d|stack trace:|unhandled exception"
    r"|traceback \(most recent call last\)|an (?:unexpected |internal )?error (?:has )?occurred|something went wrong|error \d+: "
    r"|too many requests|rate limit exceeded|session (?:has )?(?:expired|timed out|ended)|your session (?:has|is (?:no|about|over|in)|was|timed|expired|ended|could|will (?:expire|end))|(?:connection|request) timed out"
    r"|this (?:content|page|site|video|article|website) (?:is|isn[’']t) (?:not |currently |un)*available|not available in your (?:region|country)"
    r"|the link you followed|checking (?:that you are|if the site|your browser|you are)|verify(?:ing)? (?:that )?you are (?:a )?human"
    r"|please (?:verify|complete the (?:security|captcha))|just a moment(?=$|[\n.…])|(?:this )?(?:site|page) is (?:down|under maintenance)"
    r"|seite (?:wurde )?nicht gefunden|zugriff verweigert|interner serverfehler|(?:dieser|der) inhalt ist (?:nicht|in ihrer)|sitzung abgelaufen"
    r"|zu viele anfragen|(?:die )?verbindung zur datenbank|page (?:non trouvée|introuvable)|accès (?:refusé|interdit)|erreur interne|session expirée"
    r"|trop de requêtes|ce contenu n[’']est pas disponible|página no (?:encontrada|disponible)|acceso denegado|error interno|sesión (?:caducada|expirada)"
    r"|demasiadas solicitudes|este contenido no está disponible|la página (?:solicitada|que busca))"
)
SCRIPT_PHRASE = re.compile(
    r"(?:(?:(?:please |kindly )|if (?:nothing happens|this (?:page|site) does not load),? )?(?:please )?(?:enable|turn on|switch on|activate|allow|permit|unblock) (?:java ?scripts?|scripts"
    r"|cookies(?=\s*(?:$|[^\w\s])|\s+(?:to (?:view|continue|use|read|access|see|proceed|browse|enter|log|sign|watch|load|open)|in|and|for|on|then|or)\b))"
    r"|java ?script (?:is|must be|has to be|seems to be|appears to be)"
    r" (?:disabled|turned off|switched off|off|required|not enabled|enabled|needed|blocked)(?=\s*(?:$|[^\w\s])|\s+(?:to|for|on|by|in|here|but|and|or|please|at)\b)|(?:you|we) (?:need to|must|have to)[\w ]{0,30} (?:java ?script|scripts)"
    r"|(?:this|our|the) (?:app|site|page|website|application)[\w ]{0,20} (?:works (?:only|best) with|requires|needs) (?:java ?script|script|scripts|scripting)"
    r"|your browser (?:does not|doesn[’']t|cannot|can[’']t|blocks|is (?:not|out|un|too|no longer|old|set|blocking|missing|being)|has (?:java|scripts|cookies|blocked|disabled|turned|no )|must (?:support|allow|have|accept|be|run))|(?:to (?:view|read|use|continue)[\w ,]{0,40})(?:enable|turn on|allow) (?:java ?script|scripts)"
    r"|(?:bitte )?(?:aktivieren sie|schalten sie) (?:java ?script|skripte)|java ?script (?:ist (?:de|nicht|aus|erforder|notwendig|nötig|in )|muss |wird (?:benötigt|nicht|von |vom |für ))|(?:diese|die) (?:seite|anwendung) (?:benötigt|erfordert|funktioniert nur mit) (?:java ?script|skript)"
    r"|(?:veuillez |merci d[’'])?activer java ?script|java ?script (?:est (?:dés|requis|nécess|inact|oblig|bloqu)|doit être )|(?:cette|la) page (?:nécessite|requiert) (?:java ?script|des scripts)"
    r"|(?:por favor,? )?(?:active|activa|habilite|habilita|active usted) java ?script|java ?script (?:está (?:des|inact|bloq)|debe estar )|(?:esta|la) (?:página|aplicación) (?:requiere|necesita) (?:java ?script|scripts))"
)
# Signs one of which every mark has.
_MARK_PARTS = re.compile(r"[{$#%@<>\[&]|__|\((?:add|insert|enter|your|todo)", re.IGNORECASE)
_FILLER_WORDS = LOREM | KEYBOARD
_CODE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,}\b|\d[\d.,]*|/\S+", re.IGNORECASE)
_REQUEST = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,}\b|/[\w-]+/\d+", re.IGNORECASE)
#: A part of an address behind a word, and what stands in brackets with a number.
_RESOURCE = re.compile(r"\b[^\W\d_]+[/-]\d{4,}\b")
_ASIDE = re.compile(r"\([^()\n]{0,80}\d[^()\n]{0,80}\)")
_TAG = re.compile(r"</?[a-z0-9]+>")
_QUOTED = re.compile(r"[“\"«‘'][^”\"»’'\n]{1,60}[”\"»’']")


def placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands in content."""
    for m in PLACEHOLDER.finditer(text):
        if not _SPOKEN_OF.search(text[max(0, m.start() - 40) : m.start()]):
            return True
    for m in WEAK_PLACEHOLDER.finditer(text):
        inner = m[0].strip("<>[]{}()")
        if _SPOKEN_OF.search(text[max(0, m.start() - 40) : m.start()]):
            continue
        if m[0][0] == "<" and (inner.lower() in _MARKUP or inner.count(" ") > 3):
            continue
        if m[0][0] == "[" and inner.isalpha() and inner.lower() not in _FIELDS:
            if inner.lower() in _BRACKETED or not inner.isupper() or text.isupper():
                continue
        return True
    return False


#: Names of fields that unfilled forms have; in a text all in capitals a bracketed word must be one.
_FIELDS = frozenset(
    "statement knowledge claim title name author date headline summary city place region user count amount population "
    "source url text content body heading verdict label company address email phone country product price".split()
)


def filler_run(low: str) -> bool:
    """Whether the text in lower case holds a run of filler words."""
    words = _WORD.findall(low)
    if _FILLER_WORDS.isdisjoint(words):
        return False
    run = keyboard = latin = 0
    for word in words:
        if word in LOREM:
            run, latin, keyboard = run + 1, latin + (len(word) > 3), 0
            if run >= FILLER_RUN and latin >= FILLER_RUN - 1:
                return True
        elif word in KEYBOARD:
            keyboard, run, latin = keyboard + 1, 0, 0
            if keyboard >= FILLER_RUN:
                return True
        else:
            run = latin = keyboard = 0
    return False


MESSAGES = (("filler", FILLER_PHRASE), ("script", SCRIPT_PHRASE), ("error", ERROR_PHRASE))


def signs(text: str | None) -> tuple[str | None, int, list[str], str]:
    """(kind, points, messages, rest) of a text by the detectors alone: 'placeholder', 'filler', 'error' or
    'script', or null; the sentences and lines that are messages, and the text without them, in lower case."""
    if not text:
        return None, 0, [], ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    low = text.lower()
    if _MARK_PARTS.search(low) and placeholder(text):
        return "placeholder", POINTS, [], text
    if filler_run(low):
        return "filler", POINTS, [], low
    found = list(_START.finditer(low))
    kinds = [next((name for name, phrase in MESSAGES if phrase.match(low, m.end())), None) for m in found]
    kind = next((name for name, _ in MESSAGES if name in kinds), None)
    if kind is None:
        return None, 0, [], low
    messages, rest = [], []
    for m, end, said in zip(found, [*(m.start() for m in found[1:]), len(low)], kinds, strict=True):
        (messages if said else rest).append(low[m.start() : end])
    return kind, MESSAGE, messages, "".join(rest)


def residue_kind(text: str | None) -> str | None:
    """What the detectors find in a text, whatever else is in it."""
    return signs(text)[0]


def terms(text: str | None) -> set[str]:
    """Words of at least four letters, without case."""
    return {w for w in _WORD.findall((text or "").lower()) if len(w) >= 4}


def body_terms(text: str) -> set[str]:
    """Terms of a body outside its quotations, codes and paths."""
    return terms(_QUOTED.sub(" ", _CODE.sub(" ", text)))


def address_terms(url: str | None, title: str | None) -> set[str]:
    """Terms of an address between its host and its query, and of the title."""
    return terms(re.sub(r"^[A-Za-z]+://[^/]*|[?#].*", "", url or "")) | terms(title)


def masked(text: str) -> str:
    """The template of a body or message in lower case: one space between words, and nothing of the numbers, codes,
    paths, quotations, asides and tags that differ from one response to the next."""
    bare = _QUOTED.sub("0", _ASIDE.sub("0", _TAG.sub(" ", text)))
    return " ".join(_CODE.sub("0", _RESOURCE.sub("0", bare)).split())


def text_hash(text: str) -> int:
    """64 bits that stand for a text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Examined(NamedTuple):
    """What one record alone says: points so far, and what is to be counted over all hosts."""

    kind: str | None
    points: int
    mismatch: bool
    coded: bool
    template: int | None  # of the body, where it says little
    messages: list[int]  # templates of its messages


def examine(text: str | None, url: str | None, title: str | None) -> Examined | None:
    """The signs of one record; null where nothing is to be counted or scored."""
    kind, points, messages, rest = signs(text)
    if points >= POINTS:
        return Examined(kind, points, False, False, None, [])
    if not text or not text.strip():
        return None
    listed = text.lstrip()[0] in "{["  # records of fields say what they say by their values
    if kind is None and listed:
        return None
    body = body_terms(rest)
    mismatch, low = body.isdisjoint(address_terms(url, title)), len(body) <= LOW_TERMS
    points += MISMATCH * mismatch + LOW * low
    if kind:
        return Examined(kind, points, mismatch, False, None, [text_hash(masked(m)) for m in messages])
    if not low or len(body) < FEWEST_TERMS:
        return None
    return Examined(None, points, mismatch, bool(_REQUEST.search(text)), text_hash(masked(rest)), [])


def local_kind(text: str | None) -> str | None:
    """The kind of a text that is residue by its own signs, without those of its address and of other records; else
    null. A message counts here where little stands beside it."""
    kind, points, _, rest = signs(text)
    return kind if kind and (points >= POINTS or len(body_terms(rest)) <= LOW_TERMS) else None


def examined(records: DataFrame) -> DataFrame:
    """(record_type, record_id, source, address, value, fields of Examined) of records (record_type, record_id,
    source, url, title, text); value is a hash of the text."""
    names = ["record_type", "record_id", "source"]
    schema = (
        f"record_type string, record_id {dict(records.dtypes)['record_id']}, source string, address bigint, value bigint, "
        "kind string, points int, mismatch boolean, coded boolean, template bigint, messages array<bigint>"
    )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            columns = (batch.column(name).to_pylist() for name in ("text", "url", "title"))
            for at, (text, url, title) in enumerate(zip(*columns, strict=True)):
                found = examine(text, url, title)
                if found:
                    # a record without an address is told apart by its title, as that of a search is its query
                    kept.append(at)
                    rows.append((text_hash(url or title or ""), text_hash(text), *found))
            made = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            taken = [batch.column(name).take(pa.array(kept, pa.int64())) for name in names]
            arrays = [pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*taken, *arrays], [*names, "address", "value", *Examined._fields])

    given = records.select("record_type", "record_id", "source", "url", "title", "text").where(not_blank(F.col("text")))
    return given.mapInArrow(run, schema)


def _different(rows: DataFrame, name: str) -> DataFrame:
    """(form, n): the different values of a column for each form, in two steps, so that no form is hot."""
    return rows.select("form", name).distinct().groupBy("form").agg(F.count("*").alias("n")).select("form", F.col("n").alias(name))


def repeated_forms(forms: DataFrame, thing: str) -> DataFrame:
    """(form): the templates of ``forms`` (form, source, thing) at so many different things and sources that they
    are one response or message."""
    both = _different(forms, thing).where(F.col(thing) >= MIN_ADDRESSES).join(_different(forms, "source").where(F.col("source") >= MIN_SOURCES), "form")
    return both.select("form")


def plain_forms(forms: DataFrame) -> DataFrame:
    """(form): the templates without codes that stand at many sources and hardly ever where they fit the address."""
    by_source = forms.groupBy("form", "source").agg(F.count("*").alias("records"), F.count_if("mismatch").alias("apart"))
    whole = by_source.groupBy("form").agg(F.count("*").alias("sources"), F.sum("records").alias("records"), F.sum("apart").alias("apart"))
    return whole.where((F.col("sources") >= PLAIN_SOURCES) & (F.col("apart") >= PLAIN_MISMATCH * F.col("records"))).select("form")


def find(records: DataFrame) -> DataFrame:
    """(record_type, record_id, kind): the records that are, or hold, template residue; kind 'repeated'
    stands for a low-information response served for many addresses, whatever copies there are."""
    seen = cut_lineage(examined(records).withColumn("source", F.xxhash64("source")))
    ids = ["record_type", "record_id", "kind"]
    bodies = seen.where("template IS NOT NULL").withColumn("form", F.col("template"))
    apart = bodies.where("mismatch")
    coded = repeated_forms(apart.where("coded"), "address")
    plain = plain_forms(bodies.where("NOT coded"))
    known = sized_join(apart, cut_lineage(coded.unionAll(plain)), ["form"], "left_semi")
    said = seen.withColumn("form", F.explode("messages"))
    missing = said.where((F.col("points") < POINTS) & (F.col("points") + REPEATED >= POINTS))
    repeated = sized_join(missing, cut_lineage(repeated_forms(said, "value")), ["form"], "left_semi")
    found = (
        seen.where(F.col("points") >= POINTS).select(*ids)
        .unionAll(known.where(F.col("points") + REPEATED >= POINTS).select("record_type", "record_id", F.lit("repeated")))
        .unionAll(repeated.select(*ids))
    )
    return found.groupBy("record_type", "record_id").agg(F.min("kind").alias("kind"))


def as_records(kind: str, df: DataFrame, key: str, source: Column, url: Column, title: Column, text: str) -> DataFrame:
    """Rows of a table in the form that :func:`find` takes."""
    return df.select(
        F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), source.alias("source"),
        url.alias("url"), title.alias("title"), F.col(text).alias("text"),
    )


def keep_content(df: DataFrame, key: str, found: DataFrame, kind: str) -> DataFrame:
    """``df`` without the records of ``found`` that are of ``kind``."""
    bad = cut_lineage(found.where(F.col("record_type") == kind).select(F.col("record_id").alias("_bad")).distinct())
    rows = df.select(F.col(key).alias("_bad"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    return sized_join(rows, bad, ["_bad"], "left_anti").select("row.*")
