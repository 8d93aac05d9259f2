"""Each operator of the subpackage on small cases, odd tables, and against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import rows_of, sql_rows
from verisift.llm import boilerplate, duplicates, leakage, lookalikes, mixing, quality, queries, residue, truncation

EVIDENCE = "evidence_id bigint, url string, title string, text string, key string, row string, source string"
#: Columns of any name, also of those the operators work with, nulls everywhere, long and empty texts.
ODD = [
    (1, None, None, None, None, None, None), (2, "", "", "", "", "", ""), (3, "x", " ", " \n\t ", "k", "r", "s"),
    (4, "http://a.example/b", "t", "word " * 20_000, "k", "r", "s"), (5, "http://a.example/b", "t", "One line.", "k", "r", "s"),
    (5, "http://a.example/b", "t", "One line.", "k", "r", "s"), (6, "http://a.example", "t", "{" * 50, None, "r", "s"),
    (None, "http://a.example", "t", "No key here.", None, None, None), (7, "http://[", "\u0000", "a\u0000b\r\n\r\n", "", "", ""),
]
WORDS = frozenset("the of and to in a is was for on".split())


def evidence(spark, rows, schema=EVIDENCE):
    return spark.createDataFrame(rows, schema)


def as_records(df):
    return residue.as_records("evidence", df, "evidence_id", F.col("source"), F.col("url"), F.col("title"), "text")


# Problem 1


def test_lookalikes_are_mapped():
    pairs = {
        "Ｆｕｌｌ": "Full", "été": "été", "zero​width": "zerowidth", "no break": "no break", "well‑kept": "well-kept",
        "Аrсhіvе": "Archive", "ﬁeld": "field", "Kelvin": "Kelvin", "soft­hyphen": "softhyphen", "пaрк": "парк",
        "ℎouse": "house", "ℒondon": "London", "ℨero": "Zero", "ℝ": "ℝ", "Ⅰ": "I", "ⅾ": "d", "Ⅻ": "XII", "doɡ": "dog", "ɑnd": "and", "ɡɔt": "ɡɔt",
        "bᴏy": "boy", "ⓛate": "late", "ⓛ": "ⓛ", "well−kept": "well-kept", "−5": "−5", "｡": "。", "ｶﾞ": "ガ", "appӏe": "apple", "Ӏtem": "Item",
        "ꓐꓳꓳꓗ": "BOOK", "Ⲟne": "One", "Ꭰay": "Day", "ısı": "ısı", "Архив": "Архив", "naïve": "naïve", "½ № ™ ²": "½ № ™ ²", "𝐁𝐨𝐥𝐝": "Bold",
    }
    assert {k: lookalikes.looks_like(k) for k in pairs} == pairs


def test_lookalikes_found_and_normalised(spark):
    texts = {
        1: "plain text with “quotes” – and… signs", 2: "the ﬁeld", 3: "архив города Тасрин.", 4: "fire 👩‍🚒 engine",
        5: "Тhe А list", 6: "το λιμάνι της Βελμόρα.", 7: "a b", 8: "港の記録。", 9: "café", 10: "café", 11: "می‌خواهم",
        12: "don’t", 15: "the ℎouse of ɡold", 16: "x ∈ ℝ, −5 °C", 13: "x\ufe0f", 14: "1\ufe0f\u20e3 ❤\ufe0f 🏴\U000e0067\U000e007f",
    }
    df = evidence(spark, [(i, None, "ｔ" if i == 1 else "t", t, None, None, None) for i, t in texts.items()])
    found = {(r.evidence_id, r.field_name) for r in lookalikes.find(df, "evidence_id", ["text", "title"]).collect()}
    assert found == {(1, "title"), (2, "text"), (5, "text"), (7, "text"), (9, "text"), (13, "text"), (15, "text")}
    fixed = {r.evidence_id: r for r in lookalikes.normalize(df, ["text", "title"]).collect()}
    assert fixed[2].text == "the field" and fixed[5].text == "The A list" and fixed[7].text == "a b" and fixed[9].text == "café" and fixed[1].title == "t"
    assert fixed[15].text == "the house of gold"
    for kept in (1, 3, 4, 6, 8, 10, 11, 12, 14, 16):
        assert fixed[kept].text == texts[kept]


def test_normalising_twice_changes_nothing(spark, data):
    once = queries.p1_normalized(spark, data)
    assert rows_of(once) == rows_of(lookalikes.normalize(once, ["text", "title"]))


def test_lookalikes_odd_tables(spark):
    df = evidence(spark, ODD)
    assert lookalikes.normalize(df, ["text", "title"]).columns == df.columns
    assert rows_of(lookalikes.normalize(df, ["text", "title"])) == rows_of(df)
    assert lookalikes.find(df, "evidence_id", ["text"]).count() == 0
    none = evidence(spark, [])
    assert lookalikes.find(none, "evidence_id", ["text"]).count() == lookalikes.normalize(none, ["text"]).count() == 0
    twice = evidence(spark, [(1, None, None, "a​b", None, None, None)] * 2)
    assert lookalikes.find(twice, "evidence_id", ["text"]).count() == 1
    assert [r.text for r in lookalikes.normalize(twice, ["text"]).collect()] == ["ab", "ab"]


# Problem 2


@pytest.mark.parametrize(
    ("value", "state"),
    [
        ("A whole sentence.", "whole"), ("A whole one (see annex)...", "dots"), ("He asked “why?”", "whole"), ("ends here.;", "whole"),
        ("cut in the mid [...]", "cut"), ("cut in the mid…", "cut"), ("cut at &am", "cut"), ("cut at <a hre", "cut"), ("cut �", "cut"),
        ('{"a": "b", "c": 1}', "whole"), ('{"a": "b", "c', "cut"), ("an open “quotation", "cut"), ("an open (bracket", "cut"), ("a, b,", "cut"),
        ("text \\u00", "cut"), ("see https://ww", "cut"), ("no stop here", "open"), ("a: 1; b: 2; c: 3", "field"), ("a: 1; b: 2; c:", "cut"),
        ("Fine. (½ of it)", "whole"), ("Fine. (…)", "whole"), ("", "whole"), ("done 👍", "whole"), ("<h1>Title</h1>", "whole"),
    ],
)
def test_endings(value, state):
    assert truncation.ending(value, WORDS)[0] == state


def test_lengths():
    assert truncation.lengths('é<\n"😀') == [5, 9, 6, 13, 7, 6]


def test_limits_and_forms(spark):
    rng = random.Random(3)
    nouns = ["bridge", "kiln", "mural", "school", "dam", "canal", "tower", "garden"]
    rows, cut = [], set()
    for i in range(900):
        text = " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was built in {rng.randint(1800, 1999)}." for _ in range(6))
        if i % 9 == 0:
            text = text[:100]
            if not text.endswith("."):
                cut.add(i)
        elif i % 9 == 1:
            text += "\nPhoto: the archive"
        rows.append((i, "http://h.example/x", "t", text, None, None, "h.example"))
    records = as_records(evidence(spark, rows))
    found = {r.record_id for r in truncation.find(records, WORDS).collect()}
    assert found == cut
    ends = truncation.endings(records, WORDS)
    assert (0, 100) in {(r.encoding, r.length) for r in truncation.limits(ends).collect()}
    rate = truncation.rates(records, WORDS).collect()[0]
    assert (rate.source, rate.records, rate.cut_records) == ("h.example", 900, len(cut))


def test_limits_explain_each_other(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = " ".join(rng.choice(vocabulary(rng, 5)) for _ in range(60))
        text = words[:150] + ("\n" if i % 2 else " ") + words[151:]
        text = "é" * (1 + i % 4) + "&" + text if i % 3 == 0 else text
        cut_at = 204 if i % 3 == 0 else 200  # by the bytes of one source, the characters of the other
        source = "b" if i % 3 == 0 else "c"
        rows.append((i, None, None, text.encode()[: cut_at - 1].decode() + "x" if source == "b" else text[: cut_at - 1] + "x", None, None, source))
    found = truncation.limits_of_sources(as_records(evidence(spark, rows)), WORDS).collect()
    assert sorted((r.source, r.encoding, r.length) for r in found) == [("b", "utf8", 204), ("c", "characters", 200)]


def test_marks_and_dots_at_a_limit(spark):
    assert truncation.ending("The mill was (…)", WORDS)[0] == "cut"
    whole = [f"The mill of the town was built in {y}." for y in range(1700, 1900)]
    cut = [("The mill of the town was built in 1850. " * 3)[: 97 - len(str(i))] + str(i) for i in range(50)]
    dots = ["The mill of the town was built in 1850. " * 2 + "x" * 4 + "w" * 5 + " 1850...", "The mill of the town was built in 1850..."]
    rows = [(i, None, None, t, None, None, "s") for i, t in enumerate(whole + cut + dots)]
    assert len(dots[0]) == 97
    found = {r.record_id for r in truncation.find(as_records(evidence(spark, rows)), WORDS).collect()}
    assert 250 in found and 251 not in found and not found & set(range(200))


def test_long_sentences_and_deep_structures(spark):
    sentence = "The mill of " + "a town was in the " * 10_000 + "end"
    deep = '[{"a":' * 10_000
    rows = [(1, None, None, sentence + ".", None, None, "s"), (2, None, None, sentence[:-2], None, None, "s"), (3, None, None, deep, None, None, "s")]
    rows += [(4, None, None, deep + "1" + "}]" * 10_000, None, None, "s")]
    import time

    began = time.monotonic()
    found = {r.record_id for r in truncation.find(as_records(evidence(spark, rows)), WORDS).collect()}
    assert found == {2, 3} and time.monotonic() - began < 60


def test_beginnings_of_forms(spark):
    wanted = [truncation.chained(x)[-1] for x in ("A was", "A was in", "A was in 0", "w the")]
    sentences = ["A was in 0"] * 3 + ["A was w"] * 2 + ["#A was in"]
    ends = spark.createDataFrame([([s],) for s in sentences], "finished array<string>")
    forms = spark.createDataFrame([(w,) for w in wanted], "form bigint")
    got = {r.form: (r.complete, r.begun) for r in truncation.forms_of_sentences(ends, forms).collect()}
    assert got == {wanted[0]: (0, 5), wanted[1]: (0, 3), wanted[2]: (3, 0)}


def test_copies_make_no_line_recur(spark):
    rng = random.Random(8)
    whole = [f"The {a} {b} of the {c} was in {d}." for a, b, c, d in ([rng.choice(vocabulary(rng, 9)) for _ in range(4)] for _ in range(60))]
    cut = "The old harbour of the town was in repa"
    far = "the " + "word " * 40 + "card of"
    texts = whole + [cut] * 12 + [f"Number {i} is {w}.\n{far}" for i, w in enumerate(vocabulary(rng, 12))]
    df = evidence(spark, [(i, None, None, t, None, None, f"s{i % 3}") for i, t in enumerate(texts)])
    found = {r.record_id for r in truncation.find(as_records(df), WORDS).collect()}
    assert set(range(60, 72)) <= found, "ten copies of a cut value are as cut as nine"
    lines = truncation.recurring_lines(*(truncation.endings(as_records(df), WORDS),) * 2).where("recurs").collect()
    assert [r.same for r in lines] == [12], "a long line of twelve values recurs"


def test_truncation_odd_tables(spark):
    assert truncation.find(as_records(evidence(spark, [])), WORDS).count() == 0
    found = {r.record_id for r in truncation.find(as_records(evidence(spark, ODD)), WORDS).collect()}
    assert found <= {4, 6, 7} and truncation.rates(as_records(evidence(spark, ODD)), WORDS).count() >= 1


# Problem 3


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Dear {{first_name}}, welcome", "placeholder"), ("Hello ${user}!", "placeholder"), ("Result: %s", "placeholder"), ("By [YOUR NAME]", "placeholder"),
        ("The <city> mayor", "placeholder"), ("a tag such as {{ name }} is filled in", None), ("the set {2, 3, 5}", None), ("is fine [sic], he said", None),
        ("rose 100% to $40 <b>now</b>", None), ("column marked [n]", None), ("Tom &amp; Jerry", None),
        ("Lorem ipsum dolor sit amet consectetur elit.", "filler"), ("printers set lorem ipsum as sample text", None), ("Your text goes here", "filler"),
        ("asdf qwerty foo bar asdf qwerty", "filler"), ("TODO: write this", "filler"),
        ("404 Not Found. The page", "error"), ("Voters saw “service unavailable” on the page", None), ("Access denied. Go away", "error"),
        ("Access was denied to 26 people", None), ("Seite nicht gefunden: /x", "error"), ("The site answered with a 404 page", None),
        ("Please enable JavaScript to go on.", "script"), ("She explains why JavaScript must be enabled on the portal", None),
        ("Veuillez activer JavaScript pour lire", "script"), (None, None), ("", None), ("An ordinary text about a bridge.", None),
    ],
)
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        *[(t, "error") for t in (
            "401 Unauthorized", "400 Bad Request", "410 Gone", "Sorry, the page could not be found", "This content isn't available", "We can't find your page",
            "Please complete the captcha", "404. Page missing", "La página que busca", "Der Inhalt ist nicht da", "One. <b>Oops</b>", "x\n  502 - server",
        )],
        ("Insert headline here", "filler"), ("Your headline here", "filler"), ("This page requires script", "script"), ("the TBC> left", "placeholder"),
        ("Excepteur sint occaecat cupidatat non proident, sunt in culpa", "filler"), ("test testing bla blub test", "filler"),
    ],
)
def test_every_alternative_is_tried(text, kind):
    assert residue.residue_kind(text) == kind


def test_unknown_responses_are_found_by_all_hosts_together(spark):
    rng = random.Random(5)
    rows = [
        (i, f"http://h{i % 7}.example/bridge/old-{i}", f"The old bridge {i}", f"Nous revenons bientôt, dossier {rng.getrandbits(48):012x} archivé.", None, None, f"h{i % 7}")
        for i in range(40)
    ]
    rows += [(100 + i, "http://a.example/kiln/x", "Kiln", "The same harvest text 0011223344aa here.", None, None, f"s{i % 5}") for i in range(20)]
    rows += [(200, "http://a.example/bridge/x", "Bridge", "The bridge ab12cd34ef56 stands.", None, None, "s")]
    found = {r.record_id: r.kind for r in residue.find(as_records(evidence(spark, rows))).collect()}
    assert found == {i: "repeated" for i in range(40)}, "copies of one text, and texts about their address, are none"


def test_one_response_at_many_addresses_is_found(spark):
    text = "Nous revenons bientôt, dossier 0011223344aa archivé."
    rows = [(i, f"http://h{i % 3}.example/bridge/{i}", "Bridge", text, None, None, f"h{i % 3}") for i in range(8)]
    rows += [(10 + i, "http://h1.example/mill/x", "Mill", f"Bis morgen, Vorgang {i % 9 + 10:012x} ruht jetzt.", None, None, "h1") for i in range(40)]
    found = {r.record_id: r.kind for r in residue.find(as_records(evidence(spark, rows))).collect()}
    assert found == {i: "repeated" for i in range(8)}


PROSE = (
    "The old bridge was opened in spring by the mayor. Farmers carried grain across it every autumn. A storm damaged two arches, "
    "and masons repaired them slowly. Merchants paid tolls in copper coins. Children fished from the northern bank. {} "
    "Later engineers widened the roadway with timber. Painters loved its reflection at dusk. Records mention seven floods. "
    "Travellers praised nearby inns for their soup. Today visitors photograph its weathered stones."
)
SPOKEN = (
    "Your session with the counsellor lasts an hour.", "Your browser is the window to the web.", "The upstream server of the mill was rebuilt in 1850.",
    "JavaScript is required reading for the course.", "Coming soon to the city is a new tram line.", "Oops was the title of the 1999 album.",
    "Please enable cookies to cool before serving.", "JavaScript ist eine Sprache.",
)


def test_prose_that_begins_like_a_message_is_kept(spark):
    texts = [PROSE.format(s) for s in SPOKEN] + [PROSE.format("Something went wrong at the third arch."), PROSE.format("Too many requests came for the mill.")]
    rows = [(i, f"http://h.example/x{i}", "Weathered stones", t, None, None, f"h{i}") for i, t in enumerate(texts)]
    assert residue.find(as_records(evidence(spark, rows))).count() == 0
    repeated = [(i, f"http://h{i}.example/x", "Stones", PROSE.format("Something went wrong (code 1234567).") + f" Number {i}.", None, None, f"h{i}") for i in range(6)]
    found = {r.record_id: r.kind for r in residue.find(as_records(evidence(spark, repeated))).collect()}
    assert found == dict.fromkeys(range(6), "error"), "a message that stands in many texts of many hosts"


def test_a_page_without_codes_on_many_hosts_is_found(spark):
    page = "We will be back soon with better service for everyone here.\n" + "Contact your local office meanwhile. " * 40
    rows = [(i, f"http://h{i}.example/bridge/old-{i}", f"Bridge {i}", page, None, None, f"h{i}") for i in range(100)]
    copies = [(200 + i, f"http://h{i}.example/bridge/o{i}", "Old kiln", "The kiln of the town was sold in winter.", None, None, f"h{i}") for i in range(60)]
    few = [(300 + i, f"http://h{i}.example/dam/o{i}", "Dam", "A harvest of the valley was sold in winter.", None, None, f"h{i}") for i in range(12)]
    found = {r.record_id: r.kind for r in residue.find(as_records(evidence(spark, rows + copies + few))).collect()}
    assert found == dict.fromkeys(range(100), "repeated"), "copies that fit their title, or stand at few sources, are none"


def test_residue_odd_tables(spark):
    df = evidence(spark, ODD + [(9, None, None, "Lorem ipsum dolor sit amet elit sed.", None, None, None)] * 2)
    found = residue.find(as_records(df))
    assert [(r.record_id, r.kind) for r in found.collect()] == [(9, "filler")]
    kept = residue.keep_content(df, "evidence_id", found, "evidence")
    assert kept.columns == df.columns and rows_of(kept) == rows_of(evidence(spark, ODD))
    assert residue.find(as_records(evidence(spark, []))).count() == 0


# Problem 4


def pairs_of(df, key="evidence_id"):
    return {(r.keep_id, r.copy_id) for r in duplicates.find(df, key, "text").collect()}


def test_same_content(spark):
    groups = [
        ["The harvest, of 4.2 tons - was good.", "the  HARVEST of 4.2 tons\nwas good", "“The harvest of 4.2 tons was good”", "The harvest | of 4.2 tons; was good..."],
        ["The harvest of 42 tons was good."], ["The harvest of 4,2 tons was good."],
        ['{"a": "x", "b": "1"}', '{\n "b":"1",\n "a":"X"}'], ['{"a": "1", "b": "x"}'], ['{"a": {"x": 1.50, "y": [2, {"p": 1, "q": "z"}]}, "c": 3}', '{"C": 3, "A": {"y": [2, {"q": "Z", "p": 1}], "X": 1.50}}'],
        ['{"a": {"x": 1.5, "y": [2, {"p": 1, "q": "z"}]}, "c": 3}'], ['{"a": {"x": 1.50, "y": [{"p": 1, "q": "z"}, 2]}, "c": 3}'], ["a: x; b: 1", "B = 1 | A = x", "a : x, b : 1"], ["a: 1; b: x"],
        ["One. Two."], ["Two. One."], ["GROSSE STRASSE", "große straße"], ["Rin dam: 5. Rin mayor: Ane Lo. Rin area: 4.2.", "RIN  AREA: 4.2. RIN\nMAYOR: ANE LO - RIN DAM: 5", "Rin area: 4.2 | Rin dam: 5 | Rin mayor: Ane Lo"],
        ["Rin dam: 4.2. Rin mayor: Ane Lo. Rin area: 5."], ["Rin dam: 5. Then it rained. Rin area: 4.2."], ["Rin area: 4.2. Then it rained. Rin dam: 5."],
        ["The x bridge: 4.\n\nThe x dam: 5.", "The x bridge: 4. The x dam: 5."], ["!!!"], ["???"], ["12 45"], ["1245"],
    ]
    rows, expected, i = [], set(), 0
    for group in groups:
        first = i
        for text in group:
            rows.append((i, None, None, text, None, None, None))
            if i > first:
                expected.add((first, i))
            i += 1
    assert pairs_of(evidence(spark, rows)) == expected


def test_duplicates_against_brute_force(spark, data):
    def form(text):
        text = re.sub(r"(?<=\d)[^\w\s](?=\d)", "S", text.casefold())
        text = re.sub(r"(?<=\d)[^\w]+(?=\d)", "T", text)
        return re.sub(r"[^\w%&@$+°²³½¾€©™‰§→№]", "", text)

    df = spark.read.parquet(f"{data}/evidence.parquet").where("text IS NOT NULL")
    prose = [(r.evidence_id, r.text) for r in df.collect() if r.text.strip() and not re.match(r"\s*\{|[^.]*[:=]", r.text)]
    smallest = {}
    for i, t in sorted(prose):
        smallest.setdefault(form(t), i)
    expected = {(smallest[form(t)], i) for i, t in prose if smallest[form(t)] != i}
    ids = {i for i, _ in prose}
    assert {p for p in pairs_of(df) if p[0] in ids and p[1] in ids} == expected


def test_duplicates_odd_tables(spark):
    df = evidence(spark, ODD)
    assert pairs_of(df) == set() and duplicates.collapse(df, "evidence_id", "text").columns == [*df.columns, "copies"]
    assert duplicates.collapse(df, "evidence_id", "text").count() == len(ODD), "rows of one id stay"
    assert duplicates.collapse(evidence(spark, []), "evidence_id", "text").count() == 0
    hot = evidence(spark, [(i, None, None, "same text!" if i % 3 else f"text {i}", None, None, None) for i in range(300)])
    kept = duplicates.collapse(hot, "evidence_id", "text")
    assert kept.count() == 101 and kept.agg(F.max("copies")).collect()[0][0] == 200


# Problem 5


def test_boilerplate(spark):
    rows = []
    for i in range(60):
        lines = ["Home > News", f"Text {i}.", "", "All rights  RESERVED"] if i < 30 else [f"Text {i}.", "all rights reserved\r"]
        rows.append((i, "http://a.example/x", None, "\n".join(lines), None, None, None))
    rows += [(100 + i, "http://b.example/x", None, "all rights reserved" if i < 9 else f"b {i}", None, None, None) for i in range(40)]
    rows += [(200 + i, "no address", None, "all rights reserved", None, None, None) for i in range(40)]
    df = evidence(spark, rows)
    found = {(r.evidence_id, r.line_no) for r in boilerplate.find(df, "evidence_id", "url", "text").collect()}
    assert found == {(i, n) for i in range(30) for n in (1, 4)} | {(i, 2) for i in range(30, 60)}
    cleaned = {r.evidence_id: r.text for r in boilerplate.clean(df, "url", "text").collect()}
    assert cleaned[0] == "Text 0.\n" and cleaned[40] == "Text 40." and cleaned[100] == cleaned[200] == "all rights reserved"
    lines = boilerplate.lines_of_sources(df, "evidence_id", "url", "text").collect()
    assert {r.records for r in lines} == {30, 60} and len({r.block for r in lines}) == 2


def test_blocks_join_lines_that_follow_each_other(spark):
    rows = [(i, "http://a.example", None, f"Share this\nPrint this\nText {i}\nA b", None, None, None) for i in range(20)]
    found = boilerplate.find(evidence(spark, rows), "evidence_id", "url", "text").where("evidence_id = 3").orderBy("line_no").collect()
    assert [r.line_no for r in found] == [1, 2, 4]
    assert found[0].block == found[1].block != found[2].block


def test_boilerplate_like_sql(spark, data):
    for name in ("p5_found", "p5_lines", "p5_blocks", "p5_cleaned"):
        assert rows_of(queries.queries()[name](spark, data)) == sql_rows(data, queries.oracle_sql()[name])


def test_boilerplate_odd_tables(spark):
    df = evidence(spark, ODD)
    assert boilerplate.find(df, "evidence_id", "url", "text").count() == 0
    assert rows_of(boilerplate.clean(df, "url", "text")) == rows_of(df)
    assert boilerplate.clean(evidence(spark, []), "url", "text").count() == 0


# Problem 6


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    common, rare = vocabulary(rng, 60), vocabulary(rng, 3000)
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = [(i, "Decide this now: " * (i % 2) + " ".join(sentence(rng.randint(40, 90))), "True" if i % 3 else None) for i in range(40)]
    texts = leakage.without_instructions([t for _, t, _ in items])
    docs = []
    for d in range(400):
        words, other = sentence(rng.randint(30, 300)), leakage.normal_words(texts[d % 40])
        kind = d % 8
        if kind == 0:
            at = rng.randrange(len(other) - 16)
            words[20:20] = [w.upper() + "," for w in other[at : at + 15]]
        elif kind == 1:
            words[10:10] = [w for w in other if rng.random() > 0.15]
        elif kind == 2:
            words[10:10] = [rng.choice(rare) if rng.random() < 0.12 else w for w in other]
        elif kind == 3:
            words[5:5] = other[:14]
        elif kind == 4:
            words[0:0] = ["Decide", "this", "now:"]
        docs.append((d, " ".join(words)))
    expected = set()
    known = {i: leakage.normal_words(t) for (i, _, _), t in zip(items, texts, strict=True)}
    for d, t in docs:
        words = leakage.normal_words(t)
        for i, item in known.items():
            if leakage.longest_run(words, item) >= 15 or leakage.common_words_in_order(words, item) * 3 >= 2 * len(item):
                expected.add((d, i))
    found = leakage.find(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id int, text string, answer string"), "item_id", "text", "answer")
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= expected and len(got & expected) >= 0.95 * len(expected) and len(expected) > 100


def test_hot_leaks_are_found(spark):
    rng = random.Random(3)
    rare = vocabulary(rng, 2000)
    item, other = (" ".join(rng.choice(rare) for _ in range(45)) for _ in range(2))
    reworked = " ".join(w for i, w in enumerate(item.split()) if i % 4)  # no run of 15 words
    text = lambda d: (item if d % 6 == 0 else reworked if d % 6 == 3 else "") + " " + " ".join(rng.choice(rare) for _ in range(30))
    docs = spark.createDataFrame([(d, text(d)) for d in range(120)], "doc_id int, text string")
    items = spark.createDataFrame([(1, item), (2, other)], "item_id int, text string")
    found = leakage.find(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(d, 1) for d in range(0, 120, 3)]


def test_runs_of_frequent_words_are_found(spark):
    rng = random.Random(4)
    common, rare = vocabulary(rng, 30), vocabulary(rng, 2000)
    run = " ".join(rng.choice(common) for _ in range(15))
    item = " ".join([*rng.sample(rare, 30), run, *rng.sample(rare, 30)])
    docs = [(d, " ".join(rng.choice(common) for _ in range(40)) + f" {run if d % 50 == 0 else run[2:]} " + " ".join(rng.choice(common) for _ in range(40))) for d in range(300)]
    docs += [(900, ""), (901, run[: len(run) // 2]), (902, run[len(run) // 2 :])]
    docs = spark.createDataFrame(docs, "doc_id int, text string").coalesce(1)
    items = spark.createDataFrame([(1, item), (2, item), (3, "too short")], "item_id int, text string")
    found = leakage.find(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(d, i) for d in range(0, 300, 50) for i in (1, 2)]


def test_words_and_subsequences():
    assert leakage.normal_words("The “Fｉeld” — of​ a-b, 4.2!") == ["the", "field", "of", "ab", "42"]
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
                run[i + 1][j + 1] = run[i][j] + 1 if x == y else 0
        assert leakage.common_words_in_order(a, b) == table[-1][-1]
        assert leakage.longest_run(a, b) == max(map(max, run))


def test_many_items(spark):
    rng = random.Random(12)
    common, rare = vocabulary(rng, 80), vocabulary(rng, 4000)
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(sentence(rng.randint(60, 200)))) for i in range(2000)]
    docs, truth = [], set()
    for d in range(360):
        i, words = rng.randrange(2000), sentence(rng.randint(50, 200))
        item = items[i][1].split()
        if d % 3 == 0:
            at = rng.randrange(len(item) - 15)
            words[9:9] = item[at : at + 15]
            truth.add((d, i))
        elif d % 3 == 1:
            words[9:9] = [w if rng.random() > 0.2 else rng.choice(rare) for w in item]
        docs.append((d, " ".join(words)))
    held = leakage.HeldOut([(i, t, None) for i, t in items])
    counts = [Counter(t.split()) for _, t in items]
    for d, t in docs:  # brute force
        present, words = set(t.split()), t.split()
        for i, item in enumerate(counts):
            size = sum(item.values())
            if sum(n for w, n in item.items() if w in present) * 3 >= 2 * size and leakage.common_words_in_order(words, items[i][1].split()) * 3 >= 2 * size:
                truth.add((d, i))
    assert len(held.passages) >= 5000 and len(truth) > 220
    table, asked = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = leakage.find(table, "doc_id", "text", asked, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth, "nothing is lost, whatever rank and index are"
    latent = {(r.doc_id, r.item_id) for r in found if r.way == "latent"}
    assert len(latent) >= 0.9 * len(truth), "the latent search alone"


def test_paraphrases_need_their_answer(spark):
    rng = random.Random(6)
    rare = vocabulary(rng, 3000)
    items = [(i, " ".join(rng.choice(rare) for _ in range(60)), f"New  Harbour{i}." if i % 2 else "True") for i in range(200)]
    docs = []
    for d in range(100):
        words = items[d][1].split()
        kept = [w if rng.random() > 0.42 else rng.choice(rare) for w in words]
        docs.append((d, " ".join(kept) + (f". It is new harbour{d}" if d % 4 == 1 else " True")))
    found = leakage.find(
        spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text",
        spark.createDataFrame(items, "item_id int, text string, answer string"), "item_id", "text", "answer",
    ).collect()
    said = [r for r in found if r.kind == "paraphrase"]
    assert len(said) > 12 and all(r.doc_id == r.item_id and r.doc_id % 4 == 1 and r.answer_found and 0.5 <= r.share < 2 / 3 for r in said)
    assert all(r.share >= 2 / 3 or r.run >= 15 for r in found if r.kind != "paraphrase")


def test_leaks_odd_tables(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six")], "item_id bigint, text string")
    docs = evidence(spark, [*ODD, (20, None, None, "zero one two three four five six seven", None, None, None)])
    got = leakage.find(docs, "evidence_id", "text", items, "item_id", "text").collect()
    assert [(r.evidence_id, r.item_id, r.share) for r in got] == [(20, 3, 1.0)]
    assert leakage.find(docs, "evidence_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.find(docs.limit(0), "evidence_id", "text", items, "item_id", "text").count() == 0


# Problem 7


def test_water_filling():
    shares = {s.source: s for s in mixing.water_fill({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 10), "d": (0.0, 5)}, {"a": 100, "b": 100, "c": 100, "d": 9}, 300)}
    assert shares["a"].allotted == 100 and shares["a"].clamped and shares["b"].allotted == pytest.approx(120) and shares["c"].allotted == pytest.approx(80)
    assert (shares["b"].whole, round(shares["b"].rest)) == (1, 20) and shares["d"].allotted == 0
    assert sum(s.allotted for s in mixing.water_fill({"a": (1, 1)}, {"a": 5}, 100)) == 5
    assert mixing.water_fill({"a": (1.0, 3)}, {}, 100)[0].allotted == 0 and mixing.water_fill({}, {}) == []


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(1, 60), ["News", " news", "small", "tiny", "zero", None, "other"][min(i % 9, 6)]) for i in range(900)]
    docs += [(1000, None, "news"), (1001, "", "news")]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    targets = spark.createDataFrame([("news", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 1), ("zero", 0.0, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(df, "doc_id", "text", "source", targets)
    rows, caps = uses.collect(), {"news": 1, "small": 4, "tiny": 1, "zero": 3}
    assert len(rows) == len(docs) and all(0 <= r.times <= caps.get(r.source, 0) for r in rows)
    assert all(r.times == 0 for r in rows if r.source in (None, "zero", "other") or r.tokens == 0)
    shares = {r.source: r for r in report.collect()}
    assert shares["absent"].state == "no documents" and shares["other"].state == "no target" and shares["zero"].used_tokens == 0
    used = sum(r.tokens * r.times for r in rows)
    assert shares["small"].actual_share == pytest.approx(sum(r.tokens * r.times for r in rows if r.source == "small") / used)
    sized = mixing.sizes(df, "doc_id", "text", "source")
    for share in mixing.plan(sized, targets):
        if not share.clamped and share.allotted:
            assert abs(shares[share.source].used_tokens - share.allotted) <= 60
    again = mixing.mix(df.repartition(7), "doc_id", "text", "source", targets)[0]
    assert rows_of(again) == rows_of(uses)


def test_mix_odd_tables(spark):
    targets = spark.createDataFrame([("s", 1.0, 2), (None, 0.5, 1), ("s2", None, None)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(evidence(spark, ODD), "evidence_id", "text", "source", targets)
    assert uses.count() == len(ODD) and report.count() == 2
    uses, report = mixing.mix(evidence(spark, []), "evidence_id", "text", "source", targets)
    assert uses.count() == 0 and {r.state for r in report.collect()} == {"no documents", "target zero"}
    assert mixing.mix(evidence(spark, ODD), "evidence_id", "text", "source", targets.limit(0))[0].where("times > 0").count() == 0


# Problem 8

COMMON = [("en", w) for w in "the of and to in a is was for on that by with".split()]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("The bridge of the town was built in the year of the flood. It is a part of the old road to the coast.", ("prose",)),
        ("the bridge of the town was built in the year of the flood and it is a part of the road", ("prose",)),
        ("– The mill was sold to the town in 1900.\n– The school was built for the town.", ("prose",)),
        ("\n".join(f"{i}. annual bridge" for i in range(20)), ("list",)), ("\n".join(f"| town {i} | 19{i} |" for i in range(10, 30)), ("table",)),
        ("\n".join(f"a{i};{i};b;c" for i in range(20)), ("table",)), ("Home > Next > About > Login > Topics > Home > Prev", ("table", "junk", "list")),
        ("~#<|>$ @@ ^^ &&&& //// !! ||| " * 5, ("junk",)), ("strike tower " * 30, ("junk",)), ("0a1b2c3d4e5f\n" * 3 + "ffee00112233\n", ("junk",)),
        ("", ("empty",)), (" \n ", ("empty",)), (None, ("empty",)),
    ],
)
def test_kinds(text, kinds):
    bits = {w: 1 for _, w in COMMON}
    assert quality.measure_text(text, bits, 1)[-1] in kinds


def test_ends_of_padded_lines():
    assert quality.measure_text("The end of a line." + " " * 40 + "\nx", {"the": 1}, 1)[3] == 0.5


def test_repeated_prompts_are_boilerplate():
    bits = {w: 1 for w in WORDS}
    one = "Share this page with all of the friends. "
    five = [f"Click on the {w} to share this in the group of friends." for w in ("blue", "red", "green", "black", "white")]
    assert quality.measure_text(one * 100, bits, 1)[-1] == "boilerplate"
    assert quality.measure_text("\n".join(five * 40), bits, 1)[-1] == "boilerplate"
    assert quality.measure_text(five[0], bits, 1)[-1] == "prose"


def test_native_statistics_like_the_row_wise_ones(spark, data):
    words = spark.read.parquet(f"{data}/common_words.parquet")
    bits, languages = quality.common_bits(words)
    odd = [
        "\u00a0", " \u2003 x.\u2003\n\n“Of the…”)", "a\x1cb the\x85of", "é è ½ ²_#", "x" * 30 + "." + "'" * 30, "\x0b",
        "The THE (the) the.\nder die das", None, "",
    ]
    texts = odd + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert len(texts) == quality.measure(df, "text", words).count()
    for names, rows in ((quality.PLAIN, quality.statistics(df, "text", words)), (quality.JUDGED, quality.judged(df, "text", words))):
        for r in rows.collect():
            expected = dict(zip(quality.STATISTICS, quality.measure_text(texts[r.i], bits, languages), strict=True))
            assert {name: r[name] for name in names} == {name: expected[name] for name in names}, texts[r.i]


def test_statistics(spark, data):
    for name in ("p8_statistics", "p8_repetition"):
        assert rows_of(queries.queries()[name](spark, data)) == sql_rows(data, queries.oracle_sql()[name])
    words = spark.createDataFrame(COMMON, "lang string, word string")
    df = spark.createDataFrame([(1, "The end.\nThe end.\n\nA x", "c")], "doc_id int, text string, kind string")
    row = quality.measure(df, "text", words).collect()[0]
    assert (row.word_count, row.punctuated_line_share, row.common_word_share) == (6, 2 / 3, 3 / 6)
    assert row.duplicate_line_share == 8 / 19 and row.kind in ("prose", "list", "table", "junk")


def test_quality_odd_tables(spark):
    words = spark.createDataFrame([*COMMON, (None, "x"), ("en", None)], "lang string, word string")
    df = evidence(spark, ODD)
    assert quality.measure(df, "text", words).count() == len(ODD)
    assert quality.find(evidence(spark, []), "evidence_id", "text", words).count() == 0
    assert quality.measure(df, "text", words.limit(0)).where("kind = 'prose'").count() == 0
    counts = Counter(r.evidence_id for r in quality.find(df, "evidence_id", "text", words).collect())
    assert all(n == 1 for n in counts.values())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    assert queries.queries()[name](spark, data).count() >= 0


@pytest.mark.parametrize("name", ["p1_found", "p1_normalized", "p2_found", "p3_residue", "p3_evidence_kept", "p4_found", "p4_collapsed", "p5_found", "p5_cleaned", "p6_found"])
def test_same_results_without_broadcasts(spark, data, name, monkeypatch):
    from verisift.operators import joins

    whole = rows_of(queries.queries()[name](spark, data))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    assert rows_of(queries.queries()[name](spark, data)) == whole
