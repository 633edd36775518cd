"""The 15 player-key cases, as a DataFrame test, plus accent handling."""

import sys
import unicodedata

from rinkspark import functions as RF

# Name, position and the key they must give.
CASES = [
    ("A. Lee", "Left Wing", "alee-L"),
    ("Connor McDavid", "Center", "cmcdavid-C"),
    ("Igor Shesterkin", "Goalie", "ishesterkin-G"),
    ("Cale Makar", "Defense", "cmakar-D"),
    ("Jean-Gabriel Pageau", "Center", "jpageau-C"),
    ("Pierre-Luc Dubois", "Center", "pdubois-C"),
    ("J.T. Miller", "Center", "jmiller-C"),
    ("Sébastien Aho", "Center", "saho-C"),
    ("Artturi Lehkonen", "Right Wing", "alehkonen-R"),
    ("Kieffer Bellows Jr.", "Left Wing", "kjr-L"),
    ("Kieffer Bellows", "Left Wing", "kbellows-L"),
    ("Nico", "Center", "nico-C"),
    ("", "", ""),
    ("Player Name", "", ""),
    ("", "Position", ""),
]


def test_player_key_cases(spark):
    df = spark.createDataFrame(CASES, "name string, position string, expected string")
    got = df.select("expected", RF.player_key("name", "position").alias("key")).collect()
    assert [r.key for r in got] == [r.expected for r in got]


def test_null_inputs_give_empty_key(spark):
    df = spark.createDataFrame([(None, "Center"), ("Nico", None)], "name string, position string")
    assert [r[0] for r in df.select(RF.player_key("name", "position")).collect()] == ["", ""]


def test_strip_accents(spark):
    rows = [("Sébastien",), ("Jiří Hrdina",), ("Ærø ﬁn",), ("é",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(RF.strip_accents("s")).collect()]
    assert got == ["Sebastien", "Jiri Hrdina", "Ærø fin", "e", ""]


def test_strip_accents_equals_the_unicode_database(spark):
    """All assigned code points, alone and in strings of 40."""
    chars = [chr(cp) for cp in range(1, sys.maxunicode + 1) if unicodedata.category(chr(cp)) not in ("Cn", "Cs")]
    rows = [*chars, *("".join(chars[i : i + 40]) for i in range(0, len(chars), 40))]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    for r in df.select("s", RF.strip_accents("s").alias("got")).toLocalIterator():
        assert r.got == "".join(x for x in unicodedata.normalize("NFKD", r.s) if not unicodedata.combining(x)), ascii(r.s)


def test_name_form_of_multi_letter_forms(spark):
    rows = [("Ǆon Múller", "dmuller"), ("김 연아", "ᄀ연아"), ("ﬁn", "fin"), ("\u0301\u0301 Lee", "lee")]
    df = spark.createDataFrame(rows, "s string, expected string")
    for r in df.select("expected", RF.name_form("s").alias("got")).collect():
        assert r.got == unicodedata.normalize("NFKD", r.expected)


def test_clean_name(spark):
    df = spark.createDataFrame([("  J.T.  Miller-Smith ",), ("P.K. Subban",)], "s string")
    assert [r[0] for r in df.select(RF.clean_name("s")).collect()] == ["j t miller smith", "p k subban"]


def test_name_form_single_word_keeps_accents_stripped(spark):
    df = spark.createDataFrame([("Éric",)], "s string")
    assert df.select(RF.name_form("s")).first()[0] == "eric"
