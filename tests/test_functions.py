"""Truth tables of identifiers, counts, relative time and text cleaning."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import ids, reltime
from tessella.functions import text as T


def one(spark, column, *values):
    """The values of a column expression over a column ``s``."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in sorted(rows.select("i", column).collect())]


COUNTS = {
    "7": 7, " 640 ": 640, "5,204 clicks": 5204, "9.876.543": 9876543, "12 345 678": 12345678, "8K": 8000, "4.75M vistas": 4750000, "6B": 6e9,
    "3,25 mil": 3250, "9 millones": 9e6, "2.5 millon": 2.5e6, "4kk": 4, "7.5": 75, None: None, "": None, "\t": None, "--": None, "none": None, "K": None,
}


def test_parse_count(spark):
    assert one(spark, ids.parse_count(F.col("s")), *COUNTS) == list(COUNTS.values())


def test_parse_count_of_other_scripts(spark):
    counts = {"１２，５００": 12500, "٤٢": 42, "३.५K": 3500, "1\u202f234 vues": 1234, "7\u00a0mil": 7000, "12ñ": None, "½": 1, "①②": 12, "３ｋ": 3000}
    assert one(spark, ids.parse_count(F.col("s")), *counts) == list(counts.values())
    assert one(spark, ids.parse_count(F.col("s"), unicode=False), "١", "9K") == [None, 9000]


def test_stopwords_of_each_language(spark):
    rows = spark.createDataFrame([(1, "x", ["the", "cat", "und"]), (2, "y", ["the", "cat", "und"]), (3, "z", ["the"]), (4, None, ["cat"])], "i int, lang string, w array<string>")
    got = rows.select("i", T.without_stopwords(F.col("w"), F.col("lang"), {"x": ["the"], "y": ["und", "cat"]})).collect()
    assert [r[1] for r in sorted(got)] == [["cat", "und"], ["the"], ["the"], ["cat"]]


def test_ids_and_labels(spark):
    assert one(spark, ids.normalize_id(F.col("s")), None, "nan", "NaN", " Ab ") == ["", "", "", "Ab"]
    assert one(spark, ids.normalize_id(F.col("s"), unicode=True), "ﬁ①") == ["fi1"]
    assert one(spark, ids.normalize_display(F.col("s")), " Á  b\t c ") == ["Á b c"]
    assert one(spark, ids.normalize_key(F.col("s")), "Ñu  Ölé", "GROSS", "groß") == ["nu ole", "gross", "gross"]


def test_handles(spark):
    cases = {"/@river": "@river", "river/about": "@river", "@river": "@river", "/%40ni%C3%B1a": "@niña", "x+y": "@x+y", "50%": "@50%", " /@sea/a/b": "@sea", "nan": "", "": "", None: ""}
    assert one(spark, ids.normalize_handle(F.col("s")), *cases) == list(cases.values())


def test_tri_state(spark):
    assert one(spark, ids.tri_state(F.col("s")), "True", "false", "yes", "t", None) == [True, False, None, None, None]


def test_relative_time(spark):
    cases = {"hace 9 dias": (9.0, "1 sem - 1 mes"), "HACE 4 Meses": (121.76, "1 mes - 1 ano"), "hace 13 meses (editado)": (395.72, "1 - 2 anos"), "hace 8 años": (2922.0, ">2 anos"), "hace 30 minutos": (0.021, "<1 semana"), "pronto": (None, "desconocido"), None: (None, "desconocido")}
    assert one(spark, reltime.relative_days(F.col("s")), *cases) == [x for x, _ in cases.values()]
    assert one(spark, reltime.relative_bucket(F.col("s")), *cases) == [x for _, x in cases.values()]


def test_extraction(spark):
    text = "Mira #Niño_1 y @Juan.Perez. en https://x.y/z?q=1 o WWW.a.b 😡👍🏽 :face-blue-smiling:"
    assert one(spark, T.extract_hashtags(F.col("s")), text) == [["niño_1"]]
    assert one(spark, T.extract_mentions(F.col("s")), text) == [["juan.perez"]]
    assert one(spark, T.extract_urls(F.col("s")), text) == [["https://x.y/z?q=1", "WWW.a.b"]]
    assert one(spark, T.extract_emojis(F.col("s")), text) == [["😡", "👍🏽"]]
    assert one(spark, T.extract_shortcodes(F.col("s")), text) == [[":face-blue-smiling:"]]


def test_cleaning(spark):
    got = one(spark, T.clean_text(F.col("s")), "@ana Holaaaa #Música, 1,5 veces 😡 http://a.b :hand-red: ÑANDÚ_grande!!")[0]
    assert got["clean"] == "holaa musica veces nandu grande" and got["mentions"] == ["ana"]
    for bad in (None, "", "   ", "!!!", "😡", "12 3", "x"):
        assert one(spark, T.clean_text(F.col("s")), bad)[0]["clean"] == ""


def test_stopwords_and_lemmas(spark):
    stop = T.stopwords(spark)
    assert {"mas", "jaja", "para"} <= set(stop)
    lemmas = F.create_map(F.lit("casas"), F.lit("casa"))
    got = one(spark, T.clean_text(F.col("s"), stop, lemmas), "las casas para todos gracias")[0]
    assert "casa" in got["clean"].split() and "gracias" not in got["clean"]


def test_model_text(spark):
    names = F.create_map(F.lit("😡"), F.lit("cara_enfadada"))
    got = one(spark, T.model_text(F.col("s"), names), "No!! @ana vea https://a.b #Hola jajajajaja buenoooo 😡")[0]
    assert got == "No!! @usuario vea url Hola jaja buenooo emoji cara enfadada emoji"


@pytest.mark.parametrize(("n", "want"), [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (4, [])])
def test_ngrams(spark, n, want):
    assert one(spark, T.ngrams(F.split("s", " "), n), "a b c") == [want]
