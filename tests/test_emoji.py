"""Emoji sequences against a plain longest-match search."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import emoji
from tessella.functions import text as T

WOMAN, GIRL, HEART = "👩", "👧", "❤️"
TABLE = {
    "👍": "thumb", "👍🏽": "thumb medium", WOMAN: "woman", GIRL: "girl", emoji.joined(WOMAN, GIRL): "family", emoji.joined(WOMAN, HEART, GIRL): "couple", HEART: "heart",
    "3️⃣": "keycap 3", "🇫🇷": "flag fr", "🇷🇪": "flag re", "🏴": "black flag", emoji.region_flag("gbsct"): "scotland", "☕": "cup_of tea",
}


def by_search(text, names):
    """Left to right, the longest entry that starts at each place."""
    out, i = [], 0
    while i < len(text):
        best = max((s for s in names if text.startswith(s, i)), key=len, default=None)
        out.append((best or text[i], best))
        i += len(best or text[i])
    return out


def cases():
    rng = random.Random(3)
    parts = [*TABLE, *emoji.with_forms(TABLE), "‍", "️", "🇫", "🇷", "🏽", "3", "a", " ", "\U000e0067", "\n"]
    return ["", "plain 3 words", emoji.region_flag("gbwls"), *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300))]


def test_sequences_equal_search(spark):
    t = emoji.table(TABLE)
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*cases(), None])], "i int, s string")
    got = df.select("i", emoji.found(F.col("s"), t).alias("f"), emoji.named(F.col("s"), t, "<", ">").alias("n"), emoji.names_of(emoji.found(F.col("s"), t), t).alias("m")).collect()
    for r in got:
        parts = by_search(([*cases(), None][r["i"]]) or "", t.names)
        assert r["f"] == [s for _, s in parts if s]
        assert r["m"] == [t.names[s] for _, s in parts if s]
        assert r["n"] == "".join(f"<{t.names[s]}>" if s else raw for raw, s in parts)


def test_table_without_entries(spark):
    df = spark.createDataFrame([("a👍",)], "s string")
    t = emoji.table({})
    assert df.select(emoji.found(F.col("s"), t), emoji.named(F.col("s"), t)).first() == ([], "a👍")


def test_characters_by_rule(spark):
    t = emoji.table(emoji.characters() | {emoji.joined(WOMAN, GIRL): "family"})
    text = "x 👍🏽👩‍👧 ☕ 5️⃣ 🇩🇪🇫🇷 ❤️❤ 7 #"
    got = spark.createDataFrame([(text,)], "s string").select(emoji.names_of(emoji.found(F.col("s"), t), t)).first()[0]
    assert got == ["thumbs up sign fitzpatrick type-4", "family", "hot beverage", "keycap 5", "flag de", "flag fr", "heavy black heart", "heavy black heart"]


@pytest.mark.parametrize(("text", "want"), [("ok👍🏽!!", "ok emoji thumb medium emoji !!"), ("☕", "emoji cup of tea emoji"), (None, "")])
def test_model_text_with_a_table(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(T.model_text(F.col("s"), emoji.table(TABLE))).first()[0] == want
