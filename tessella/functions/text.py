"""Text extraction and cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import emoji
from tessella.functions.ids import SPACE, chosen, folded, is_wide, normalize_key, strip

URL = r"(?i)(?:https?://|www\.)\S+"
HASHTAG = r"(?U)#(\w+)"
MENTION = r"(?U)@([\w.\-]+)"
SHORTCODE = r"(?i):[a-z0-9]+(?:[_-][a-z0-9]+)*:"
#: Pictographs, with skin tones, variation selectors and joined sequences.
_ONE = r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}](?:[\x{1F3FB}-\x{1F3FF}]|\x{FE0F})*)"
EMOJI = rf"{_ONE}(?:\x{{200D}}{_ONE})*"
#: Conversational words that carry no topic, beside a language's stop words (fixed values).
DOMAIN_STOPWORDS = (
    "q", "x", "d", "k", "pq", "xq", "ke", "tb", "tmb", "jaja", "jajaja",
    "jajajaja", "jeje", "jjj", "aja", "eh", "ah", "oh", "uy", "ay", "si",
    "no", "ya", "va", "van", "ser", "sido", "hacer", "haciendo", "hace",
    "dice", "dijo", "decir", "solo", "solamente", "tan", "mas", "muy",
    "asi", "aqui", "alla", "ahi", "hoy", "ayer", "manana", "vez", "veces",
    "gente", "cosa", "cosas", "the", "and", "you", "for", "que", "gracias",
)


def stopwords(spark, language: str = "spanish") -> list[str]:
    """Spark's own list of a language and the domain's words, compared without accents."""
    own = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords(language)
    words = spark.createDataFrame([(w,) for w in [*own, *DOMAIN_STOPWORDS]], "w string")
    return sorted(r[0] for r in words.select(normalize_key(F.col("w"))).distinct().collect())  # a fixed list


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def extract_urls(text: Column) -> Column:
    """Links."""
    return _all(text, URL)


def extract_hashtags(text: Column) -> Column:
    """Hashtags, lower case, without the sign."""
    return F.transform(_all(text, HASHTAG, 1), F.lower)


def extract_mentions(text: Column) -> Column:
    """Mentions, lower case, without the sign and dots at the end."""
    return F.transform(_all(text, MENTION, 1), lambda x: F.regexp_replace(F.lower(x), r"\.+$", ""))


def extract_emojis(text: Column) -> Column:
    """Emoji sequences."""
    return _all(text, EMOJI)


def extract_shortcodes(text: Column) -> Column:
    """Emoji names between colons."""
    return _all(text, SHORTCODE)


def tokens(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def content_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Topic words of a text, in the order of the cleaning steps.

    Links, shortcodes and mentions go, hashtags leave their word, emoji go, runs of three or more
    of a character become two, then the comparison key, punctuation and underscores as spaces, and
    of the words those that are numbers, shorter than three characters or stop words go.
    """
    has = lambda sign: lambda x: x.contains(sign)
    put = lambda pattern, by: lambda x: F.regexp_replace(x, pattern, by)
    # A text is searched only for what it can hold: signs and wide characters are cheap to look for.
    out = F.regexp_replace(F.coalesce(text, F.lit("")), URL, " ")
    out = chosen(chosen(out, has(":"), put(SHORTCODE, " ")), has("@"), put(MENTION, " "))
    out = chosen(chosen(out, has("#"), put(HASHTAG, " $1 ")), is_wide, put(EMOJI, " "))
    out = folded(F.regexp_replace(out, r"(?s)(.)\1{2,}", "$1$1"))
    number = lambda x: (x < ":") & x.rlike(r"^[0-9]+$")
    words = F.filter(tokens(F.regexp_replace(out, r"(?U)[^\w\s]|_", " ")), lambda x: (F.length(x) > 2) & ~number(x))
    return _without(words, stop) if stop else words


def _without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda x: ~x.isin(stop))


def without_stopwords(words: Column, language: Column, lists: dict[str, list[str]]) -> Column:
    """Words less the stop words of their text's language; languages that ``lists`` lacks keep all."""
    out = words
    for name, stop in lists.items():
        out = F.when(language == name, _without(words, stop)).otherwise(out)
    return out


def clean_text(text: Column, stop: list[str] | None = None, lemmas: Column | None = None) -> Column:
    """A struct of the clean text and of what was taken out.

    ``lemmas`` is a map from word to lemma; words that it lacks stay as they are, and without it
    the clean text has the words themselves.
    """
    words = content_tokens(text, stop)
    base = words
    if lemmas is not None:
        base = F.filter(F.transform(words, lambda w: F.coalesce(F.element_at(lemmas, w), w)), lambda x: F.length(x) > 2)
        base = _without(base, stop) if stop else base
    return F.struct(
        F.array_join(base, " ").alias("clean"),
        F.array_join(words, " ").alias("unlemmatised"),
        extract_hashtags(text).alias("hashtags"),
        extract_mentions(text).alias("mentions"),
        extract_urls(text).alias("urls"),
        extract_emojis(text).alias("emojis"),
        extract_shortcodes(text).alias("shortcodes"),
    )


def model_text(text: Column, names: Column | emoji.Table | None = None) -> Column:
    """A text as the classifier expects it: case and punctuation kept.

    Links become ``url``, mentions ``@usuario``, hashtags their word, laughs ``jaja``, runs of
    three or more of a character three. ``names`` is a table of emoji (:mod:`.emoji`), found by
    longest match, or a small map from emoji to its name; names are put between ``emoji`` words, with
    spaces for underscores, and emoji that ``names`` lacks are left in place.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), URL, "url")
    out = F.regexp_replace(F.regexp_replace(out, MENTION, "@usuario"), HASHTAG, "$1")
    out = F.regexp_replace(out, r"(?iU)\b[jha]{4,}\b", "jaja")
    out = F.regexp_replace(out, r"(?s)(.)\1{2,}", "$1$1$1")
    if isinstance(names, emoji.Table):
        out = emoji.named(out, emoji.Table({k: v.replace("_", " ") for k, v in names.names.items()}, names.pattern))
    elif names is not None:
        found = F.array_distinct(extract_emojis(out))
        named = lambda e: F.replace(F.element_at(names, e), F.lit("_"), F.lit(" "))
        put = lambda acc, e: F.replace(acc, e, F.coalesce(F.concat(F.lit(" emoji "), named(e), F.lit(" emoji ")), e))
        out = F.aggregate(found, out, put)
    return strip(F.regexp_replace(out, SPACE, " "))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    if n == 2:  # neighbours of two slices; no slice a pair
        upto = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, 1, upto), F.slice(words, 2, upto), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(upto > 0, pairs).otherwise(F.array().cast("array<string>"))
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def code_points(text: Column) -> Column:
    """Characters as ``U+`` code points, for reports on emoji."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(F.lit("U+"), F.upper(F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0"))))), " ")
