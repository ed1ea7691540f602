"""Identifiers, labels and counts as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes of abbreviated counts and their factors (fixed values); others count once.
MULTIPLIERS = {"k": 1_000, "mil": 1_000, "m": 1_000_000, "millon": 1_000_000, "millones": 1_000_000, "mill": 1_000_000, "b": 1_000_000_000}
#: An abbreviated count: digits with separators, then a suffix (fixed pattern).
COUNT = "(?iU)^\\s*([0-9]+(?:[.,\\s  ][0-9]{3})*(?:[.,][0-9]+)?)\\s*(k|m|b|mil|millones|millon|mill|kk)?\\b"
SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _plain_digits(s: pd.Series) -> pd.Series:
    """Compatibility form, with the decimal digits of any script as ASCII."""
    plain = lambda x: "".join(str(unicodedata.decimal(c, c)) for c in unicodedata.normalize("NFKC", x))
    return s.map(lambda x: None if x is None else plain(x))


def nfkc(text: Column, unicode: bool = True) -> Column:
    """Compatibility form. ASCII texts are already in it; ``unicode=False`` leaves out the UDF."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_compatible(text)) if unicode else text


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_id(text: Column, unicode: bool = True) -> Column:
    """An id: compatibility form, stripped, case kept; null and ``nan`` are empty."""
    out = strip(nfkc(F.coalesce(text, F.lit("")), unicode))
    return F.when(F.lower(out) == "nan", "").otherwise(out)


def normalize_display(text: Column, unicode: bool = True) -> Column:
    """A label: as an id, with runs of white space as one space; case and accents kept."""
    return F.regexp_replace(normalize_id(text, unicode), SPACE, " ")


def chosen(value: Column, holds: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a value where ``holds`` is true of it, else the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: F.when(holds(x), then(x)).otherwise(x)), 1)


def is_wide(text: Column) -> Column:
    """Whether a text has characters beyond ASCII."""
    return F.octet_length(text) > F.length(text)


def folded(text: Column) -> Column:
    """Lower case (sharp s as ss), without accents; a null is empty."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    bare = lambda x: F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), x)
    return chosen(low, is_wide, bare)


def normalize_key(text: Column) -> Column:
    """A comparison key: lower case (sharp s as ss), no accents, one space between words."""
    return F.regexp_replace(strip(folded(text)), SPACE, " ")


def is_percent_encoded(text: Column) -> Column:
    """Whether a percent escape occurs."""
    return F.coalesce(text.rlike("%[0-9A-Fa-f]{2}"), F.lit(False))


def normalize_handle(text: Column, unicode: bool = True) -> Column:
    """A handle: percent escapes decoded, slashes in front and all after the next one dropped, one @."""
    own = normalize_id(text, unicode)
    # + stays as it is, and malformed escapes leave the text alone.
    decoded = F.coalesce(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), own)
    plain = F.when(is_percent_encoded(own), nfkc(decoded, unicode)).otherwise(own)
    name = strip(F.split_part(F.regexp_replace(plain, "^/+", ""), F.lit("/"), F.lit(1)))
    return F.when(name == "", "").when(name.startswith("@"), name).otherwise(F.concat(F.lit("@"), name))


def parse_count(text: Column, unicode: bool = True) -> Column:
    """A written count as a number; null, never zero, if it can't be read.

    Compatibility forms and digits of other scripts count as their plain ones; ``unicode=False``
    leaves that out, and with it the UDF, which ASCII texts never meet. With a suffix the last separator is a decimal point; without one all separators group
    thousands, so ``1.5`` is 15. The suffix ``kk`` counts once.
    """
    if unicode:
        text = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_plain_digits(text))
    digits, suffix = F.regexp_extract(text, COUNT, 1), F.lower(F.regexp_extract(text, COUNT, 2))
    bare = F.regexp_replace(digits, "[\\s  ]", "")
    grouped = F.regexp_replace(bare, "[.,]", "")
    point = F.regexp_replace(bare, r"[.,](?=.*[.,])", "")
    decimal = F.replace(point, F.lit(","), F.lit("."))
    number = F.when(suffix == "", grouped).otherwise(decimal)
    factor = F.lit(1)
    for name, value in MULTIPLIERS.items():
        factor = F.when(suffix == name, F.lit(value)).otherwise(factor)
    return F.when(digits != "", number.try_cast("double") * factor)


def is_blank(text: Column) -> Column:
    """A count that is left out: white space alone; null is unknown, not blank."""
    return F.coalesce(strip(text) == "", F.lit(False))


def imputed_count(text: Column) -> Column:
    """A written count, with zero for a blank one: counters are left out where they are zero."""
    return F.when(is_blank(text), F.lit(0.0)).otherwise(parse_count(text))


def tri_state(text: Column) -> Column:
    """True and False as written, or lower-cased; anything else is null."""
    return F.when(text.isin("True", "true"), True).when(text.isin("False", "false"), False)
