"""Data quality: column profiles, duplicates, consistency checks, cleaning effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import is_percent_encoded, normalize_handle, normalize_key

#: Classes of text columns in order; all values must match the expression (fixed names).
KINDS = (
    ("entero", r"^-?\d+$"), ("decimal", r"^-?\d+\.\d+$"), ("booleano", r"(?i)^(true|false)$"), ("fecha_iso8601", r"^\d{4}-\d{2}-\d{2}T"),
    ("lista_serializada", r"^\s*\["), ("tiempo_relativo", r"^\s*hace "), ("conteo_como_texto", r"^[\d,\. ]+ ?(vistas|views)?$"),
)


def profile(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a column: 16 measures of nulls, blanks, distinct values, kind and key role.

    The table is read once; counts of distinct values are exact.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").cast("string").alias("v")) for i, (c, t) in enumerate(df.dtypes)]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    v, text = F.col("v"), F.trim(F.col("v"))
    solid = F.when(text != "", text)
    per = long.groupBy("position", "column", "type", "v").agg(F.count("*").alias("m"))
    kinds = [F.min(F.when(solid.isNotNull(), solid.rlike(p))).alias(k) for k, p in KINDS]
    out = per.groupBy("position", "column", "type").agg(
        F.sum("m").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNull(), F.col("m"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(text == "", F.col("m"))), F.lit(0)).alias("n_blank"), F.count(v).alias("n_unique"),
        F.count(solid).alias("n_solid"), F.min(v).alias("example"), *kinds,
    )
    kind = F.when(F.col("n_rows") == F.col("n_null"), "vacia").when(F.col("n_solid") == 0, "solo_espacios")
    for k, _ in KINDS:
        kind = kind.when(F.col(k), k)
    pct = lambda c: F.round(100 * F.col(c) / F.col("n_rows"), 2)
    unique = (F.col("n_unique") == F.col("n_rows")) & (F.col("n_null") == 0)
    return out.select(
        F.lit(name).alias("dataset"), "column", "type", "n_rows", "n_null", pct("n_null").alias("pct_null"), "n_blank", pct("n_blank").alias("pct_blank"), "n_unique",
        F.round(F.col("n_unique") / F.col("n_rows"), 4).alias("relative_cardinality"), (F.col("n_unique") <= 1).alias("constant"),
        (F.col("n_unique") == 0).alias("empty"), unique.alias("unique_values"), F.col("column").isin(*keys, "").alias("declared_key"),
        (unique & F.col("column").isin(*keys, "")).alias("primary_key"), kind.otherwise("texto").alias("kind"),
        F.when(F.length("example") > 80, F.concat(F.substring("example", 1, 80), F.lit("..."))).otherwise(F.col("example")).alias("example"),
    )


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their kind: of whole rows and of each key; nulls equal one another."""
    out = None
    for what, cols in [("row", df.columns), *((k, [k]) for k in keys)]:
        one = df.groupBy(*cols).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n_duplicates"))
        one = one.select(F.lit(name).alias("dataset"), F.lit(what).alias("by"), "n_rows", "n_duplicates")
        out = one if out is None else out.unionByName(one)
    return out


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: most b of an a, most a of a b, and whether both are one."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    most = lambda k: pairs.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(f"most_{k}"))
    both = most("a").crossJoin(most("b"))  # two single rows
    ok = (F.col("most_a") <= 1) & (F.col("most_b") <= 1)
    return both.select(F.lit(f"{a} <-> {b}").alias("check"), F.greatest(F.col("most_a") - 1, F.lit(0)).alias("violations_a"), F.greatest(F.col("most_b") - 1, F.lit(0)).alias("violations_b"), ok.alias("ok"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a check: rows for which it is true are violations; all checks in one pass."""
    # Columns first: an aggregate takes no JVM method calls, which some checks make.
    hit = df.select(*(F.when(c, 1).alias(f"c{i}") for i, c in enumerate(checks.values())))
    counts = hit.agg(*(F.count(c).alias(c) for c in hit.columns))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(checks)))
    return counts.select(F.explode(rows).alias("r")).select("r.check", "r.violations", (F.col("r.violations") == 0).alias("ok"))


def differs(a: str, b: str) -> Column:
    """Two columns differ, null as empty text."""
    return F.coalesce(F.col(a).cast("string"), F.lit("")) != F.coalesce(F.col(b).cast("string"), F.lit(""))


def differs_by_key(a: str, b: str) -> Column:
    """Two labels differ in their comparison keys."""
    return normalize_key(F.col(a).cast("string")) != normalize_key(F.col(b).cast("string"))


def lacks(whole: str, part: str) -> Column:
    """A text doesn't contain another column's text."""
    return ~F.coalesce(F.col(whole).cast("string").contains(F.col(part).cast("string")), F.lit(False))


def encoded(column: str) -> Column:
    """A handle with percent escapes."""
    return is_percent_encoded(F.col(column))


def handles_differ(a: str, b: str) -> Column:
    """Two handles differ after decoding."""
    return normalize_handle(F.col(a)) != normalize_handle(F.col(b))
