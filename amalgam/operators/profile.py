"""Column profiles over the whole table: one unpivot, two aggregations, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from amalgam.functions.text import utrim

TOP, HINT_SAMPLE, PATTERN_SAMPLE = 30, 50, 15

#: Forms that format hints test for.
EMAIL_LIKE = r"(?i)@[\w.\-]+\.[a-z]{2,}"
PHONE_LIKE = r"^\+?[\d\s\-().]{7,15}$"
DATE_LIKE = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}"
ZIP_LIKE = r"^\d{5}(-\d{4})?$"
DIGITS = r"^\d+$"
ALPHA = r"^[A-Za-z\s\-'.]+$"
ALNUM = r"^[A-Za-z0-9]+$"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def _kind(f) -> str:
    name = f.dataType.simpleString()
    return "text" if name == "string" else f"numeric ({name})"


def unpivoted(df: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """key, ord, field, value: a row a cell; nested values as JSON."""
    kinds = dict(df.dtypes)
    as_text = lambda c: F.to_json(F.col(f"`{c}`")) if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("field"), as_text(c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(key).alias("row_id"), F.inline(cells))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column from a single aggregation over the table: counts, nulls, lengths, digit texts, casing."""
    columns = columns or [c for c in df.columns if c != "row_id"]
    kinds = {f.name: _kind(f) for f in df.schema}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        t = utrim(x.cast("string"))
        aggregates += [F.count(x).alias(f"c{i}")]
        if kinds[c] == "text":
            aggregates += [F.min(F.length(t)).alias(f"lo{i}"), F.max(F.length(t)).alias(f"hi{i}"), F.avg(F.length(t)).alias(f"mean{i}"), F.avg(t.rlike(DIGITS).cast("double")).alias(f"d{i}"), F.coalesce(F.bool_or(F.lower(x) != x), F.lit(False)).alias(f"up{i}"), F.coalesce(F.bool_or(F.upper(x) != x), F.lit(False)).alias(f"down{i}"), F.count_if((F.lower(x) != x) & (F.upper(x) != x)).alias(f"mixed{i}")]
    one = df.agg(*aggregates)
    null = lambda kind: F.lit(None).cast(kind)
    cells = []
    for i, c in enumerate(columns):
        text = kinds[c] == "text"
        get = lambda name, kind: F.col(f"{name}{i}").cast(kind) if text else null(kind)  # noqa: E731, B023
        cells.append(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("field"), F.lit(kinds[c]).alias("dtype"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_present"), F.coalesce(get("lo", "int"), F.lit(0) if text else null("int")).alias("min_length"), F.coalesce(get("hi", "int"), F.lit(0) if text else null("int")).alias("max_length"), F.coalesce(get("mean", "double"), F.lit(0.0) if text else null("double")).alias("avg_length"), get("d", "double").alias("digit_share"), get("up", "boolean").alias("has_upper"), get("down", "boolean").alias("has_lower"), get("mixed", "long").alias("n_mixed")))
    return one.select(F.inline(F.array(*cells)))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """field, n_unique: exact, nulls not counted; values are pre-aggregated before the shuffle."""
    cells = unpivoted(df, columns).where("value IS NOT NULL")
    if approximate:
        return cells.groupBy("field").agg(F.approx_count_distinct("value").alias("n_unique"))
    return cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.count(F.lit(1)).alias("n_unique"))


def top_values(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """field, value, n, rank: the commonest non-blank trimmed values, ties by first row; two steps, so no field is one task."""
    cells = unpivoted(df, columns).withColumn("value", utrim(F.col("value"))).where("value <> ''")
    counts = cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_row"))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    some = salted.withColumn("rank", best(["field", "_salt"])).where(F.col("rank") <= k)
    return some.withColumn("rank", best(["field"])).where(F.col("rank") <= k).select("field", "value", "n", "rank")


def first_values(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """field, value, rank: the first distinct values of columns that are not text."""
    firsts = unpivoted(df, columns).where("value IS NOT NULL").groupBy("field", "value").agg(F.min("row_id").alias("first_row"))
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("first_row"))
    salted = firsts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    return salted.withColumn("rank", best(["field", "_salt"])).where(F.col("rank") <= k).withColumn("rank", best(["field"])).where(F.col("rank") <= k).select("field", "value", "rank")


def format_hint(sample: Column) -> Column:
    """A hint from an array of distinct non-blank texts, of which the first HINT_SAMPLE count."""
    s = F.slice(sample, 1, HINT_SAMPLE)
    n = F.size(s)
    share = lambda pattern: F.size(F.filter(s, lambda v: v.rlike(pattern))) / n
    lengths = F.transform(s, F.length)
    lo, hi = F.array_min(lengths).cast("string"), F.array_max(lengths).cast("string")
    sized = lambda name, unit: F.when(lo == hi, F.concat(F.lit(f"{name} fixed-length ("), lo, F.lit(f" {unit})"))).otherwise(F.concat(F.lit(f"{name} variable-length ("), lo, F.lit("–"), hi, F.lit(f" {unit})")))
    # digits become N and then every letter X, so N becomes X too
    patterns = F.transform(F.slice(s, 1, PATTERN_SAMPLE), lambda v: F.regexp_replace(F.regexp_replace(v, r"\d", "N"), "[A-Za-z]", "X"))
    kinds = F.array_distinct(patterns)
    counted = F.transform(kinds, lambda k: F.struct(F.size(F.filter(patterns, lambda p: p == k)).alias("n"), (-F.array_position(patterns, k)).alias("at"), k.alias("k")))
    top = F.array_max(counted)
    return (
        F.when(n == 0, "no samples").when(share(EMAIL_LIKE) > 0.7, "email address format").when(share(PHONE_LIKE) > 0.7, "phone number format")
        .when(share(DATE_LIKE) > 0.7, "date format").when(share(ZIP_LIKE) > 0.7, "US ZIP code format")
        .when(share(DIGITS) > 0.85, sized("all-digit", "digits")).when(share(ALPHA) > 0.85, sized("alphabetic", "chars")).when(share(ALNUM) > 0.75, sized("alphanumeric", "chars"))
        .when((top["n"] / F.size(patterns) > 0.55) & (F.size(kinds) <= 3), F.concat(F.lit("structured code, dominant pattern: "), top["k"]))
        .otherwise(F.concat(F.lit("mixed text ("), lo, F.lit("–"), hi, F.lit(" chars)")))
    )


def samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, sample_values: top values of text columns, first values of the others, in order."""
    texts = [c for c in columns if c in text_columns(df)]
    others = [c for c in columns if c not in texts]
    parts = [f(df, cs).select("field", "value", "rank") for f, cs in ((top_values, texts), (first_values, others)) if cs]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values"))


def profile(df: DataFrame, null_threshold: float = 0.8, approximate: bool = False) -> DataFrame:
    """The full profile; columns with a larger share of nulls than the threshold are left out.

    With `approximate`, distinct values are estimated by sketches, so no cell is shuffled for them.
    """
    columns = [c for c in df.columns if c != "row_id"]
    stats = column_stats(df, columns)
    out = stats.join(F.broadcast(distinct_counts(df, columns, approximate)), "field", "left").join(F.broadcast(samples(df, columns)), "field", "left")  # a row a column
    rows = F.greatest(F.col("n_rows"), F.lit(1))
    out = out.withColumns({"n_unique": F.coalesce("n_unique", F.lit(0)), "p_missing": F.round((F.col("n_rows") - F.col("n_present")) / rows, 4), "sample_values": F.coalesce("sample_values", F.array().cast("array<string>"))})
    out = out.withColumn("p_unique", F.round(F.col("n_unique") / rows, 4)).where(F.col("p_missing") <= null_threshold)
    text = F.col("dtype") == "text"
    return out.select("field", "dtype", "n_rows", "n_unique", "p_unique", "p_missing", (F.col("p_unique") >= 0.9).alias("is_high_cardinality"), "min_length", "max_length", F.round("avg_length", 1).alias("avg_length"), F.coalesce(F.col("digit_share") > 0.85, F.lit(False)).alias("is_numeric_string"), F.when(text, format_hint(F.col("sample_values"))).alias("format_hint"), "sample_values")


def quick_profile(df: DataFrame) -> DataFrame:
    """field, dtype, null_pct, unique_pct, issues, has_issues."""
    columns = [c for c in df.columns if c != "row_id"]
    out = column_stats(df, columns).join(F.broadcast(distinct_counts(df, columns)), "field", "left")
    rows = F.greatest(F.col("n_rows"), F.lit(1))
    null_pct = F.round((F.col("n_rows") - F.col("n_present")) / rows * 100, 1)
    nulls = F.when(null_pct > 5, F.concat(F.lit("High nulls ("), null_pct.cast("string"), F.lit("%)")))
    casing = F.when(F.col("has_upper") & F.col("has_lower"), "Mixed casing")
    issues = F.concat_ws(", ", nulls, casing)
    return out.select("field", "dtype", null_pct.alias("null_pct"), F.round(F.coalesce("n_unique", F.lit(0)) / rows * 100, 1).alias("unique_pct"), F.when(issues == "", "Clean").otherwise(issues).alias("issues"), (issues != "").alias("has_issues"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, columns, completeness in percent, columns with issues."""
    q = quick_profile(df)
    nulls = column_stats(df).agg(F.round((1 - F.avg((F.col("n_rows") - F.col("n_present")) / F.greatest(F.col("n_rows"), F.lit(1)))) * 100, 1).alias("completeness"), F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))
    return nulls.crossJoin(F.broadcast(q.agg(F.count_if("has_issues").alias("n_issues"))))


#: Parts of column names that call for a fix.
SUGGESTIONS = (
    (("phone", "mobile", "fax", "tel"), "Normalise to E.164 format"),
    (("first", "last", "name", "middle"), "Standardise casing (Title Case)"),
    (("email", "mail"), "Flag invalid email addresses"),
    (("dob", "birth", "date"), "Standardise to ISO 8601 (YYYY-MM-DD)"),
    (("address", "street", "addr"), "Expand abbreviations (St→Street, Ave→Avenue)"),
)


def suggest_fixes(df: DataFrame) -> DataFrame:
    """field, fix, records: fixes that the names of text columns call for, counted over the whole table."""
    counts = {0: lambda x: F.count(x), 1: lambda x: F.count_if((F.lower(x) != x) & (F.upper(x) != x)), 2: lambda x: F.count_if(~x.rlike(r"^[^@]+@[^@]+\.[^@]+$")), 3: lambda x: F.count(x), 4: lambda x: F.floor(F.count(x) * 0.15)}
    wanted = [(c, i) for c in text_columns(df) for i, (parts, _) in enumerate(SUGGESTIONS) if any(p in c.lower() for p in parts)]
    schema = "field string, fix string, records long"
    none = df.sparkSession.createDataFrame([("—", "No critical issues detected", 0)], schema)
    if not wanted:
        return none
    one = df.agg(*[counts[i](F.col(f"`{c}`")).cast("long").alias(f"n{j}") for j, (c, i) in enumerate(wanted)])
    cells = [F.struct(F.lit(c).alias("field"), F.lit(SUGGESTIONS[i][1]).alias("fix"), F.col(f"n{j}").alias("records"), F.lit(i in (1, 2)).alias("_some")) for j, (c, i) in enumerate(wanted)]
    found = one.select(F.inline(F.array(*cells))).where("records > 0 OR NOT _some").drop("_some")
    return found.unionByName(none.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 0).drop("n"))


def fix_totals(suggestions: DataFrame) -> DataFrame:
    """One row: how many fixes are suggested, and how many records they touch in all."""
    real = suggestions.where("records > 0 OR field <> '—'")
    return real.agg(F.count(F.lit(1)).alias("n_fixes"), F.coalesce(F.sum("records"), F.lit(0)).alias("n_records"))
