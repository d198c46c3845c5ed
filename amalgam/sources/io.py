"""Sources and sinks: files to records with a row_id, records and documents to files, a result cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.graph import staged

#: Texts that mean null in CSV files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: Forms of whole and decimal numbers in CSV files; codes with leading zeros are neither and stay text.
_WHOLE, _DECIMAL = r"^\s*[+-]?(0|[1-9]\d{0,17})\s*$", r"^\s*[+-]?((0|[1-9]\d*)(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\s*$"
#: How the names of JSON columns that hold dates begin and end.
DATE_STARTS, DATE_ENDS = ("timestamp", "modified", "date"), ("_at", "_time")


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Does any line hold an odd number of quotes? Doubled quotes are even, so then a quoted value spans lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def typed(df: DataFrame) -> DataFrame:
    """Text columns whose present values are all whole numbers, all numbers or all truth values get that type.

    One aggregation over the table. Whole numbers with missing ones among them become doubles; dates stay text.
    """
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not texts:
        return df
    q = lambda c: F.col(f"`{c}`")
    tests = [(f"n{i}", F.count(q(c))) for i, c in enumerate(texts)] + [("n", F.count(F.lit(1)))]
    for i, c in enumerate(texts):
        tests += [(f"w{i}", F.bool_and(q(c).rlike(_WHOLE))), (f"d{i}", F.bool_and(F.lower(q(c)).rlike(_DECIMAL) | q(c).rlike(_WHOLE))), (f"b{i}", F.bool_and(F.lower(q(c)).isin("true", "false")))]
    facts = df.agg(*[t.alias(n) for n, t in tests]).first()
    kind = {}
    for i, c in enumerate(texts):
        if facts[f"n{i}"]:
            kind[c] = "long" if facts[f"w{i}"] and facts[f"n{i}"] == facts["n"] else "double" if facts[f"w{i}"] or facts[f"d{i}"] else "boolean" if facts[f"b{i}"] and facts[f"n{i}"] == facts["n"] else None
    return df.select(*[F.trim(q(c)).cast(kind[c]).alias(c) if kind.get(c) else q(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, infer: bool = False, multi_line: bool | None = None) -> DataFrame:
    """All columns as text, missing-value tokens as null; with `infer`, typed().

    Values in quotes may hold line breaks. Such files cannot be split, so unless `multi_line` says it, a pass
    over the lines finds out whether there are any.
    """
    whole = _breaks_in_quotes(spark, path) if multi_line is None else multi_line
    df = spark.read.csv(path, header=True, multiLine=whole, escape='"')
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return typed(df) if infer else df


def _a_record_a_line(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").first()
    try:
        return first is None or isinstance(json.loads(first[0]), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, convert_dates: bool = True) -> DataFrame:
    """An array of records, or a record a line: the first line that is not blank tells.

    Text columns whose names speak of dates become timestamps if every present value reads as one.
    """
    df = spark.read.json(path, multiLine=not _a_record_a_line(spark, path))
    named = [f.name for f in df.schema if f.dataType.simpleString() == "string" and (f.name.lower().startswith(DATE_STARTS) or f.name.lower().endswith(DATE_ENDS))]
    if not convert_dates or not named:
        return df
    as_time = lambda c: F.try_to_timestamp(F.col(f"`{c}`"))
    fine = df.agg(*[(F.count(F.col(f"`{c}`")) == F.count(as_time(c))).alias(f"f{i}") for i, c in enumerate(named)]).first()
    return df.withColumns({c: as_time(c) for i, c in enumerate(named) if fine[i]})


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV with types, JSON, anything else Parquet. Errors of the readers reach the caller."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return read_csv(spark, path, infer=True)
    if lower.endswith(".json"):
        return read_json(spark, path)
    return spark.read.parquet(path)


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """row_id first: a natural key if there is one, else positions in file order.

    Rows get a partition and a place in it, once and for all in a staged table; only the partitions' counts
    reach the driver, and come back as a broadcast of one row a partition.
    """
    if key:
        return df.select(F.col(key).cast("long").alias("row_id"), *df.columns)
    rows = staged(df.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    placed = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.select((F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)).alias("row_id"), *[F.col(f"`{c}`") for c in df.columns])


def preview(df: DataFrame, n: int = 8, key: str = "row_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def to_pretty_json(document: dict) -> str:
    return json.dumps(document, indent=2)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text of the driver, such as rules as JSON or YAML, as one file in any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_json(spark: SparkSession, path: str, document) -> None:
    write_text(spark, path, to_pretty_json(document))


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def content_hash(payload) -> str:
    """SHA-256 of the payload as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def row_hash(*columns: Column) -> Column:
    """SHA-256 of a row's values as JSON, on the executors."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, ordered_by: str | None = None) -> str:
    """A number that stands for the table's rows; with a key, for their order too."""
    columns = [c for c in df.columns if c != ordered_by] + ([ordered_by] if ordered_by else [])
    total = df.agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.md5(f"{total['s']}:{total['n']}".encode()).hexdigest()


class ResultCache:
    """Documents by key as JSON files under a folder; whatever cannot be read counts as absent."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}.json")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, key: str):
        path, fs = self._path(key)
        if not fs.exists(path):
            return None
        try:
            return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None

    def put(self, key: str, document) -> None:
        write_text(self.spark, f"{self.folder}/{key}.json", json.dumps(document, sort_keys=True))

    def get_or(self, parts, make):
        """The document under the hash of `parts`, made and kept if it is absent."""
        key = content_hash(parts)
        found = self.get(key)
        if found is None:
            found = make()
            self.put(key, found)
        return found
