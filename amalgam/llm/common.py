"""What the operators of this subpackage share: staged tables, words, gapless numbers, components.

Cases that hold for every operator here: only the columns an operator names are read, so extra
columns, whatever their names, neither clash nor pass through; an empty table gives an empty result
of the same columns; repeated rows are separate rows and each gets its own row of the result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.operators.graph import Stages, components, shared_dir  # noqa: F401  the operators' stages and components are the engine's

#: White space of the word contracts (space, tab, line feed, vertical tab, form feed, return).
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def words(text: str | None) -> list[str]:
    """Runs of anything but ASCII white space; a null or blank text has none."""
    if not text:
        return []
    # str.split() also cuts at other white space; it is the quick way where there is none.
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


#: Most bits of a filter by key: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26
_PROBES = 5
_PAGE = 512


def _filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each key sets: _PROBES places by double hashing."""
    h = keys.astype(np.int64).view(np.uint64)
    step = ((h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) >> np.uint64(20)) & np.uint64(bits - 1)


def key_filter(keys: DataFrame, most_bits: int = FILTER_BITS):
    """A Bloom filter of one long column as a function of a column: false means that the key is not among `keys`.

    It has about 12 bits a key up to `most_bits`, which bound what is collected and broadcast. Beyond that it lets
    more keys through, and never holds one back that it should not, so a join after it has the same result.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    n = max(1, keys.count())
    bits = min(most_bits, max(1024, 1 << (12 * n - 1).bit_length()))

    def places(frames):
        for f in frames:
            at = np.unique(_filter_places(f[name].to_numpy(), bits))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (at & np.uint64(63)).astype(np.int32)})

    def page(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(_PAGE, dtype=np.int64)
        out[frame["word"].to_numpy(np.int64) % _PAGE] = frame["bits"].to_numpy(np.int64)
        return pd.DataFrame({"page": [key[0]], "bits": [out.tobytes()]})

    set_words = keys.mapInPandas(places, "word long, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    pages = set_words.groupBy(F.floor(F.col("word") / _PAGE).alias("page")).applyInPandas(page, "page long, bits binary")
    table = np.zeros(max(_PAGE, bits // 64), dtype=np.uint64)
    for r in pages.collect():  # at most most_bits in all
        table[r["page"] * _PAGE : (r["page"] + 1) * _PAGE] = np.frombuffer(r["bits"], dtype=np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def among(key: pd.Series) -> pd.Series:
        at = _filter_places(key.to_numpy(), bits)
        return pd.Series(((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1))

    return among


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, stages: Stages, groups: list[str], uid: str, out: str, block: int = 50_000) -> DataFrame:
    """Add `out`: gapless from 0 within each group, without bringing a group into one task.

    `uid` must be a unique, already materialised long. A group of n rows is cut by hash into about
    n / block blocks; rows are numbered inside a block, and blocks are offset by what stands before.
    """
    sizes = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_blocks"))
    cut = df.join(sizes, [df[g].eqNullSafe(sizes[g]) for g in groups])
    for g in groups:
        cut = cut.drop(sizes[g])
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(uid), F.col("_blocks"))).drop("_blocks")
    inner = Window.partitionBy(*groups, "_block").orderBy(uid)
    cut = stages.put(cut.withColumn("_in", F.row_number().over(inner) - 1), "numbered")
    counts = cut.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [*groups, "_block"]
    joined = cut.join(offsets, [cut[k].eqNullSafe(offsets[k]) for k in keys])
    for k in keys:
        joined = joined.drop(offsets[k])
    return joined.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", "_block")
