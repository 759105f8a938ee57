"""Sharding in Hilbert-curve order: several metadata dimensions are quantised, rows sorted by their index on the curve and
cut into runs of equal row counts, so that every shard spans a small box in all dimensions and files can be pruned.

The global rank is distributed: rows are dealt by ranges of (curve index, doc_id), ranges are counted, and a row's rank is
its range's offset plus its place within. Only keys and sizes move, never texts.

Defined results: null text has size 1 and checksum 0; null dimensions come first; equal curve indexes fall by doc_id, then
checksum, then size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.shared import partitions, written

BITS = 8


def hilbert_index(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """The index on the Hilbert curve of points in [0, 2**bits)^d, vectorised over points."""
    x = [c.astype(np.int64).copy() for c in coords]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    x = [c ^ t for c in x]
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def curve(dims: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("bigint")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([points[c].to_numpy() for c in points.columns], bits))

    return index(F.struct(*[d.alias(f"d{i}") for i, d in enumerate(dims)]))


def ordinal(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Adds _q_<column>: the place of the value among the distinct values in order, scaled to bits.

    The ranked table has a row for each distinct value of a metadata column; Spark broadcasts it only if its size allows."""
    name = f"_q_{column}"
    values = rows.groupBy(F.col(column).alias("_v")).agg(F.lit(1).alias("_one"))
    order = W.orderBy(F.col("_v").asc_nulls_first())
    ranks = values.select("_v", F.floor((F.row_number().over(order) - 1) * F.lit(1 << bits) / F.count(F.lit(1)).over(W.partitionBy())).cast("int").alias(name))
    return rows.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS, carry: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, size, text_crc32, curve_index, shard, slot, and _carry if it is given.

    Dimensions: source and language by rank, and the logarithm of the size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"), (F.lit(None) if carry is None else carry).alias("_carry"))
    rows = written(rows.withColumn("_carry", F.col("_carry").cast("string")) if carry is None else rows, "shard-rows")
    for column in ("source", "lang"):
        rows = ordinal(rows, column, bits)
    length = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size")) * (1 << bits) / 32)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", curve([F.col("_q_source"), F.col("_q_lang"), length], bits).alias("curve_index"), "_carry")
    order = ["curve_index", "doc_id", "text_crc32", "size"]
    spark = docs.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "shard-ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    ranked = dealt.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1)
    ranked = ranked.join(offsets, F.col("_range") == F.col("_r")).withColumn("_rank", F.col("_offset") + F.col("_in"))
    ranked = ranked.withColumn("shard", F.expr(f"(_rank * {shards}) div _total").cast("int"))
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    placed = ranked.select("doc_id", "size", "text_crc32", "curve_index", "shard", (F.col("_rank") - first).cast("bigint").alias("slot"), "_carry")
    return placed.drop("_carry") if carry is None else placed


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = BITS) -> str:
    """Writes the documents, each row once, to one folder for each shard, files in slot order: rows travel with their keys, so
    nothing is joined. Returns the folders' key: _shard, with more underscores where a column has that name."""
    key = "_shard"
    while key in {c.lower() for c in docs.columns}:
        key = f"_{key}"
    whole = F.struct(*[F.col(c) for c in docs.columns])
    placed = hilbert_shards(docs, shards, bits, whole).select("_carry.*", F.col("shard").alias(key))
    placed.write.partitionBy(key).parquet(path)
    return key
