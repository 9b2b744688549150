"""Fingerprints, nearest neighbors and centroids of vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.columns import cosine

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 64
#: Hamming distance to a vertex without a vector.
FARTHEST = 64
#: Bits of a projection key and how many keys a fingerprint gives.
PRESETS = {8: 16, 10: 12, 12: 15}


def projections(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED + dimension).standard_normal((64, dimension))


def fingerprint_longs(vectors: Iterable) -> list[int | None]:
    """The signs of 64 random projections of each vector as a signed long; None for none. One product for all vectors of a length."""
    vectors = list(vectors)
    out: list[int | None] = [None] * len(vectors)
    by_length: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(k)
    for n, places in by_length.items():
        signs = np.stack([np.asarray(vectors[k], float) for k in places]) @ projections(n).T > 0
        for k, fp in zip(places, np.packbits(signs, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64).tolist(), strict=True):
            out[k] = fp
    return out


def fingerprint(vector: Column) -> Column:
    """The fingerprint of a column of vectors; null for null and empty ones."""

    def of(vectors: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_longs(vectors), dtype="Int64")

    return F.pandas_udf(of, LongType())(vector.cast("array<double>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints, FARTHEST where one lacks."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(FARTHEST))


def fingerprints(rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, vector, fp: the signs of 64 random projections as a long. Null vectors have no fingerprint."""
    out = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return out.withColumn("fp", fingerprint(F.col("vector")))


def rotated(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits)) if bits else fp


def buckets(fp: Column, size: int, slices: int) -> Column:
    """Keys of `size` bits from rotations of a fingerprint, one for each slice."""
    step = 64 // slices
    return F.array(*[F.struct(F.lit(k).alias("slice"), rotated(fp, k * step).bitwiseAND(F.lit((1 << size) - 1)).alias("key")) for k in range(slices)])


def projection_keys(fp: Column, size: int = 8) -> Column:
    """The keys of a preset: 16 of 8 bits, 12 of 10 or 15 of 12, each with its slice's number above its bits."""
    if size not in PRESETS:
        raise ValueError(f"keys have {', '.join(map(str, PRESETS))} bits")
    return F.transform(buckets(fp, size, PRESETS[size]), lambda b: F.shiftleft(b["slice"].cast("long"), size).bitwiseOR(b["key"]))


def ann(rows: DataFrame, probes: DataFrame, k: int = 10, key_bits: int = 8, slices: int = 16, flips: int = 2) -> DataFrame:
    """For each probe the k most similar rows, by exact cosine, among those of its buckets and of all whose key differs in up to `flips` bits.

    Keys travel without vectors; a row's vector joins once for each probe that it is a candidate of.
    """
    keyed = lambda df: df.select("id", "fp", F.explode(buckets(F.col("fp"), key_bits, slices)).alias("b")).select("id", "fp", "b.slice", "b.key")
    near = F.array(*[F.lit(m).cast("long") for m in range(1 << key_bits) if m.bit_count() <= flips])
    printed = fingerprints(rows.dropDuplicates(["id"]))
    asked = fingerprints(probes)
    left = keyed(asked).select(F.col("id").alias("probe"), F.col("fp").alias("pf"), "slice", F.col("key").alias("own"), F.explode(near).alias("mask"))
    left = left.select("probe", "pf", "slice", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
    # A pair that meets in several slices counts in the first of them.
    apart = buckets(F.col("pf").bitwiseXOR(F.col("fp")), key_bits, slices)
    first = F.filter(apart, lambda b: F.bit_count(b["key"]) <= flips)[0]["slice"]
    pairs = left.join(keyed(printed), ["slice", "key"]).filter(F.col("slice") == first).select("probe", "id")
    pairs = pairs.join(printed.select("id", "vector"), "id").join(asked.select(F.col("id").alias("probe"), F.col("vector").alias("pv")), "probe")
    best = Window.partitionBy("probe").orderBy(F.col("sim").desc(), "id")
    ranked = pairs.withColumn("sim", cosine(F.col("pv"), F.col("vector"))).withColumn("place", F.row_number().over(best))
    return ranked.filter(F.col("place") <= k).select("probe", "id", "sim", "place")


def centroids(rows: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """key, centroid: the mean of each position."""
    each = rows.select(key, F.posexplode(vector_col).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
