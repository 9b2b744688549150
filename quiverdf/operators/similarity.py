"""Similarity of feature vectors (maps of dimension to weight) and of 8-bit quantised vectors, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def weights(a: Column, b: Column, fn) -> Column:
    """fn of the two weights of each dimension that either has; a missing one is 0."""
    zero = F.lit(0.0)
    return F.map_values(F.map_zip_with(a, b, lambda k, x, y: fn(F.coalesce(x, zero), F.coalesce(y, zero))))


def feature_cosine(a: Column, b: Column) -> Column:
    square = lambda m: total(F.transform(F.map_values(m), lambda x: x * x))
    length = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(length > 0, F.least(F.lit(1.0), total(weights(a, b, lambda x, y: x * y)) / length)).otherwise(F.lit(0.0))


def feature_jaccard(a: Column, b: Column) -> Column:
    most = total(weights(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(most > 0, total(weights(a, b, lambda x, y: F.least(x, y))) / most).otherwise(F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Number of dimensions that both have."""
    return F.size(F.array_intersect(F.map_keys(a), F.map_keys(b)))


@dataclass
class Blend:
    """How feature similarity is put together; scores under a minimum are 0."""

    least_shared: int = 1
    least_jaccard: float = 0.0
    least_cosine: float = 0.0
    jaccard_power: float = 0.0
    cosine_power: float = 1.0

    def of(self, a: Column, b: Column) -> Column:
        c, j = feature_cosine(a, b), feature_jaccard(a, b)
        low = (intersection(a, b) < self.least_shared) | (j < self.least_jaccard) | (c < self.least_cosine)
        return F.when(low, F.lit(0.0)).otherwise(F.pow(j, F.lit(self.jaccard_power)) * F.pow(c, F.lit(self.cosine_power)))


def feature_centroid(rows, key: str, vector: str):
    """key, centroid: the mean weight of each dimension over all of a key's vectors."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    sums = rows.select(key, F.explode(vector).alias("dim", "w")).groupBy(key, "dim").agg(F.sum("w").alias("w"))
    return sums.join(n, key).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", F.col("w") / F.col("n"))))).alias("centroid"))


def scale(v: Column) -> Column:
    """What a step of the quantised vector is worth."""
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / F.lit(127.0)


def quantised(v: Column) -> Column:
    """Components as integers of -127 to 127 in steps of scale(v)."""
    step = scale(v)
    return F.transform(v, lambda x: F.when(step > 0, F.round(x.cast("double") / step)).otherwise(F.lit(0.0)).cast("int"))


def dp_pi8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def ssq_pi8(a: Column) -> Column:
    return dp_pi8(a, a)


def rsqrtssq_pi8(a: Column) -> Column:
    return F.when(ssq_pi8(a) > 0, 1.0 / F.sqrt(ssq_pi8(a))).otherwise(F.lit(0.0))


def cos_pi8(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dp_pi8(a, b) * rsqrtssq_pi8(a) * rsqrtssq_pi8(b)))


def ecld_pi8(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.sqrt(ssq_pi8(d).cast("double"))


def ham_pi8(a: Column, b: Column) -> Column:
    """Number of differing bits of the components as bytes."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.lit(255)).bitwiseXOR(y.bitwiseAND(F.lit(255)))).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


def matches(score: Column, threshold: float, hamming: Column | None = None, most_hamming: int = 64) -> Column:
    near = score >= threshold
    return near if hamming is None else near & (hamming <= most_hamming)
