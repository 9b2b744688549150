"""Nearest neighbors against brute force."""

import numpy as np
import pandas as pd
import pytest

from quiverdf import queries
from quiverdf.operators import vectors


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ann_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    e = pd.read_parquet(f"{folder}/embeddings.parquet")
    v = np.stack(e["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = queries.QUERIES["ann_search"](spark, folder).toPandas()
    probes = np.flatnonzero(e["vec_id"] % 100 == 0)
    assert set(got["probe"]) == {f"V{e['vec_id'][p]}" for p in probes} and not got.duplicated(["probe", "id"]).any()
    hits = 0
    for p in probes:
        best = {f"V{e['vec_id'][x]}" for x in np.argsort(-(v @ v[p]), kind="stable")[:10]}
        hits += len(best & set(got.loc[got["probe"] == f"V{e['vec_id'][p]}", "id"]))
    assert hits / (10 * len(probes)) >= 0.9


def test_sort_by_hamming_distance(spark):
    """The nearest fingerprints, recounted from the projections' signs; no vector is 64 bits away."""
    from quiverdf.plans import query
    from quiverdf.plans.graph import Graph

    folder = "/root/testdata/sf0.001"
    e = pd.read_parquet(f"{folder}/embeddings.parquet")
    signs = np.stack(e["embedding"].to_numpy()).astype(float) @ vectors.projections(len(e["embedding"][0])).T > 0
    ham = (signs != signs[int(np.flatnonzero(e["vec_id"] == 0)[0])]).sum(1)
    want = sorted((int(h), f"V{v}") for h, v in zip(ham, e["vec_id"]) if h <= 30)[:20]
    got = [(r["ham"], r["id"]) for r in queries.QUERIES["sort_hamming"](spark, folder).collect()]
    assert got == want and got[0] == (0, "V0")

    two = Graph(spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "id string, vector array<double>"), spark.createDataFrame([], "tail string, head string"))
    assert [(r["id"], r["ham"]) for r in query.vertices(two, sortby="S_HAM", vector=[1.0, 2.0]).collect()] == [("a", 0), ("b", 64)]


def test_projection_keys(spark):
    """A preset has as many keys as it should, and equal fingerprints have equal keys."""
    row = spark.range(1).select(*[vectors.projection_keys(vectors.F.lit(0x0123456789ABCDEF).cast("long"), k).alias(f"k{k}") for k in vectors.PRESETS]).first()
    for k, n in vectors.PRESETS.items():
        assert len(set(row[f"k{k}"])) == len(row[f"k{k}"]) == n
        assert row[f"k{k}"][0] == 0x0123456789ABCDEF & ((1 << k) - 1)


def test_unknown_names_raise(spark):
    from quiverdf.plans import query
    from quiverdf.plans.conditions import ConditionError
    from quiverdf.plans.graph import Graph

    g = Graph(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "tail string, head string"))
    for call in (lambda: query.vertices(g, sortby="S_NOTHING"), lambda: query.vertices(g, fields="F_NOTHING"), lambda: query.vertices(g, {"similarity": {"vector": [1.0], "near": 1}}), lambda: query.vertices(g, result="R_X")):
        with pytest.raises(ConditionError):
            call()
