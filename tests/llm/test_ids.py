"""Ids above 2**53 beside a null one come back as they are from every operator."""

import random

from quiverdf.llm import exact_dedup, imatch, language_id, mixing, packing, pii, simhash_dedup, substring_dedup, toxicity, warc
from quiverdf.llm.queries import tokenizer_path

from .data import frame, words

IDS = [None, (1 << 60) + 1, (1 << 60) + 3, -((1 << 60) + 5), 7]


def docs(spark):
    r = random.Random(2)
    shared = words(r, 20)
    return frame(spark, 1, [(i, f"{shared} {words(r, 30)}", "en", "s", None) + ("clash",) * 11 for i in IDS])


def test_ids_stay(spark):
    from pyspark.sql import functions as F

    d = docs(spark)
    labels = spark.createDataFrame([(i, int(i > 0)) for i in IDS if i is not None], "doc_id long, toxic int")
    net = toxicity.learn(d, labels, F.lit(True), "doc_id", "text", "toxic")
    profiles = language_id.learn(d, F.lit(True), "doc_id", "text", "lang")
    results = {
        "toxicity": toxicity.score(d, net), "packing": packing.pack(d, tokenizer_path()), "mixing": mixing.mix(d), "imatch": imatch.fingerprints(d), "pii": pii.find(d), "language": language_id.identify(d, profiles),
        "exact": exact_dedup.exact_groups(d), "simhash": simhash_dedup.near_groups(d), "similar": simhash_dedup.near_groups(d, words=5, similarity=0.8), "substring": substring_dedup.remove_repeats(d),
    }
    for name, df in results.items():
        assert {r["doc_id"] for r in df.collect()} == set(IDS), name


def test_page_ids_stay(spark):
    pages = spark.createDataFrame([(i, "u", "same") for i in IDS] + [((1 << 60) + 9, "u", None)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["refers_to"] for r in warc.archive(pages).collect()}
    least = -((1 << 60) + 5)
    assert got == {None: None, least: None, 7: least, (1 << 60) + 1: least, (1 << 60) + 3: least, (1 << 60) + 9: None}
