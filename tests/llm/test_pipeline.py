"""The pipeline against a slow version of the same stages."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from reportmill.llm import near_dup


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = {"en": "the thing and of that with from", "fr": "le être dans avec une pas"}
    rows = []
    for i in range(80):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang].split()) + str(rng.randrange(50)) * (k % 3 == 0) for k in range(60)), lang, f"s{i % 3}", 0))
    rows += [(100, rows[4][1], "en", "s1", 0), (101, rows[4][1] + " more", "en", "s2", 0), (102, "12 34 56", "en", "s0", 0), (103, None, "fr", "s0", 0), (104, "the key password=abcdefghijklmnop of that and more of the thing", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, corpus):
    path, rows = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for name, stage in C.STAGES[:3]:
        docs = stage(spark, docs, path).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            kept = {i: t for i, t in kept.items() if t and any(c.isalpha() for c in t)}
        if name == "near_duplicates":
            sets = {i: near_dup.shingles(t, 5) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if not any(j < i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for j in sets)}
            assert 100 not in kept and 101 not in kept
        if name == "secrets":
            kept[104] = "the key [SECRET] of that and more of the thing"
        assert {r.doc_id: r.text for r in docs.collect()} == kept
    mixed = C.mixing(spark, docs, path)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(kept) and max(times.values()) <= 3
    pieces = C.run(spark, path)
    whole = pieces.filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == dict(times)


CLASHES = ("_gone", "_lang", "_id", "_key", "_times", "_all", "_rows", "_same", "_upto", "_twice", "_row", "_n", "_doc_id", "row", "id", "key", "times", "all", "hash", "same", "base", "spans", "a.b", "lang_pred", "score", "n")


def test_columns_of_any_name_pass_through_every_stage(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 6")).unionByName(docs.filter("doc_id in (7, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in CLASHES}).withColumn("more", F.create_map(F.lit("k"), F.col("doc_id")))
    for _name, stage in C.STAGES[:4]:
        docs = stage(spark, docs, path).persist()
        assert docs.columns[5:] == [*CLASHES, "more"]
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}:{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    assert C.packing(spark, docs, path).count() > 0


def test_one_of_equal_texts_stays_by_rule(spark):
    rows = [(1, "five words are in here", f"t{i}") for i in range(6)]
    seen = {tuple(r.tag for r in near_dup.deduplicated(spark.createDataFrame(x, "doc_id long, text string, tag string")).collect()) for x in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(seen) == 1 and len(seen.pop()) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _name, stage in C.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert C.packing(spark, docs, "").count() == 0
