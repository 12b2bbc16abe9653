"""Rows that repeat: ties at the end of a source's share, several texts of one doc_id, counts beyond 32 bits."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadspark.llm import jaccard, language_model, mixing, pii

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("same", [True, False])
def test_a_share_that_ends_among_equal_rows_takes_some_of_them(spark, doc_id, same):
    """Two sources of 1 000 words and weights 1 and 2: the first gets 667, whether its 100 rows are equal or not."""
    text = lambda i: " ".join(["w"] * 9 + ["w" if same else f"x{i}"])
    rows = [(doc_id, text(i), "a") for i in range(100)] + [(i, text(i), "b") for i in range(100, 200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    assert len(got) == 200 and abs(taken["a"] - 2000 / 3) <= 10 and abs(taken["b"] - 4000 / 3) <= 10
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()
    key = lambda r: (r.source, r.doc_id or 0, hashlib.md5(r.text.encode()).hexdigest(), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rows_of_one_id_are_one_document_for_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = b.replace("b59", "other")
    rows = [(3, a), (5, a), (5, b), (7, near), (8, "alone " + a[:20]), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.linked(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 9)]
    kept = {tuple(sorted((r.doc_id, r.text or "") for r in jaccard.representatives(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).collect()))
            for x, n in (([*rows, (8, "second text of eight")], 1), ([(8, "second text of eight"), *rows[::-1]], 4))}
    assert len(kept) == 1 and [d for d, _ in next(iter(kept))] == [3, 8, 9]


def test_counts_beyond_32_bits_are_whole():
    keys = np.array([10, 20], np.uint64)
    pack = language_model.pack
    table = pa.table({"level": [1, 1, 1], "bucket": [0, 0, 0], "chunk": [0, 1, 2], "keys": [keys.tobytes()] * 3, "main": [pack(np.array([2**31 + 3, 1], np.uint32))] * 3, "other": [pack(np.array([0, 5], np.uint32))] * 3})
    rows = {r["chunk"]: r for r in language_model._count(table).to_pylist()}
    assert list(language_model.unpack_counts(rows[1]["main"])) == [3 * (2**31 + 3), 3] and list(language_model.unpack_counts(rows[1]["other"])) == [0, 15]


def test_terms_meet_only_the_texts_that_hold_them(spark):
    """One address in a hundred texts, each with a word of its own and one for all: places of terms are those that occur."""
    rows = [(i, f"mail root.person@mail.example.com about project{i} secretname today") for i in range(100)] + [(1000 + i, f"nothing here about plain words number{i} today") for i in range(900)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {i: t for i, t in rows}
    marked = [words[r.doc_id][s.start:s.end] for r in found for s in r.spans if s.kind == 4]
    assert len(found) == 100 and marked.count("secretname") == 100
    assert all(words[r.doc_id][s.start:s.end] in words[r.doc_id].split() for r in found for s in r.spans if s.kind == 4)


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_sift_keeps_what_meets_and_little_else(spark, most):
    """Of 200 000 rows 1 000 meet; a bitmap that is too small lets more of the others pass and loses none."""
    from leadspark.scratch import materialize, sift

    many = spark.range(200_000).select((F.col("id") * 977 - 10_000).alias("doc_id"), F.lit("text").alias("text"))
    ids = materialize(spark.range(1000).select((F.col("id") * 977 * 3 - 10_000).alias("doc_id")), "ids")
    got = sift(many, ids, "doc_id", most)
    assert got.columns == many.columns and got.join(ids, "doc_id").count() == 1000 and got.dropDuplicates().count() == got.count()
    assert got.count() < (1600 if most > 1 << 20 else 10_000)
    assert sift(many, materialize(ids.limit(0), "none"), "doc_id").count() == 0
