"""Findings of the second round: each test failed before its fix."""

import numpy as np

from caseloom.llm import bagminhash, quality


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 600)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    shingles = rng.integers(0, 2**63, begins[-1], dtype=np.int64).astype(np.uint64)
    # some shingles occur several times, so that strips are cut as well
    shingles[::7] = shingles[0]

    def signed(low, high):
        part = begins[low : high + 1] - begins[low]
        doc, shingle, weight, _ = bagminhash.count_shingles(shingles[begins[low] : begins[high]], part)
        return bagminhash.signatures(doc, shingle, weight, high - low, 125)

    together = signed(0, 600)
    alone = np.concatenate([signed(i, i + 1) for i in range(600)])
    assert (together == alone).all()


def test_quality_sample_counts_different_texts(spark):
    texts = [f"Sentence number {k} stands here, and it is a fine one. " * (k % 5 + 1) for k in range(30)]
    docs = spark.createDataFrame([(texts[i % 30],) for i in range(3000)], "text string")
    every, some = (quality.fit_quality(docs, sample=n, features=1024) for n in (10_000, 30))
    assert every.weights.any() and np.array_equal(every.weights, some.weights)
    fewer = quality.fit_quality(docs, sample=7, features=1024)
    assert fewer.weights.any() and not np.array_equal(every.weights, fewer.weights)


def test_quality_of_one_text_in_many_rows(spark):
    for text in (None, "One fine sentence stands in every row."):
        docs = spark.createDataFrame([(text,)] * 500, "text string")
        every, one = (quality.fit_quality(docs, sample=n, features=1024) for n in (1000, 5))
        assert np.array_equal(every.weights, one.weights) and every.posteriors == one.posteriors
