import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tables import documents, sf  # noqa: F401

from stagewise.llm import quality as Q
from stagewise.llm.kernels import hash_spans, mix

LABELS = "doc_id long, quality int, toxic int"


def brute_nll(at, rows, cols, grade, width):
    score = np.zeros(len(grade))
    for r, c in zip(rows, cols, strict=True):
        score[r] += at[c]
    cut = [at[width], at[width] + np.exp(at[width + 1])]
    cdf = lambda k, s: 1.0 if k == 2 else 0.0 if k < 0 else 1 / (1 + np.exp(s - cut[k]))
    return -sum(np.log(cdf(g, s) - cdf(g - 1, s)) for g, s in zip(grade, score, strict=True)) / len(grade)


def test_fit_finds_the_minimum():
    """Without a ridge, no small step from the fitted model makes the likelihood better."""
    r = np.random.default_rng(0)
    grade = r.integers(0, 3, 300)
    on = r.random((300, 4)) < 0.3 + 0.15 * grade[:, None] * np.array([1, -1, 0.5, 0])
    rows, cols = np.nonzero(on)
    weights, cuts = Q.fit_ordinal(rows, cols, grade, 4, steps=3000, ridge=0.0)
    at = np.concatenate([weights, cuts[:1], np.log(np.diff(cuts))])
    best = brute_nll(at, rows, cols, grade, 4)
    for k in range(6):
        for step in (-0.05, 0.05):
            assert brute_nll(at + step * (np.arange(6) == k), rows, cols, grade, 4) > best - 1e-7
    assert cuts[0] < cuts[1] and weights[0] > 0.3 and weights[1] < -0.3


def test_probabilities_are_ordered():
    model = Q.OrdinalModel(np.zeros(0), np.array([-1.0, 0.5]))
    tails = model.tails(np.linspace(-5, 5, 11))
    assert (tails[:, 0] > tails[:, 1]).all() and (np.diff(tails, axis=0) > 0).all()


def test_features_are_whole_text_and_distinct():
    texts = ["", None, "a b a", "A b", "word " * 30000 + "last", "word " * 30000, "!! ?", "é"]
    got = [set(x.tolist()) for x in Q.features(pa.array(texts))]
    assert all(len(x) == len(y) for x, y in zip(got, Q.features(pa.array(texts)), strict=True))
    assert got[0] == got[1] and len(got[4] - got[5]) == 2 and len(got) == 8


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = "pmod(xxhash64(doc_id), 4) = 0"
    model = Q.fit(docs, labels.where(f"NOT {fold}"))
    rated = Q.grades(labels.where(fold)).withColumnRenamed("id", "doc_id")
    rows = Q.score(docs.select("doc_id", "text"), model, ["doc_id"]).join(rated, "doc_id").collect()
    kept = lambda g: np.mean([r["tail"] >= Q.KEEP_FROM for r in rows if r["grade"] == g])
    assert kept(2) > 0.97 and kept(1) < 0.15 and kept(0) < 0.25
    mean = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)]
    assert max(mean[0], mean[1]) < mean[2] - 0.6


def test_odd_rows(spark, documents):
    good, bad = "pleasant ordinary words in a row", "awful idiot words"
    rows = [(k, good if k % 2 else bad) for k in range(40)] + [(50, None), (51, ""), (None, good), (3, good), (60, "x" * 200000)]
    docs = documents(rows).selectExpr("*", "1 AS tail", "2 AS grade")
    labels = spark.createDataFrame([(k, 1, 0 if k % 2 else 1) for k in range(40)] + [(1, None, None), (None, 1, 0), (3, 1, 0), (999, 0, 0), (5, 1, None)], LABELS)
    out = Q.select(docs, labels)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert set(range(1, 40, 2)) <= set(ids) and not set(range(0, 40, 2)) & set(ids) and ids.count(3) == 2
    assert Q.digest(docs, labels).count() == len(rows)
    nothing = spark.createDataFrame([], LABELS)
    assert Q.select(docs, nothing).count() == len(rows) and Q.digest(documents([]), labels).count() == 0


def plain_features(text):
    """The buckets of one text, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    top = lambda piece, seed: int(hash_spans(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]), seed)[0]) >> (64 - Q.BITS)
    words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]
    out = {top(w, 1) for w in words}
    fresh = 15 * len(out) // max(len(words), 1)
    out |= {top(w[: Q.STEM_BYTES], 3) for w in words}
    out |= {top(x.encode(), 2) for x in re.findall("[\x00-\x08\x0e-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)}
    data = text.encode()
    ink = sum(b != 32 and not 9 <= b <= 13 for b in data)
    upper, digit = sum(65 <= b <= 90 for b in data), sum(48 <= b <= 57 for b in data)
    letter = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data)
    share = lambda part, whole: int(np.floor(15 * np.sqrt(part / max(whole, 1))))
    size = int(np.floor(np.log2(len(words) + 1)))
    tags = [share(upper, letter) + 100, share(ink - letter - digit, ink) + 200, share(digit, ink) + 300, size + 400, fresh + 500 + 20 * min(size, 12)]
    return out | {int(mix(np.array([t], np.uint64) ^ np.uint64(0xD1B54A32D192ED03))[0]) >> (64 - Q.BITS) for t in tags}


def test_query_matches_brute_force(spark, sf):
    """Features word by word, and a dense model fitted on the buckets that occur."""
    from stagewise.llm.queries import QUERIES

    docs = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf}/documents.parquet").to_pylist())
    grade = {}
    for r in pq.read_table(f"{sf}/labels.parquet").to_pylist():
        g = 0 if r["toxic"] == 1 else r["quality"] + 1 if r["quality"] is not None else None
        if g is not None:
            grade[r["doc_id"]] = min(g, grade.get(r["doc_id"], 2))
    held = {d: plain_features(t) for d, t in docs}
    rated = [d for d, _ in docs if d in grade]
    names = {x: k for k, x in enumerate(sorted(set().union(*held.values())))}
    rows, cols = np.array([(k, names[x]) for k, d in enumerate(rated) for x in sorted(held[d])]).T
    weights, cuts = Q.fit_ordinal(rows, cols, np.array([grade[d] for d in rated]), len(names))
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, _ in docs:
        score = sum(weights[names[x]] for x in held[d])
        tails = 1 / (1 + np.exp(cuts - score))
        assert got[d]["expected_grade"] == pytest.approx(tails.sum(), abs=2e-4) and got[d]["tail_probability"] == pytest.approx(tails[1], abs=2e-4)
        assert got[d]["keep"] == (tails[1] >= Q.KEEP_FROM) or abs(tails[1] - Q.KEEP_FROM) < 1e-6


def test_query_is_whole_and_repeatable(spark, sf):
    from stagewise.llm.queries import QUERIES

    run = lambda: sorted(map(tuple, QUERIES["op1_quality_classifier"](spark, sf).collect()))
    assert run() == run() and len(run()) == 200
