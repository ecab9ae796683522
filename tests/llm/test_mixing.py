import re

import numpy as np
import pytest
from tables import documents, sf  # noqa: F401

from stagewise.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = share * sum(size.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * size[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
        open_ -= over
    return target


def check(got, rows, largest_miss=1.0):
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    want = brute_targets(size)
    taken, widest = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    assert len(got) == len(rows)
    sources = {}
    for doc_id, text, source in rows:
        sources.setdefault((doc_id, len(WORD.findall(text or ""))), []).append(source)
    for r in got:
        source = sources[r["doc_id"], r["size"]].pop()
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(want[source], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
        widest[source] = max(widest[source], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest_miss * widest[s] + 1e-6, (s, taken[s], want[s])


def make(seed, n=700):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        source = ["b", "a", "ä", None, "Z", "tiny"][int(r.choice(6, p=[0.4, 0.3, 0.1, 0.1, 0.09, 0.01]))]
        rows.append((k, "w " * int(r.integers(0, 300)), source))
    return [*rows, (n, None, "a"), (n + 1, "", "empty"), (n + 2, "x y z", "b"), (n + 3, "one two three " * 3000, "Z")]


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 16, "fan_in": 3}])
def test_targets_and_taken_words(spark, documents, options):
    rows = make(3)
    digest = lambda: M.digest(documents(rows), **options)
    got = digest().collect()
    check(got, rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, digest().collect()))


def test_expectation_and_sum_stay():
    r = np.random.default_rng(0)
    size = np.sort(r.integers(1, 50, 30))[::-1].astype(float)
    start = r.uniform(0.05, 0.95, 30)
    total = np.zeros(30)
    for _ in range(4000):
        prob = start.copy()
        held = M.pivot(size, prob, r.random)
        assert size @ prob == pytest.approx(size @ start)
        assert ((prob < 1e-9) | (prob > 1 - 1e-9) | (np.arange(30) == held)).all()
        total += prob
    assert np.abs(total / 4000 - start).max() < 0.05


def test_equal_rows_are_spread_over_leaves(spark, documents, monkeypatch):
    """Rows equal in id, text and source: each leaf stays about as small as any, and reruns agree."""
    rows = [(1, "w " * 7, "a")] * 600 + [(k, "w " * (k % 30), "a") for k in range(2, 300)]
    seen = []
    staged = M.staged

    def watch(df, name):
        out = staged(df, name)
        if name == "mix-level0":
            seen.append(out.groupBy("place", "leaf").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(M, "staged", watch)
    digest = lambda: M.digest(documents(rows), leaf_rows=32, fan_in=4)
    got = digest().collect()
    check(got, rows)
    assert max(seen) < 4 * 32
    assert sorted(map(tuple, got)) == sorted(map(tuple, digest().collect()))


def test_as_many_sources_as_documents(spark, documents):
    rows = [(k, "w " * (k % 17), f"s{k}") for k in range(300)]
    check(M.digest(documents(rows)).collect(), rows)


def test_mix_keeps_columns_and_repeats(spark, documents):
    rows = make(5, 60) + [(3, "w w", "a"), (3, "w w", "a")]
    docs = documents(rows).selectExpr("*", "1 AS size", "2 AS row", "3 AS copies", "4 AS hash")
    out = M.mix(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert abs(words - 1.5 * sum(len(WORD.findall(t or "")) for _, t, _ in rows)) < 9000
    assert M.mix(documents([])).count() == 0 and M.digest(documents([(1, None, None), (None, "", "a")])).count() == 2


def test_query(spark, sf):
    import pyarrow.parquet as pq

    from stagewise.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    check(QUERIES["op4_source_mixing"](spark, sf).collect(), rows)
