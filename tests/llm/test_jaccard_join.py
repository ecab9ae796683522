import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tables import documents, sf  # noqa: F401

from stagewise.llm import jaccard_join as J
from stagewise.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, documents, rows):
    frame = documents(rows).repartition(4).selectExpr("*", "1 AS n", "2 AS node", "3 AS label")
    return sorted((tuple(r) for r in J.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def make(seed):
    """Families around a base, with edits up to and beyond the threshold, passages that many share, and tiny texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(14):
        base = text(r.choice([3, 6, 7, 8, 9, 12, 20, 40, 67, 70, 90, 130, 131, 200, 500]))
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 25)):
                at = r.randrange(len(own))
                own[at : at + r.randrange(2)] = text(r.randrange(2))
            if r.random() < 0.2:
                own = [w.upper() for w in own]
            rows.append(own)
        if r.random() < 0.3:
            rows.append(base + text(len(base) // 3))
    for n in (30, 30, 31, 60, 200):
        rows.append(passage + text(n))
    rows += [passage[:50] + text(k) for k in range(4, 14)]
    for base in (text(8), text(9), text(11)):
        rows += [base, base + text(1), base[1:], base + text(2), base[:-2]]
    r.shuffle(rows)
    out = [(1000 - k, " ".join(w)) for k, w in enumerate(rows)]
    return [*out, (2000, None), (2001, ""), (2002, " \n"), (3, "one"), (2, "ONE"), (4, "one two"), (None, out[0][1]), (None, "alone without id and links"), (out[5][0], out[5][1])]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_matches_brute_force(spark, documents, seed):
    rows = make(seed)
    assert run(spark, documents, rows) == brute(rows)


def test_large_group_of_near_copies(spark, documents):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(400 + k, rows[7][1]) for k in range(50)]
    assert run(spark, documents, rows) == brute(rows)


def test_every_link_shares_what_is_asked():
    """The pigeonhole itself: sets at the threshold have an equal segment among any H + 1, or the sizes differ too much."""
    r = np.random.default_rng(1)
    for n in (3, 4, 7, 8, 15, 31, 40, 63, 64, 90, 100, 127, 128, 200, 700):
        for _ in range(30):
            common = r.integers(0, 2**63, n, dtype=np.uint64)
            extra = int(r.integers(0, n // 3 + 1))
            a = np.unique(common)
            b = np.unique(np.append(common[int(r.integers(0, extra + 1)) :], r.integers(0, 2**63, extra, dtype=np.uint64)))
            if not J.links(a, b) or not len(b):
                continue
            small, large = sorted((a, b), key=len)
            top = J.band(np.array([len(large)]))[0]
            guest = J.band(np.array([len(small)]))[0] < top
            keys = []
            for s, g in ((small, guest), (large, False)):
                _, hashes, deletion = J.segment_hashes([s], J.PERCENT, bool(g))
                keys.append((set(hashes[~deletion].tolist()), set(hashes.tolist())))
            for s, (own, every), (_, other) in ((small, keys[0], keys[1]), (large, keys[1], keys[0])):
                must = J.most_different(len(s), top, J.PERCENT) + 1
                if len(own) >= must:
                    assert len(own - other) < must
                else:
                    assert every & other


def test_shingle_sets():
    texts = ["a b c d e f", "A B C D E F", "a b", "b a", "", None, "a b c d e a b c d e a b"]
    sets = J.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0].tolist() == sets[1].tolist() and sets[2].tolist() != sets[3].tolist()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(900 + k, 901 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    early = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long"), rounds=1).collect()}
    assert set(early) == set(got) and all(got[n] == got[label] for n, label in early.items())


def test_dedup_and_empty(spark, documents):
    text = "these are more than five words that stand in two documents"
    docs = documents([(5, text), (4, text + " x"), (6, "other words"), (7, None), (None, text)]).selectExpr("*", "1 AS gone", "2 AS row", "3 AS whole")
    out = J.dedup(docs)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["4", "6", "7"]
    assert J.digest(documents([])).count() == 0 and J.digest(documents([(1, None)])).collect()[0]["component_id"] == 1
    assert J.dedup(documents([])).count() == 0


def test_dedup_keeps_one_row_of_repeated_rows_and_null_ids(spark, documents, tmp_path):
    text = "these are more than five words that stand in several documents"
    rows = [(3, text), (3, text), (3, text), (None, "quite other words that only rows without an id hold"), (None, "quite other words that only rows without an id hold"), (8, None), (8, None), (9, "one more")]
    made = documents(rows)
    made.write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        got = sorted((str(r["doc_id"]), r["text"]) for r in J.dedup(docs).collect())
        # texts without words link with nothing, so both rows stay
        assert got == sorted([("3", text), ("None", rows[3][1]), ("8", None), ("8", None), ("9", "one more")], key=str) or got == sorted([("3", text), ("None", rows[3][1]), ("8", None), ("8", None), ("9", "one more")], key=lambda x: (x[0], str(x[1])))


def test_a_third_of_the_table_are_near_copies(spark, documents):
    """Copies with a few words changed, some of which link and some of which just do not."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(70)]
    rows = []
    for k in range(150):
        own = list(base) if k % 3 == 0 else [r.choice(words) for _ in range(r.randrange(30, 90))]
        if k % 3 == 0:
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = r.choice(words)
        rows.append((k, " ".join(own)))
    got = J.digest(documents(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert len({c for _, _, c in brute(rows)}) < 150


def test_query(spark, sf):
    import pyarrow.parquet as pq

    from stagewise.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = QUERIES["op3_jaccard_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
