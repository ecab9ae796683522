import hashlib
import random
import re

import pyarrow as pa
import pytest
from tables import documents, sf  # noqa: F401

from stagewise.llm import decontamination as D
from stagewise.llm.kernels import ALNUM, NOT_SPACE, word_counts, word_hashes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    found = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(None if name is None else str(name))
    out = []
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if names := found.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    own |= names
        digest = hashlib.sha256(",".join(sorted(own - {None})).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def run(spark, documents, docs, items, **options):
    bench = spark.createDataFrame([(n, t) for n, t in items], "item_id long, text string")
    report = D.contaminated(D.find_matches(documents(docs), bench, **options))
    from pyspark.sql import functions as F

    got = report.selectExpr("doc_id", "n_words", "n_hit", "CAST(size(items) + CAST(unnamed AS INT) AS BIGINT) n_items", "sha2(array_join(items, ','), 256) items_sha256", "contaminated")
    return sorted(map(tuple, got.collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    vocab = ["a", "Über", "x1", "the", "of", "ça", "Q", "zz"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, line(r.choice([1, 3, 12, 13, 14, 30]))) for k in range(5)] + [(7, ""), (8, None), (9, "...")]
    items += [(None, line(14)), (None, line(3)), (3, line(15))]
    docs = []
    for k in range(40):
        parts = [line(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(items)[1] or "")
        docs.append((k, ",\n".join(parts)))
    return [*docs, (50, None), (51, ""), (52, "?!"), (1, docs[1][1]), (53, docs[3][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"shard_words": 7}, {"block_bytes": 100}])
def test_matches_brute_force(spark, documents, seed, options):
    docs, items = cases(seed)
    assert run(spark, documents, docs, items, **options) == sorted(brute(docs, items), key=str)


def test_longest_match_and_place(spark, documents):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = documents([(1, f"lead in {passage} tail"), (2, "nothing here")])
    bench = spark.createDataFrame([(3, f"x {passage} y")], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.find_matches(docs, bench).collect()}
    assert [tuple(m) for m in got[1]["matches"]] == [("3", 2, 1, 20)]
    assert got[2]["matches"] == []
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


def brute_matches(doc, items, window):
    """From each place the longest match with any item, of ``window`` words or of a whole short item, if it is not inside an earlier one."""
    d, out, end = words(doc), [], 0
    texts = [words(t) for _, t in items]
    for p in range(len(d)):
        best = 0
        for w in texts:
            for a in range(len(w)):
                n = 0
                while p + n < len(d) and a + n < len(w) and d[p + n] == w[a + n]:
                    n += 1
                if n and n >= min(window, len(w)):
                    best = max(best, n)
        if best and p + best > end:
            out.append((p, best))
            end = p + best
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_longest_matches_against_brute_force(spark, documents, seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(k, line(r.choice([2, 5, 8, 20]))) for k in range(4)]
    docs = [(k, " ".join([line(r.randrange(12)), r.choice(items)[1], line(r.randrange(6)), r.choice(items)[1][4:]])) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_name = {str(n): words(t) for n, t in items}
    for row in D.find_matches(documents(docs), bench, window=6, shard_words=60).collect():
        d = words(dict(docs)[row["doc_id"]])
        got = [(m["doc_word"], m["words"]) for m in row["matches"]]
        assert got == brute_matches(dict(docs)[row["doc_id"]], items, 6)
        for m in row["matches"]:
            assert by_name[m["item"]][m["item_word"] :][: m["words"]] == d[m["doc_word"] :][: m["words"]]


def test_repetitive_texts_stay_small(spark, documents):
    """An item of one repeated word against a long text of it: no pair of places is ever built."""
    import resource

    tests = D.test_suffixes(["a", "b"], ["same " * 2000, "same " * 30 + "other"])
    col = pa.array(["same " * 200_000 + "end", "x"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = list(D._judge([word_hashes(col, ALNUM)], tests, D.WINDOW))
    assert got[0][0] == 200_001 and got[0][1] == [{"start": 0, "stop": 200_000}] and got[0][2] == ["a", "b"] and got[1] == (1, [], [], False, [])
    assert len(got[0][4]) <= 200_000 and got[0][4][0]["words"] == 2000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert D._verdicts([word_hashes(col, ALNUM)], tests, D.WINDOW).tolist() == [True, False]


def test_null_items_count_and_are_not_listed(spark, documents, tmp_path):
    import duckdb

    passage = " ".join(f"w{k}" for k in range(15))
    items = [(None, passage), (2, passage), (None, "short one")]
    docs = [(1, passage), (2, f"a short one {passage}"), (3, "short one")]
    got = run(spark, documents, docs, items)
    assert got == sorted(brute(docs, items), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({D.ORACLE})").fetchall(), key=str) == got


def test_blocks_remove_the_same_documents(spark, documents):
    docs, items = cases(9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(docs)
    one = sorted(str(tuple(r)) for r in D.decontaminate(frame, bench).collect())
    assert one == sorted(str(tuple(r)) for r in D.decontaminate(frame, bench, block_bytes=60).collect())
    left = sorted(str(d) for (d, _), b in zip(docs, brute(docs, items), strict=True) if not b[-1])
    assert sorted(str(r["doc_id"]) for r in D.decontaminate(frame, bench, shard_words=9).collect()) == left


def test_empty_tables_and_other_columns(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "some text")]).selectExpr("*", "1 AS hit", "'q' AS n_words")
    assert D.digest(docs, bench).collect()[0]["n_hit"] == 0
    assert D.decontaminate(docs, bench).columns == docs.columns
    assert D.digest(documents([]), bench).count() == 0


def test_query_matches_brute_force(spark, sf):
    import pyarrow.parquet as pq

    from stagewise.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    got = QUERIES["op6_decontamination"](spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, items))


def test_sql_matches_brute_force(tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    docs, items = cases(7)
    columns = lambda rows, key: pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    pq.write_table(columns(docs, "doc_id"), tmp_path / "documents.parquet")
    pq.write_table(columns(items, "item_id"), tmp_path / "benchmark.parquet")
    for folder, own in ((tmp_path, brute(docs, items)), ("/root/testdata/sf0.01", None)):
        con = duckdb.connect()
        tables = {}
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
            tables[name] = con.execute(f"SELECT {'doc_id' if name == 'documents' else 'item_id'}, text FROM {name}").fetchall()
        got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({D.ORACLE})").fetchall()
        assert sorted(got, key=str) == sorted(own or brute(tables["documents"], tables["benchmark"]), key=str)


@pytest.mark.parametrize("table, pattern", [(ALNUM, WORD), (NOT_SPACE, re.compile("[^\x20\x09-\x0d]+"))])
def test_kernels(table, pattern):
    texts = ["", None, "a b", "  é\x0bü ", "one", "\x00x", "Ab aB", "a" * 5000 + " b", " ", "x y"]
    col = pa.array(["skip", *texts]).slice(1)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    assert word_counts(col, table).tolist() == [len(pattern.findall(t)) for t in low]
    hashes, rows = word_hashes(col, table)
    flat = [w for t in low for w in pattern.findall(t)]
    assert len(hashes) == len(flat) == rows[-1]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
