import zlib
from collections import Counter

from tables import documents, sf  # noqa: F401

from stagewise.llm import sharding as S


def test_contract(spark, documents):
    rows = [(k, f"text {k}" * (k % 7)) for k in range(600)] + [(None, None), (None, ""), (5, "again"), (5, "again"), (601, "é" * 4000)]
    got = S.digest(documents(rows)).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by_shard, place = {}, {}
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert place.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 1 <= sum(r["grown_shard"] == 40 for r in got) <= 40


def test_weights_and_few_moves(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    share = lambda w: Counter(r["shard"] for r in S.with_shard(docs, w).select("shard").collect())
    n = share([1.0, 2.0, 0.0, 1.0])
    assert n[2] == 0 and abs(n[1] - 10000) < 500 and abs(n[0] - 5000) < 400
    moved = S.with_shard(S.with_shard(docs, [1.0] * 9, name="a"), [1.0] * 10, name="b").where("a <> b")
    assert moved.where("b <> 9").count() == 0 and 1700 < moved.count() < 2300


def test_empty_and_clashing_columns(spark, documents):
    assert S.digest(documents([])).count() == 0
    docs = documents([(1, "a")]).selectExpr("*", "9 AS shard", "'k' AS key", "3 AS part")
    assert S.digest(docs).count() == 1
    assert S.with_shard(docs).columns == docs.columns


def test_reruns_agree(spark, sf):
    from stagewise.llm.queries import QUERIES

    run = lambda: sorted(map(tuple, QUERIES["op7_sharding"](spark, sf).collect()))
    assert run() == run()
