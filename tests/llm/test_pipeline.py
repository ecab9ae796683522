from collections import Counter

import pytest
import test_decontamination
import test_jaccard_join
import test_mixing

import corpus_pipeline
from stagewise.llm import quality, sharding
from stagewise.llm.scratch import staged


@pytest.fixture(scope="module")
def passed(spark):
    """Every stage's input and output rows on the smallest tables."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = staged(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-copies", "decontaminate", "mix", "shard"]


def test_quality_decisions_hold(spark, passed):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality.score(docs, quality.fit(docs, labels), ["doc_id"]).where(f"tail >= {quality.KEEP_FROM}")
    assert ids(passed[1]) == ids(kept.collect()) and len(passed[1]) < len(passed[0])


def test_one_of_each_group_stays(passed):
    want = test_jaccard_join.brute([(r["doc_id"], r["text"]) for r in passed[1]])
    assert ids(passed[2]) == sorted(d for d, _, c in want if d == c) and len(passed[2]) < len(passed[1])


def test_contaminated_documents_leave(spark, passed):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = test_decontamination.brute([(r["doc_id"], r["text"]) for r in passed[2]], items)
    assert ids(passed[3]) == sorted(w[0] for w in want if not w[-1])


def test_mix_takes_whole_documents_near_the_targets(passed):
    times = Counter(r["doc_id"] for r in passed[4])
    assert set(times.values()) <= {1, 2} and set(times) <= set(ids(passed[3]))
    size = lambda r: len(test_mixing.WORD.findall(r["text"] or ""))
    by_source, taken, widest = Counter(), Counter(), Counter()
    for r in passed[3]:
        by_source[r["source"]] += size(r)
        taken[r["source"]] += size(r) * times[r["doc_id"]]
        widest[r["source"]] = max(widest[r["source"]], size(r))
    for source, target in test_mixing.brute_targets(by_source).items():
        assert abs(taken[source] - target) <= widest[source]


def test_shards(spark, passed):
    assert Counter(r["doc_id"] for r in passed[5]) == Counter(r["doc_id"] for r in passed[4])
    assert {r["shard"] for r in passed[5]} <= set(range(sharding.SHARDS))


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    """Each stage keeps all columns, whatever their names; one row of each group stays, with or without an id."""
    passage = " ".join(f"bench{k}" for k in range(20))
    texts = [(1, "these words stand in three rows that are all the same")] * 3
    texts += [(None, "these other words belong to rows that have no id at all")] * 2
    texts += [(5, None), (6, ""), (9, passage), (12, "a text of its own that nothing else in here repeats"), (-4, "ÜBER 123 !?")]
    more = "1 AS row, 2 AS whole, 3 AS size, 4 AS copies, 5 AS hash, 6 AS tail, 7 AS part, 8 AS n, 9 AS gone, 10 AS equal, 11 AS shard"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *more.split(", ")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, passage), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        at = staged(stage(spark, at, str(tmp_path)), f"test-{name}")
        kept[name] = sorted(str(r["doc_id"]) for r in at.collect())
        assert at.columns == columns
    assert kept["quality"] == sorted(str(d) for d, _ in texts)
    assert kept["near-copies"] == sorted(["1", "None", "5", "6", "9", "12", "-4"])
    assert kept["decontaminate"] == sorted(["1", "None", "5", "6", "12", "-4"])
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and kept["shard"] == kept["mix"]
    assert all(0 <= r["shard"] < sharding.SHARDS for r in at.collect())


def test_run_on_empty_tables(spark, tmp_path):
    for name, kind in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
