import hashlib
import random

from sql_check import same
from tables import sf  # noqa: F401

from stagewise.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def make(seed):
    r = random.Random(seed)
    odd = [r"\### Assistant: </turn> ok", "<turn user>x</turn>", "\\l\\b\\\\g", "", None, "é" * 700, "line\nline\r\n", " <> "]
    rows = []
    for conv in range(25):
        start = [(conv, 0, "system", "be brief " * r.randrange(20))] if r.random() < 0.5 else []
        rows += start
        for k in range(r.randrange(1, 14)):
            text = r.choice(odd) if r.random() < 0.3 else "some words " * r.randrange(60)
            rows.append((conv, k + 1, ["user", "assistant", "tool<>", None][r.choice([0, 0, 1, 1, 1, 2, 3])], text))
    return [*rows, (90, 1, "system", "alone"), (None, 1, "user", "a"), (None, None, "assistant", "b"), (91, 1, "assistant", "x"), (91, 1, "assistant", "x")]


def told(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = make(1)
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS part", "2 AS pos")
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.digest(frame).collect()}
    said = r"\### Assistant: </turn> ok"
    assert got == told([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_windows(spark):
    rows = make(2)
    parts = {}
    for r in C.windows(spark.createDataFrame(rows, TURNS), budget=120, history=40).collect():
        parts.setdefault(r["conv_id"], []).append(r)
    later = 0
    for conv, found in parts.items():
        found.sort(key=lambda r: r["part"])
        head = found[0]["formatted"].split("</turn>")[0]
        for k, r in enumerate(found):
            turns = r["formatted"].split("</turn>")[:-1]
            assert r["formatted"].count("<") == 2 * len(turns)
            if k and head.startswith("<turn system>"):
                assert turns[0] == head and r["n_repeated"] >= 1
            later += k > 0 and r["n_repeated"] > 1
            if len(turns) - r["n_repeated"] > 1 and not head.startswith("<turn system>"):
                assert r["tokens"] <= 120
            learnt = [t for t in turns[r["n_repeated"] :] if t.startswith("<turn assistant>")]
            assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == [t[16:] for t in learnt]
    assert later > 5 and max(map(len, parts.values())) > 4


def test_empty(spark):
    assert [r["conv_id"] for r in C.digest(spark.createDataFrame([], TURNS)).collect()] == [-7]
    assert C.windows(spark.createDataFrame([], TURNS)).count() == 0


def test_query_matches_sql(spark, sf):
    assert same(spark, "op9_chat_formatting", sf) > 20


def test_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(make(3), TURNS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(C.ORACLE)
    names = [d[0] for d in want.description]
    got = C.digest(spark.read.parquet(str(tmp_path / "conversations.parquet"))).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_plan_has_no_python(spark, sf):
    plan = C.windows(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
