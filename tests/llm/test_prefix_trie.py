import hashlib
import random
import zlib

import pytest
from sql_check import same
from tables import sf  # noqa: F401

from stagewise.llm import prefix_trie as T

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    if rebuild:
        old = convs
        convs = {}
        for c, own in old.items():
            h = zlib.crc32(str(c).encode()) % 9
            giver = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
            convs[c] = old.get(giver, [])[:h] + own[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), set()).add(c)
    weight = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in nodes.items()}
    leaves, saved, kids = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += weight[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS part", "2 AS depth", "'x' AS digest")
    return sorted(map(tuple, T.digest(frame, **options).select(*COLUMNS).collect()), key=str)


def make(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c - 7, turn, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = make(seed)
    assert run(spark, rows) == brute(rows)


def test_small_chunks_jump_pointers(spark):
    rows = make(3, 40)
    assert run(spark, rows, chunk_nodes=7) == brute(rows)


def test_hot_groups(spark):
    """A third of the conversations are equal, and one holds a third of all turns."""
    rows = [(5 * c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(400)] + [(5 * c + 1000, t, "user", f"{c} {t}") for c in range(1, 60) for t in range(4)]
    assert run(spark, rows, chunk_nodes=50) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 0, "user", "ünï"), (1, 0, "", ""), (2, 7, "user", None), (2, 7, "assistant", "b"), (-3, 0, "user", "x"), (-5, 0, "user", "x" * 100_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:1]) == []
    # The giver is absent and h takes all own turns: a conversation without turns is a member of the root.
    lone = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert run(spark, [(lone, 0, "user", "gone")]) == brute([(lone, 0, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "us", "er"), (5, 0, "user", ""), (10, 0, "", "user")]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 4


def test_tour_places(spark):
    """Enter and exit places are a proper bracketing of the tree."""
    rows = make(4, 30)
    turns, convs = T.numbered(spark.createDataFrame(rows, ROWS))
    got = T.trie(turns, convs, chunk_nodes=11).collect()
    places = sorted([r["enter"] for r in got] + [r["exit"] for r in got])
    assert places == list(range(2 * len(got)))
    at = {(r["conv_id"], r["depth"]): r for r in got}
    for r in got:
        if r["depth"]:
            up = at[r["parent_conv_id"], r["depth"] - 1]
            assert up["enter"] < r["enter"] < r["exit"] < up["exit"]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) is not None
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows, rebuild=False)


def test_query_matches_sql(spark, sf):
    assert same(spark, "op11_conversation_trie", sf) > 20
