import hashlib
import random

import pytest
from sql_check import same
from tables import documents, sf  # noqa: F401

from stagewise.llm import line_dedup as L


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc_id)
    keeps = {k: max(v, key=lambda x: -1 if x is None else x) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeps.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed):
    r = random.Random(seed)
    pool = [f"A Line that repeats, number {k} é" for k in range(6)] + ["short", "", "x" * 19, "y" * 20, "É" * 20, "é" * 20, "\x85" + "n" * 19]
    rows = []
    for k in range(60):
        lines = [r.choice([" ", "\t", "", "\x0c"]) + (c.upper() if r.random() < 0.3 else c) + r.choice(["", "\r", " "]) for c in r.choices(pool, k=r.randrange(6))]
        rows.append((k, "\n".join([*lines, f"only in document number {k}"])))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (None, pool[0]), (None, pool[0]), (3, rows[3][1]), (7, "y" * 20)]


@pytest.mark.parametrize("max_bits", [L.MAX_BITS, 64 * 8])
def test_matches_brute_force(spark, documents, max_bits):
    rows = make(1)
    got = L.dedup_lines(documents(rows).repartition(5), max_bits=max_bits)
    have = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=str)
    assert have == brute(rows)


def test_cleaned_text_and_edges(spark, documents):
    line = "this line stands in three documents"
    got = {r["doc_id"]: r["kept"] for r in L.dedup_lines(documents([(1, f"a\n{line}"), (2, f"{line}\nb"), (3, f"{line}\n{line}\nc")])).collect()}
    assert got == {1: "a", 2: "b", 3: f"{line}\n{line}\nc"}
    assert L.digest(documents([])).count() == 0
    assert L.digest(documents([(1, "t")]).selectExpr("*", "1 AS key", "2 AS id", "3 AS lost")).count() == 1


def test_query_matches_sql(spark, sf):
    assert same(spark, "op8_line_dedup", sf) == 200
