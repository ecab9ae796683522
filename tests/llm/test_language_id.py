import math
import random
import zlib

import numpy as np
import pytest
from tables import DOCUMENTS, sf  # noqa: F401

from stagewise.llm import language_id as L
from stagewise.llm.queries import QUERIES

WORDS = {"aa": ["tion", "the", "ing", "of"], "bb": ["ñas", "ción", "el", "que"], "cc": ["schö", "und", "keit", "ä"]}


def sentence(lang, r, n=12):
    return " ".join("".join(r.choices(WORDS[lang], k=2)) for _ in range(n))


def net_of(seed=3, kind=np.float64, units=5):
    return L.Network.random(["aa", "bb", "cc"], units, seed, kind)


def plain(net, text, window):
    """Each byte's probabilities, one byte at a time; the mean over letter bytes."""
    data, units = text.lower().encode() if text.isascii() else bytes(L.LOWER[np.frombuffer(text.encode(), np.uint8)]), net.own.shape[2]
    sig = lambda x: 1 / (1 + np.exp(-x))
    found = []
    for at in range(0, len(data), window):
        part = data[at : at + window]
        odds = [np.zeros(len(net.langs)) for _ in part]
        for side in (0, 1):
            h = np.zeros(units)
            for t in range(len(part)):
                p = t if side == 0 else len(part) - 1 - t
                x, g = net.table[side][:, part[p]], net.own[side] @ h
                z, r = sig(x[:units] + g[:units]), sig(x[units : 2 * units] + g[units : 2 * units])
                new = np.tanh(x[2 * units :] + r * g[2 * units :])
                h = (1 - z) * new + z * h
                odds[p] = odds[p] + net.out[side] @ h
        for b, o in zip(part, odds):
            if chr(b).isalpha() and b < 128 or b >= 128:
                e = np.exp(o + net.bias[:, 0])
                found.append(e / e.sum())
    return np.mean(found, axis=0) if found else np.zeros(len(net.langs))


def test_positions_match_a_plain_recurrence():
    r = random.Random(1)
    texts = ["", "A", "12", "ñ", sentence("bb", r, 40), sentence("aa", r, 3), "Über 7 " * 30, "x" * 64, "y" * 65]
    net = net_of()
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    got = net.documents(buf, offsets, 16)
    assert np.allclose(got, [plain(net, t, 16) for t in texts], atol=1e-9)


def test_windows_cover_every_byte_once():
    offsets = np.array([0, 0, 5, 5, 21, 22])
    start, size, doc = L.windows(offsets, 8)
    seen = np.concatenate([np.arange(a, a + n) for a, n in zip(start, size)])
    assert sorted(seen) == list(range(22)) and (size <= 8).all()
    assert all(offsets[d] <= a and a + n <= offsets[d + 1] for a, n, d in zip(start, size, doc))


def test_gradients_match_differences():
    net = net_of(units=3)
    texts = [b"the k\xc3\xb6 1", b"und so", b"el"]
    size = np.array([len(t) for t in texts])
    symbols = np.zeros((size[0], 3), np.intp)
    for k, t in enumerate(texts):
        symbols[: len(t), k] = list(t)
    lang = np.array([2, 0, 1])
    _, grads = L.loss_and_gradients(net, symbols, size, lang)
    r = np.random.default_rng(0)
    for a, g in zip(net.arrays(), grads):
        used = np.argwhere(np.abs(g) > 0)
        for where in [tuple(x) for x in r.permutation(used)[:12]]:
            old = a[where]
            step = 1e-5
            a[where] = old + step
            up = L.loss_and_gradients(net, symbols, size, lang)[0]
            a[where] = old - step
            down = L.loss_and_gradients(net, symbols, size, lang)[0]
            a[where] = old
            assert math.isclose(g[where], (up - down) / (2 * step), rel_tol=1e-4, abs_tol=1e-9)


@pytest.fixture(scope="module")
def learnt(spark):
    r = random.Random(2)
    rows = [(k, sentence(lang, r), lang, "src", 0) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa", None, None), (1001, "", "aa", None, None), (1002, "123 --", "aa", "s", 1), (1003, sentence("cc", r, 4000), None, "s", 1), (None, sentence("bb", r), "bb", "s", 1)]
    rows += [rows[0], (1004, sentence("aa", r).upper(), "cc", "s", 1), (1005, "é", "bb", "s", 1)]
    frame = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS known", "'x' AS _0", "2 AS score")
    return rows, {}, L.digest(frame, steps=60).collect()


def test_every_row_is_predicted(learnt):
    rows, _, got = learnt
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        d = r["doc_id"]
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1


def test_odd_texts(learnt):
    by = {r["doc_id"]: r for r in learnt[2]}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "cc" and by[None]["lang_pred"] == "bb" and by[1004]["lang_pred"] == "aa"
    assert by[1005]["lang_pred"] in WORDS


def test_predictions_hold(learnt):
    rows, _, got = learnt
    want = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)


def test_nothing_to_learn_from(spark):
    rows = [(k, "some text", None, "s", 1) for k in range(5)]
    assert {tuple(r[1:]) for r in L.digest(spark.createDataFrame(rows, DOCUMENTS)).select("doc_id", "lang_pred", "score").collect()} == {("und", 0.0)}
    assert L.digest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    one = L.digest(spark.createDataFrame([(k, "some text", "xx", "s", 1) for k in range(9)], DOCUMENTS)).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(held) > 150 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
