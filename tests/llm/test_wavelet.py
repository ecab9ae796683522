import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tables import documents, sf  # noqa: F401

from stagewise.llm import wavelet as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def odd_texts(seed, n=150):
    r = random.Random(seed)
    pool = ["it's", "WE'LL", "é", "́", "Ä", "ß", "İ", "ΑΣ", "<|endoftext|>", "<|startoftext|", "|>", "\x1c", "\x85", " ", " ", "\t", "\r", "123", "日本", "😀", "...", "\x00", "'", "'s", "word", "Word", "ÀÉÿ", "µª", "²", "a.", "b,", "c!?", "wo$$$", "x'", "don't.", "e-f", "g)(", "Éé@#", "(h", "i;j", "<|ENDOFTEXT|>", "ﬁ", "​"]
    glue = ["", " ", "\n", "  ", " \n"]
    return ["".join(r.choice(pool) + r.choice(glue) for _ in range(r.randrange(12))) for _ in range(n)]


def test_chunks_encode_like_whole_texts(plain):
    texts = odd_texts(1, 1500)
    encode = W.ChunkEncoder(PATH, cache_chunks=300)
    for at in range(0, len(texts), 100):
        ids, sizes = encode(pa.array(texts[at : at + 100]))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for text, got in zip(texts[at : at + 100], parts, strict=True):
            assert got.tolist() == plain(text)[:-1], repr(text)


@pytest.mark.parametrize("high, n", [(2, 500), (40000, 1000), (1 << 20, 300), (1, 64), (9, 0)])
def test_access_count_select(high, n):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    sizes = [n // 2, 0, n - n // 2]
    shard = W.WaveletShard(W.pack(ids, sizes, [5, None, -7], block_bits=64))
    assert shard.names == [5, None, -7] and shard.sizes.tolist() == sizes
    assert shard.decode().tolist() == ids.tolist()
    for at in range(0, n, 17):
        assert shard.access(at) == ids[at]
    for token in {*ids[:20].tolist(), high + 5}:
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where)
        assert shard.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        assert [shard.select(token, k) for k in range(len(where))] == where.tolist()
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(high + 5, 0)


def brute(rows, plain):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray(plain(text), "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_files_round_trip(spark, documents, plain, tmp_path):
    rows = [(k * 3, t) for k, t in enumerate(odd_texts(2))] + [(7, None), (None, "no id"), (10_000, "long word list " * 4000)]
    docs = documents(rows).repartition(5).selectExpr("*", "1 AS start", "2 AS name")
    manifest = W.write_shards(docs, PATH, folder=str(tmp_path / "shards"), shard_tokens=200, tasks=3)
    assert len(list((tmp_path / "shards").iterdir())) == manifest.count() > 4
    # The folder has no scheme; the files are named with that of Spark's default file system.
    assert all(r["path"].startswith("file:/") for r in manifest.collect())
    got = sorted(map(tuple, W.read_shards(manifest).collect()), key=lambda r: r[1])
    assert got == brute(rows, plain)


def test_repeated_rows_and_empty_table(spark, documents, plain):
    rows = [(1, "same text"), (1, "same text"), (1, "other"), (0, "")]
    got = sorted(map(tuple, W.digest(documents(rows), PATH).collect()), key=lambda r: r[1])
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows, plain))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist() and got[0][0] == 0
    assert W.digest(documents([]), PATH).count() == 0


def test_query(spark, sf, plain):
    import pyarrow.parquet as pq

    from stagewise.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = sorted(map(tuple, QUERIES["op2_wavelet_tokens"](spark, sf).collect()), key=lambda r: r[1])
    assert got == brute(rows, plain)
