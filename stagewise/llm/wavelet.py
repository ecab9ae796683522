"""Token ids as wavelet matrices, one compressed file per shard.

Documents are dealt to tasks by ranges of their id and sorted there. A task
encodes whole texts and closes a shard when it holds ``shard_tokens`` tokens
or somewhat more (documents are not split, so a longer one makes a shard of its own). A shard's
token sequence becomes a wavelet matrix: one bit-plane for each bit of the ids,
from the highest; each plane lists the sequence's bits in the order that the
planes above left, zeros before ones. Planes are cut into blocks, each with the
number of ones before it and compressed by itself, so access, counting and
occurrence lookup read one block of each plane.

Files are written through Arrow's file systems below the shared folder, under a
name of the attempt's own; the manifest names the files of the attempts that
Spark committed, and nothing else is read. Starts come from sums per task and
the shards before within it, never from one task over all documents.

Defined results: a null text is an empty one and has the end id alone; rows are
ordered by id (null first) and then by a hash of the text, so equal rows are
neighbours with a place each; an empty table writes no file; further columns
are not read. Texts are cut at blanks and line feeds for a cache of encoded
chunks: the vocabulary's words never reach across white space.
"""

from __future__ import annotations

import functools
import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import LOWER, slices, utf8, word_spans
from .scratch import new_path, qualified, shuffle_width, staged

END_ID = 1
SHARD_TOKENS = 1 << 21
BLOCK_BITS = 1 << 16
CACHE_CHUNKS = 600_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 4 << 20
MAGIC = b"WMTOK1\0\0"
#: Tokens, documents, planes, bits in a block, bytes of the directory.
_HEAD = struct.Struct("<8sQQIIQ")

MANIFEST = "task int, shard int, path string, n_docs bigint, n_tokens bigint"


class _Ids:
    """Growing lists of ids by number."""

    def __init__(self) -> None:
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])


class _Learnt:
    """Strings with their ids, in the order in which they were learnt."""

    def __init__(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), _Ids()

    def numbers(self, strings: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each string; those that are new are encoded, each once."""
        coded = strings.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        if at.null_count:
            new = coded.dictionary.filter(pc.is_null(at))
            first = len(self.known)
            self.ids.add(*encode(new.to_pylist()))
            self.known = pa.concat_arrays([self.known, new])
            fresh = np.full(len(at), -1)
            fresh[pc.is_null(at).to_numpy(zero_copy_only=False)] = first + np.arange(len(new))
            at = np.where(fresh >= 0, fresh, pc.fill_null(at, 0).to_numpy(zero_copy_only=False))
        else:
            at = at.to_numpy(zero_copy_only=False)
        return at.astype(np.int64)[coded.indices.to_numpy()]


class ChunkEncoder:
    """Encodes texts with a tokenizers file; what stands between blanks is encoded once while the cache holds it.

    Most chunks are a run of letters up to U+00FF, perhaps with ASCII signs behind.
    They are put in lower case and cut before the signs, as the tokenizer does;
    a run is one word of the tokenizer, so many are encoded in one string and
    taken apart where a token ends a word. Other chunks are encoded as they are.
    All of this works on the bytes of many texts at once; only strings that the
    cache lacks become Python objects.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_chunks
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        if not self.ends.any():
            raise ValueError(f"{path}: a vocabulary whose words end in </w> is needed")
        self.cores, self.others = _Learnt(), _Learnt()

    def _as_they_are(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _words(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, encoded 256 in a string."""
        joined = [" ".join(strings[k : k + 256]) for k in range(0, len(strings), 256)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(strings):
            raise ValueError("the tokenizer does not take a run of letters as one word")
        return ids, np.diff(np.append(0, ends))

    @staticmethod
    def _letters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes belong to letters up to U+00FF, and all bytes with these in lower case."""
        low = LOWER[buf]
        letter = (low >= 97) & (low <= 122)
        second = buf[1:]
        wide = (buf[:-1] == 0xC3) & (second != 0x97) & (second != 0xB7)
        signs = (buf[:-1] == 0xC2) & ((second == 0xAA) | (second == 0xB5) | (second == 0xBA))
        for lead in (wide, signs):
            letter[:-1] |= lead
            letter[1:] |= lead
        upper = np.flatnonzero(wide & (second < 0x9F)) + 1
        low[upper] += 0x20
        return letter, low

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text's; null reads as empty."""
        for learnt in ("cores", "others"):
            if len(getattr(self, learnt).known) > self.limit:
                setattr(self, learnt, _Learnt())
        buf, offsets = utf8(texts)
        starts, ends, rows = word_spans(buf, offsets, _NOT_BLANK)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        letter, low = self._letters(buf)
        # Bytes that are no letters, and 2 ** 16 for each that is no sign either or has a letter behind it.
        odd = ~letter & _NOT_BLANK[buf]
        bad = odd & ~_SIGN[buf]
        bad[:-1] |= odd[:-1] & letter[1:] & ~_first(offsets, len(buf))[1:]
        behind = np.add.reduceat(odd + (bad.astype(np.int32) << 16), starts, dtype=np.int64)
        plain = behind < np.minimum(ends - starts, 1 << 16)
        stops = np.where(plain, ends - behind, ends)
        signed = np.flatnonzero(plain & (behind > 0))
        sizes, tables = np.zeros((len(starts), 2), np.int64), []
        for learnt, encode, data, which, part, a, b in (
            (self.cores, self._words, low, np.flatnonzero(plain), 0, starts, stops),
            (self.others, self._as_they_are, buf, np.flatnonzero(~plain), 0, starts, ends),
            (self.others, self._as_they_are, buf, signed, 1, stops, ends),
        ):
            if len(which):
                number = learnt.numbers(_strings(data, a[which], b[which]), encode)
                first = learnt.ids.starts[number]
                sizes[which, part] = learnt.ids.starts[number + 1] - first
                tables.append((learnt, 2 * which + part, first))
        flat = sizes.ravel()
        to = np.append(0, np.cumsum(flat))
        out = np.empty(int(to[-1]), np.uint32)
        for learnt, units, first in tables:
            n = flat[units]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[units], n) + step] = learnt.ids.ids[np.repeat(first, n) + step]
        return out, np.diff(to[2 * rows])


#: Signs that may stand behind a run of letters: all of ASCII but letters, digits, blanks and control characters.
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN[0x30:0x3A] = _SIGN[0x41:0x5B] = _SIGN[0x61:0x7B] = False
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[0x20, 0x0A]] = False


def _first(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which bytes begin a text."""
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out[:n]


def _strings(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Ascending byte ranges as strings."""
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    mark[stops] -= 1  # a range may begin where another stops
    data = buf[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """The encoder of a Python worker, with what its earlier tasks have learnt."""
    return ChunkEncoder(path)


def pack(ids: np.ndarray, sizes: np.ndarray, names: list, block_bits: int = BLOCK_BITS) -> bytes:
    """The file of one shard: ids of all its documents, their sizes and their names (None or int)."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    body, directory, at = [], [], 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        packed = squeeze(data)
        body.append(packed)
        at += len(packed)
        return at - len(packed), len(packed)

    known = np.fromiter((n is not None for n in names), bool, len(names))
    heads = [put(np.asarray(sizes, "<u8").tobytes()), put(np.fromiter((n or 0 for n in names), "<i8", len(names)).tobytes()), put(np.packbits(known).tobytes())]
    for bit in range(planes - 1, -1, -1):
        ones = (seq >> bit) & 1 == 1
        ranks = 0
        for b in range(0, max(len(seq), 1), block_bits):
            part = ones[b : b + block_bits]
            directory.append((*put(np.packbits(part).tobytes()), ranks))
            ranks += int(part.sum())
        directory.append((0, 0, ranks))
        seq = np.concatenate([seq[~ones], seq[ones]])
    index = np.asarray([*((a, n, 0) for a, n in heads), *directory], "<u8").tobytes()
    return _HEAD.pack(MAGIC, len(ids), len(names), planes, block_bits, len(index)) + index + b"".join(body)


class WaveletShard:
    """Reads a shard's file, block by block: ``access``, ``count``, ``select``, or ``decode`` for all of it."""

    def __init__(self, file):
        self.file = io.BytesIO(file) if isinstance(file, bytes) else file
        magic, self.n_tokens, self.n_docs, self.planes, self.block_bits, size = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        index = np.frombuffer(self._read(_HEAD.size, size), "<u8").reshape(-1, 3).astype(np.int64)
        self.base = _HEAD.size + size
        self.heads, rest = index[:3], index[3:]
        self.blocks = rest.reshape(self.planes, -1, 3)
        self.open = zstandard.ZstdDecompressor().decompress
        self.sizes = np.frombuffer(self._part(self.heads[0]), "<u8").astype(np.int64)
        known = np.unpackbits(np.frombuffer(self._part(self.heads[2]), np.uint8), count=self.n_docs).astype(bool)
        self.names = [int(n) if k else None for n, k in zip(np.frombuffer(self._part(self.heads[1]), "<i8"), known, strict=True)]
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _part(self, entry) -> bytes:
        return self.open(self._read(self.base + int(entry[0]), int(entry[1]))) if entry[1] else b""

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.cache:
            n = min(self.block_bits, self.n_tokens - block * self.block_bits)
            if len(self.cache) > 64 * self.planes:
                self.cache.clear()
            self.cache[plane, block] = np.unpackbits(np.frombuffer(self._part(self.blocks[plane, block]), np.uint8), count=n)
        return self.cache[plane, block]

    def _zeros(self, plane: int) -> int:
        return self.n_tokens - int(self.blocks[plane, -1, 2])

    def _rank(self, plane: int, at: int) -> int:
        """Ones of the plane before ``at``."""
        block, rest = divmod(at, self.block_bits)
        ones = int(self.blocks[plane, block, 2])
        return ones + int(self._bits(plane, block)[:rest].sum()) if rest else ones

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Where the plane's k-th (from 0) bit of this value stands."""
        begin = np.arange(self.blocks.shape[1]) * self.block_bits
        ones = self.blocks[plane, :, 2]
        before = ones if bit else np.minimum(begin, self.n_tokens) - ones
        block = int(np.searchsorted(before[:-1], k, side="right")) - 1
        return block * self.block_bits + int(np.flatnonzero(self._bits(plane, block) == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        token = 0
        for plane in range(self.planes):
            block, rest = divmod(at, self.block_bits)
            bit = int(self._bits(plane, block)[rest])
            ones = self._rank(plane, at)
            at = self._zeros(plane) + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for plane in range(self.planes):
            bit = token >> (self.planes - 1 - plane) & 1
            a, b = self._rank(plane, start), self._rank(plane, stop)
            start, stop = (self._zeros(plane) + a, self._zeros(plane) + b) if bit else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token stands in [start, stop)."""
        if token < 0 or token >> self.planes:
            return 0
        a, b = self._range(token, start, self.n_tokens if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n_tokens)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._place(plane, bit, at - self._zeros(plane) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        out = np.zeros(self.n_tokens, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            packed = [self._part(x) for x in self.blocks[plane, :-1]]
            ones = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8)) for p in packed])[: self.n_tokens].astype(bool) if packed else np.zeros(0, bool)
            zeros = self.n_tokens - int(ones.sum())
            above = np.empty_like(out)
            above[~ones] = out[:zeros]
            above[ones] = out[zeros:] | (1 << (self.planes - 1 - plane))
            out = above
        return out.astype(np.uint32)


def _writer(folder: str, tokenizer: str, shard_tokens: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        encode = _encoder(tokenizer)
        names: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            size = np.concatenate(sizes)
            data = pack(np.concatenate(ids), size, names)
            store, path = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
            name = f"tokens-{task:06d}-{shard:06d}-{uuid.uuid4().hex[:12]}.wm"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            row = [[task], [shard], [f"{folder}/{name}"], [len(names)], [int(size.sum())]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            shard, held = shard + 1, 0
            names.clear()
            ids.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["task", "shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for a, b in slices(batch.column(1), min(ENCODE_BYTES, 4 * shard_tokens)):
                got, size = encode(batch.column(1).slice(a, b - a))
                names += batch.column(0).slice(a, b - a).to_pylist()
                ids.append(np.insert(got, np.cumsum(size), end_id))
                sizes.append(size + 1)
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    return run


def _opened(path: str):
    store, inner = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with _opened(path) as file:
                shard = WaveletShard(file)
                ids = shard.decode().astype("<u4")
            edge = np.concatenate([[0], np.cumsum(shard.sizes)])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.names, pa.int64()), pa.array(start + edge[:-1], pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(crc, pa.int64())],
                ["name", "start", "n_tokens", "ids_crc32"],
            )


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, tasks: int | None = None) -> DataFrame:
    """Encode all texts into shard files below ``folder``; the manifest, with each shard's ``start`` in ascending id order.

    ``tokenizer`` is a path that every executor can read; ``tasks`` the number
    of ranges (by default the session's shuffle partitions, or one for each
    128 MB of text if that is more).
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "wavelet"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = tasks or max(shuffle_width(spark), size // (128 << 20) + 1)
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, "name", "tie").sortWithinPartitions("name", "tie").select("name", "text")
    manifest = staged(dealt.mapInArrow(_writer(folder, tokenizer, shard_tokens, end_id), MANIFEST), "wavelet-manifest")
    # Running sums in two steps: over tasks, and over the shards of a task.
    per_task = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    per_task = per_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("n_tokens")
    return manifest.withColumn("own", own).join(per_task, "task").select("task", "shard", "path", "n_docs", "n_tokens", (F.col("before") + F.col("own")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """From the files: ``name``, ``start``, ``n_tokens``, ``ids_crc32`` of every document."""
    dealt = manifest.select("path", "start").repartition(shuffle_width(manifest.sparkSession), "path")
    return dealt.mapInArrow(_reader, "name bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns."""
    return read_shards(write_shards(docs, tokenizer)).withColumnRenamed("name", "doc_id")
