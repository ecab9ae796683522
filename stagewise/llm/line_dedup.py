"""Line dedup with a once-seen and a twice-seen Bloom filter.

Pass 1: each task sends the distinct line hashes of its documents, packed, to
the owner of their part of the filters. The owner reads them one packet after
the other: a hash whose bits are all in the once-seen filter goes into the
twice-seen filter too. Only the twice-seen filter comes back; its size is
bounded by ``max_bits`` and its parts are compressed.

Pass 2: only keys that the twice-seen filter knows are shuffled (as 128-bit
digests, with the document's id): suspected repeats. Their documents are
counted exactly, and the document that keeps the line is chosen.

Pass 3: documents meet the digests that they lose and drop those lines.

A filter that fills up lets more keys through to pass 2; the result stays
exact. The number of documents of a very common line is added up before the
shuffle, and adaptive execution can split its rows when they meet the chosen
document.

Defined results: a null or empty text is one empty line; documents are
distinct ids, null being one id and the smallest; equal rows of one id are one
document and lose or keep a line together; an empty table gives an empty one;
only the id and the text are read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix
from .scratch import staged

MIN_POINTS = 20
MIN_DOCS = 3
PROBES = 4
PARTS = 64
MAX_BITS = 1 << 28
PACKET = 1 << 18

_SPACE = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z in lower case."""
    line = line.strip(_SPACE)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def _keys(text: str | None, least: int) -> list[str | None]:
    """A key for each line; None for one too short to be dropped."""
    keys = map(line_key, (text or "").split("\n"))
    return [k if len(k) >= least else None for k in keys]


def _digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(hash, probe) bit numbers within a part of ``bits`` bits, a power of two."""
    second = mix(hashes) | np.uint64(1)
    return ((hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * second[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(math.log2(PARTS)))).astype(np.int64)


def _first_eight(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2]


def _sender(least: int) -> Callable:
    """Packets of distinct hashes by part; hashes of several documents of the task are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if not seen:
                return
            hashes, count = _first_eight(list(seen)), np.fromiter(seen.values(), np.int64, len(seen))
            part = _part(hashes)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            groups = np.split(order, cut)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[g[0]]) for g in groups], pa.int32()),
                    pa.array([hashes[g].tobytes() for g in groups], pa.binary()),
                    pa.array([np.packbits(count[g] > 1).tobytes() for g in groups], pa.binary()),
                ],
                ["part", "hashes", "again"],
            )
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update({_digest(k) for k in _keys(text.as_py(), least) if k is not None})
                if len(seen) >= PACKET:
                    yield from flush()
        yield from flush()

    return run


def _owner(bits: int) -> Callable:
    """The two filters of the parts of a partition; the twice-seen one comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed, again in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes = np.frombuffer(packed, np.uint64)
                if part not in once:
                    once[part], twice[part] = np.zeros(bits, bool), np.zeros(bits, bool)
                places = _places(hashes, bits)
                marked = np.unpackbits(np.frombuffer(again, np.uint8), count=len(hashes)).astype(bool)
                twice[part][places[marked | once[part][places].all(axis=1)].ravel()] = True
                once[part][places.ravel()] = True
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = sorted(twice)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([squeeze(np.packbits(twice[p]).tobytes()) for p in parts], pa.binary())], ["part", "twice"])

    return run


def _known(filters: dict[int, bytes], bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which hashes the twice-seen filter knows."""
    open_ = zstandard.ZstdDecompressor().decompress
    table = np.zeros((PARTS, bits // 8), np.uint8)
    for part, packed in filters.items():
        table[part] = np.frombuffer(open_(packed), np.uint8)

    def ask(hashes: np.ndarray) -> np.ndarray:
        places = _places(hashes, bits)
        return ((table[_part(hashes)[:, None], places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)

    return ask


def _suspects(filters, bits: int, least: int, id_type: pa.DataType | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _known(filters.value, bits)
        for batch in batches:
            rows: list[int] = []
            found: list[bytes] = []
            for row, text in enumerate(batch.column(1)):
                own = {_digest(k) for k in _keys(text.as_py(), least) if k is not None}
                rows += [row] * len(own)
                found += own
            if found:
                known = np.flatnonzero(ask(_first_eight(found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.asarray(rows)[known])), pa.array([found[k] for k in known], pa.binary())], ["id", "key"]
                )

    return run


def _dropper(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                text, lost = text.as_py() or "", lost.as_py()
                lines = text.split("\n")
                if lost:
                    lost = set(lost)
                    kept = [x for x, k in zip(lines, _keys(text, least), strict=True) if k is None or _digest(k) not in lost]
                else:
                    kept = lines
                out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            n, dropped, kept = zip(*out, strict=True) if out else ((), (), ())
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                ["id", "n_lines", "n_dropped", "kept", "kept_sha256"],
            )

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``id_col``, ``n_lines``, ``n_dropped``, ``kept`` (the text without its lost lines) and ``kept_sha256``."""
    if min_docs < 2:
        raise ValueError("a line must be in two documents at least to be a repeat")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # A line that can be dropped has min_points bytes or more; eight bits for each that could be there.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(1 << 16, 1 << math.ceil(math.log2(max(1, 8 * size // max(1, min_points)) + 1)))) // PARTS
    packets = rows.select("text").mapInArrow(_sender(min_points), "part int, hashes binary, again binary")
    filters = packets.repartitionById(PARTS, F.col("part")).mapInArrow(_owner(bits), "part int, twice binary")
    known = spark.sparkContext.broadcast({r["part"]: bytes(r["twice"]) for r in filters.collect()})  # max_bits / 8 bytes at most
    suspects = staged(rows.mapInArrow(_suspects(known, bits, min_points), f"id {kind}, key binary"), "line-suspects")
    per_doc = suspects.groupBy("key", "id").agg(F.lit(1).alias("one"))
    repeats = per_doc.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeps")).where(F.col("n") >= min_docs).select("key", "keeps")
    repeats = staged(repeats, "line-repeats")
    lost = suspects.join(repeats, "key").where(~F.col("id").eqNullSafe(F.col("keeps"))).groupBy("id").agg(F.collect_set("key").alias("lost"))
    lost = staged(lost.withColumnRenamed("id", "of"), "line-lost")
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "lost")
    return met.mapInArrow(_dropper(min_points), f"id {kind}, n_lines bigint, n_dropped bigint, kept string, kept_sha256 string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeats AS (
  SELECT key, max(doc_id) AS keeps FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, repeats.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM repeats.keeps AS dropped
  FROM keyed LEFT JOIN repeats ON keyed.key = repeats.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r
"""
