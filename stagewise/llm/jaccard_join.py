"""N-gram Jaccard join by a partitioned universe and the pigeonhole principle.

Documents are sets of word shingles, held as 64-bit hashes. Equal sets make one
class. Classes meet in size bands: band j holds sizes from 2 ** j on, and those
smaller ones that may link to such a size. A band cuts the universe of hashes
into 2 ** j segments (4096 below size 64). Two sets that link differ in at most
H = (a + b) * (100 - t) / (100 + t) shingles, so of any H + 1 segments one is
equal in both (or differs by one shingle, where a segment counts twice).

1. Every class sends a hash of each of its non-empty segments to the owner of
   that hash, packed. In the bands below 64 the one-deletion neighbourhoods of
   its segments go along.
2. Owners return the segments that several classes hold, with their number.
   Segments that a class holds alone cost nothing; if there are H + 1, nothing
   can link to it and it is done. Otherwise it asks with its cheapest shared
   segments, as many as are missing (with all and their neighbourhoods where a
   tiny set has too few segments).
3. Contraction: three segments of each class give one pair with the most
   central class there; verified pairs form components. This only saves work.
4. Owners get what the remaining classes ask and hold, and return the pairs of
   different components whose sizes and sketches do not rule a link out (a
   sketch counts shingles modulo 2 in 1024 cells; cells that differ are at most
   the shingles that differ).
5. All returned pairs are verified exactly on whole texts, and components are
   formed from all verified pairs. No pair is dropped: a pair within a component
   can add nothing to it.

Defined results: a null or empty text, or one without words, has no shingles
and is alone; fewer words than ``k`` make one shingle; equal texts link;
repeated rows link with each other; rows with a null id link, and the component
is named by the smallest id that is not null; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import NOT_SPACE, mix, slices, word_hashes
from .scratch import keyed_rows, shuffle_width, staged

K = 5
PERCENT = 75
#: Bands below this one hold sizes so small that their universe is cut finer, and their neighbourhoods are indexed.
SMALL_BAND, SMALL_BITS = 6, 12
SKETCH_BITS = 1024
PACKET = 1 << 20
#: Classes that a task remembers to have sent: one for each slot of a table.
SEEN = 1 << 16
#: A class's candidates are gathered in so many lists.
SLOTS = 4
#: Below this many surviving classes their ids (16 bytes each) are sent to all tasks; beyond, texts and ids are shuffled.
BROADCAST_ROWS = 500_000

_STEP = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in slices(col):
        words, rows = word_hashes(col.slice(a, b - a), NOT_SPACE)
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for i in range(k):
            grams += words[i : i + n] * _STEP[i]
        grams = mix(grams)
        for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            elif e > s:
                out.append(mix(np.array([(words[s:e] * _STEP[: e - s]).sum(dtype=np.uint64)]) ^ np.uint64(e - s)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def band(n: np.ndarray) -> np.ndarray:
    """The band of each size: floor(log2(n))."""
    return np.frexp(n.astype(float))[1].astype(np.int64) - 1


def largest_partner(n: np.ndarray, percent: int) -> np.ndarray:
    return n * 100 // percent


def most_different(n, band_, percent: int):
    """H: shingles that a set of this size can differ by from a partner in this band."""
    partner = np.minimum(largest_partner(n, percent), 2 ** (band_ + 1) - 1)
    return (n + partner) * (100 - percent) // (100 + percent)


def segment_hashes(sets: list[np.ndarray], percent: int, guest: bool, neighbours: bool = True) -> tuple[np.ndarray, ...]:
    """For sets in their own band, or as guests of the next one: (set, 64-bit hash, deletion?) of the non-empty segments."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    bands = band(np.maximum(n, 1)) + guest
    inside = (n > 0) & ((largest_partner(n, percent) >= 2**bands) if guest else True)
    n = np.where(inside, n, 0)
    own = np.repeat(np.arange(len(sets)), n)
    if not len(own):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(bool)
    all_ = np.concatenate([s for s, i in zip(sets, inside, strict=True) if i])
    segment = all_ >> (64 - np.where(bands < SMALL_BAND, SMALL_BITS, bands)[own]).astype(np.uint64)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    each = mix(all_ ^ np.uint64(0xA0761D6478BD642F))
    total = np.add.reduceat(each, first)
    tag = mix(segment[first] * np.uint64(64) + bands[own[first]].astype(np.uint64))
    sets_, hashes, deletion = [own[first]], [mix(total ^ tag)], [np.zeros(len(first), bool)]
    if neighbours:
        which = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(own)))
        pick = np.flatnonzero((size[which] > 1) & (bands[own] < SMALL_BAND))
        sets_.append(own[pick])
        hashes.append(mix((total[which[pick]] - each[pick]) ^ tag[which[pick]]))
        deletion.append(np.ones(len(pick), bool))
    return np.concatenate(sets_), np.concatenate(hashes), np.concatenate(deletion)


def _describe(percent: int, k: int) -> Callable:
    """(id, hash of the text, text) to what is known of a document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                sets = shingle_sets(texts.slice(a, b - a), k)
                n = [len(s) for s in sets]
                one = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                two = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                counts = []
                for guest in (False, True):
                    own, _, deletion = segment_hashes(sets, percent, guest, neighbours=False)
                    counts.append(np.bincount(own, minlength=len(sets)))
                sketches = [np.packbits(np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(counts[0]), pa.array(counts[1]), pa.array(sketches, pa.binary())],
                    ["id", "text_hash", "n", "k1", "k2", "own", "guest", "sketch"],
                )

    return run


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _segments(percent: int, k: int, buckets: int) -> Callable:
    """Texts to packets: by bucket, the classes and their keys (30 bits of the hash, the band's parity, deletion or not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SEEN, np.uint64)  # a class that comes again is sent again only if another took its slot
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            classes, bucket, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((classes, bucket))
            classes, bucket, keys = classes[order], bucket[order], keys[order]
            first, size = _runs(bucket)
            rows = []
            for at, n in zip(first, size, strict=True):
                own, count = _runs(classes[at : at + n])
                rows.append((int(bucket[at]), classes[at : at + n][own].tobytes(), count.astype(np.uint32).tobytes(), keys[at : at + n].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "classes", "counts", "keys"])

        size = 0
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                sets = []
                names = []
                for s in shingle_sets(texts.slice(a, b - a), k):
                    name = int(mix(s).sum(dtype=np.uint64))
                    if len(s) and int(seen[name % SEEN]) != name:
                        seen[name % SEEN] = name
                        sets.append(s)
                        names.append(name)
                if not sets:
                    continue
                names = np.array(names, np.uint64)
                bands = band(np.fromiter(map(len, sets), np.int64, len(sets)))
                for guest in (False, True):
                    own, hashes, deletion = segment_hashes(sets, percent, guest)
                    parity = ((bands[own] + guest) & 1).astype(np.uint32)
                    keys = (hashes.astype(np.uint32) & np.uint32(0xFFFFFFFC)) | (parity << np.uint32(1)) | deletion.astype(np.uint32)
                    held.append((names[own], _bucket(hashes, buckets), keys))
                    size += len(own)
                if size >= PACKET:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch], parts_: int) -> Iterator[pa.RecordBatch]:
    """The keys of one bucket that several classes hold, packed by part of the classes, with the number of classes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, classes, counts, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            held.setdefault(bucket, []).append((np.repeat(np.frombuffer(classes, np.uint64), np.frombuffer(counts, np.uint32)), np.frombuffer(keys, np.uint32)))
    for bucket, parts in held.items():
        classes, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        classes, keys = classes[order], keys[order]
        first, size = _runs(keys >> np.uint32(1))
        several = np.repeat(size > 1, size)
        classes, keys = classes[several], keys[several]
        order = np.lexsort((classes, keys))
        classes, keys = classes[order], keys[order]
        keep = np.append(True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]))[: len(keys)]
        classes, keys = classes[keep], keys[keep]
        # Classes of a group: a class that holds a segment and a neighbourhood of the same hash counts once.
        group = keys >> np.uint32(1)
        order = np.lexsort((classes, group))
        distinct = np.append(True, (group[order][1:] != group[order][:-1]) | (classes[order][1:] != classes[order][:-1]))[: len(keys)]
        first, size = _runs(group)
        number = np.add.reduceat(distinct.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        number = np.repeat(number, size)
        several = number > 1
        classes, keys, number = classes[several], keys[several], number[several]
        part = _bucket(mix(classes), parts_)
        order = np.lexsort((classes, part))
        part, classes, keys, number = part[order], classes[order], keys[order], number[order].astype(np.uint32)
        first, size = _runs(part)
        rows = []
        for at, n in zip(first, size, strict=True):
            here = slice(at, at + n)
            own, count = _runs(classes[here])
            rows.append((int(part[at]), bucket, classes[here][own].tobytes(), count.astype(np.uint32).tobytes(), keys[here].tobytes(), number[here].tobytes()))
        if rows:
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "bucket", "classes", "counts", "keys", "numbers"])


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class of a part: the keys that it shares, their buckets and numbers of classes."""
    held = []
    for batch in batches:
        for _, bucket, classes, counts, keys, numbers in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            names = np.repeat(np.frombuffer(classes, np.int64), np.frombuffer(counts, np.uint32))
            held.append((names, np.full(len(names), bucket, np.int32), np.frombuffer(keys, np.uint32), np.frombuffer(numbers, np.uint32)))
    if not held:
        return
    classes, buckets, keys, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(classes, kind="stable")
    classes, buckets, keys, numbers = classes[order], buckets[order], keys[order], numbers[order]
    first, size = _runs(classes)
    for at in range(0, len(first), 5000):
        ends = [(int(a), int(a + n)) for a, n in zip(first[at : at + 5000], size[at : at + 5000], strict=True)]
        columns = [pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (buckets, keys, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(classes[first[at : at + 5000]]), *columns], ["k1", "buckets", "keys", "numbers"])


def _allocate(percent: int) -> Callable:
    """Which shared segments a class asks with; classes that nothing can link to are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                bucket = np.frombuffer(row["buckets"], np.int32).astype(np.int64)
                keys, number = np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["numbers"], np.uint32)
                n = row["n"]
                own_band = n.bit_length() - 1
                asks, holds, central = np.zeros(len(keys), bool), np.zeros(len(keys), bool), 0.0
                for guest, total in ((0, row["own"]), (1, row["guest"])):
                    if not total:
                        continue
                    here = (keys >> np.uint32(1) & np.uint32(1)) == ((own_band + guest) & 1)
                    whole = np.flatnonzero(here & (keys & np.uint32(1) == 0))
                    must = int(most_different(n, own_band + guest, percent)) + 1
                    central = max(central, len(whole) / total)
                    missing = must - (total - len(whole))
                    if missing <= 0:
                        continue
                    holds |= here
                    if total < must:
                        asks |= here
                        if own_band + guest >= SMALL_BAND:
                            raise ValueError("a set has too few segments for its band")
                    else:
                        asks[whole[np.argsort(number[whole], kind="stable")[:missing]]] = True
                if not holds.any():
                    continue
                whole = np.flatnonzero(holds & (keys & np.uint32(1) == 0))
                names = (bucket << 32) | (keys >> np.uint32(1)).astype(np.int64)
                first = whole[np.lexsort((names[whole], -number[whole].astype(np.int64)))[:1]]
                least = whole[np.argsort(keys[whole])[:1]]
                rare = whole[np.lexsort((names[whole], number[whole]))[:1]]
                rows.append(
                    {
                        "node": row["node"], "n": n, "central": central, "sketch": row["sketch"],
                        "buckets": bucket[holds].astype(np.int32).tobytes(), "keys": keys[holds].tobytes(), "asks": np.packbits(asks[holds]).tobytes(),
                        "picks": sorted({int(names[i]) for i in (*first, *least, *rare)}),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SURVIVOR)

    return run


_SURVIVOR = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("central", pa.float64()), ("sketch", pa.binary()), ("buckets", pa.binary()), ("keys", pa.binary()), ("asks", pa.binary()), ("picks", pa.list_(pa.int64()))])
_SURVIVOR_SQL = "node bigint, n bigint, central double, sketch binary, buckets binary, keys binary, asks binary, picks array<bigint>"


def _verify(percent: int, k: int) -> Callable:
    """(a, b, text of b, text of a): the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, known = [], None, None
            a = batch.column("a").to_pylist()
            for at, end in slices(batch.column("b_text")):
                others = shingle_sets(batch.column("b_text").slice(at, end - at), k)
                for i, other in enumerate(others, at):
                    if a[i] != last:
                        last, known = a[i], shingle_sets(batch.column("a_text").slice(i, 1), k)[0]
                    if links(known, other, percent):
                        keep.append(i)
            got = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield got

    return run


def _packets(dealt: int) -> Callable:
    """Surviving classes to packets by partition of the buckets: node, label, size, sketch, and its keys there with what it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000).to_pylist()
                count = [len(r["keys"]) // 4 for r in rows]
                own = np.repeat(np.arange(len(rows)), count)
                bucket = np.frombuffer(b"".join(r["buckets"] for r in rows), np.int32)
                keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint32)
                asks = np.concatenate([np.unpackbits(np.frombuffer(r["asks"], np.uint8), count=c) for r, c in zip(rows, count, strict=True)])
                order = np.lexsort((own, bucket % dealt))
                first, size = _runs((bucket % dealt)[order])
                out = []
                for a, n in zip(first, size, strict=True):
                    part = order[a : a + n]
                    begin, runs = _runs(own[part])
                    members = [rows[i] for i in own[part][begin]]
                    out.append(
                        (
                            int(bucket[part[0]] % dealt),
                            np.array([[m["node"], m["label"], m["n"]] for m in members], np.int64).tobytes(),
                            b"".join(m["sketch"] for m in members),
                            runs.astype(np.uint32).tobytes(),
                            bucket[part].tobytes(),
                            keys[part].tobytes(),
                            np.packbits(asks[part]).tobytes(),
                        )
                    )
                kinds = (pa.int32(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "members", "sketches", "counts", "buckets", "keys", "asks"])

    return run


def _candidates(percent: int) -> Callable:
    """For each class the classes of other labels that it meets in a group of this partition, where one of the two asks and size and sketch allow a link.

    Pairs that meet in several groups are told once, in lists by their smaller class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for members, sketches, counts, buckets, keys, asks in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                count, key = np.frombuffer(counts, np.uint32), np.frombuffer(keys, np.uint32)
                group = (np.frombuffer(buckets, np.int32).astype(np.int64) << 31) | (key >> np.uint32(1)).astype(np.int64)
                held.append((np.frombuffer(members, np.int64).reshape(-1, 3), np.frombuffer(sketches, np.uint64).reshape(-1, SKETCH_BITS // 64), count, group, np.unpackbits(np.frombuffer(asks, np.uint8), count=len(key)).astype(bool)))
        if not held:
            return
        members, sketches, counts, group, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(group, kind="stable")
        own, asks = np.repeat(np.arange(len(members), dtype=np.int32), counts)[order], asks[order]
        first, size = _runs(group[order])
        label = members[own, 1]
        mixed = (np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)) & np.logical_or.reduceat(asks, first)
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        gathered = 0
        for at, n in zip(first[mixed], size[mixed], strict=True):
            here = own[at : at + n]
            asking = np.unique(here[asks[at : at + n]])
            here = np.unique(here)
            for left in range(0, len(asking), 256):
                for right in range(0, len(here), 4096):
                    found.append(_allowed(members, sketches, asking[left : left + 256], here[right : right + 4096], percent))
                    gathered += len(found[-1])
            if gathered > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                gathered = 0
        pairs = np.unique(np.concatenate(found), axis=0)
        slot = mix(pairs[:, 1].astype(np.uint64)) % np.uint64(SLOTS)
        order = np.lexsort((slot, pairs[:, 0]))
        pairs, slot = pairs[order], slot[order].astype(np.int64)
        first, size = _runs(pairs[:, 0] * SLOTS + slot)
        for at in range(0, len(first), 5000):
            ends = [(int(a), int(a + n)) for a, n in zip(first[at : at + 5000], size[at : at + 5000], strict=True)]
            lists = pa.array([pairs[a:b, 1].tobytes() for a, b in ends], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first[at : at + 5000], 0]), pa.array(slot[first[at : at + 5000]]), lists], ["a", "slot", "others"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of one class and slot, which arrive together, as pairs without repeats."""
    now, lists, held = None, [], 0

    def pairs() -> pa.RecordBatch:
        others = np.unique(np.concatenate(lists))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(others), now[0])), pa.array(others)], ["a", "b"])

    for batch in batches:
        for *key, others in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != now:
                if lists:
                    yield pairs()
                now, lists, held = key, [], 0
            lists.append(np.frombuffer(others, np.int64))
            held += len(lists[-1])
            if held > 1 << 20:
                lists = [np.unique(np.concatenate(lists))]
                held = 0
    if lists:
        yield pairs()


def _allowed(members: np.ndarray, sketches: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    a, b = members[left], members[right]
    small, large = np.minimum(a[:, None, 2], b[None, :, 2]), np.maximum(a[:, None, 2], b[None, :, 2])
    i, j = np.nonzero((a[:, None, 1] != b[None, :, 1]) & (100 * small >= percent * large))
    apart = np.bitwise_count(sketches[left][i] ^ sketches[right][j]).sum(axis=1, dtype=np.int64)
    keep = apart <= (a[i, 2] + b[j, 2]) * (100 - percent) // (100 + percent)
    nodes = np.stack([a[i[keep], 0], b[j[keep], 0]], axis=1)
    nodes.sort(axis=1)
    return nodes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id that links reach)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    known = rows.select("id", "text_hash", "text").mapInArrow(_describe(percent, k), f"id {kind}, text_hash bigint, n bigint, k1 bigint, k2 bigint, own bigint, guest bigint, sketch binary")
    known = staged(known, "join-known")
    classes = known.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.min("id").alias("least_id"), *(F.max(c).alias(c) for c in ("n", "own", "guest", "sketch")))
    classes = staged(staged(classes, "join-classes").withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    total = known.agg(F.sum(F.col("own") + F.col("guest"))).first()[0] or 0
    buckets = int(max(shuffle_width(spark), total // (1 << 20) + 1))
    packets = rows.select("text").mapInArrow(_segments(percent, k, buckets), "bucket int, classes binary, counts binary, keys binary")
    shared = packets.repartitionById(buckets, F.col("bucket")).mapInArrow(functools.partial(_shared, parts_=buckets), "part int, bucket int, classes binary, counts binary, keys binary, numbers binary")
    shared = shared.repartitionById(buckets, F.col("part")).mapInArrow(_by_class, "k1 bigint, buckets binary, keys binary, numbers binary")
    met = shared.join(classes.select("k1", "node", "n", "own", "guest", "sketch"), "k1")
    alive = staged(met.mapInArrow(_allocate(percent), _SURVIVOR_SQL), "join-alive")

    # The text of one document of each remaining class.
    wanted = alive.select("node").join(classes.select("node", "rep.id", "rep.text_hash"), "node").select("node", F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    wanted = staged(wanted, "join-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text")
    texts = staged(texts.dropDuplicates(["node"]), "join-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        return staged(with_a.select("a", "b", "b_text", "a_text").mapInArrow(_verify(percent, k), "a bigint, b bigint"), name)

    picks = staged(alive.select("node", "n", "central", F.explode("picks").alias("pick")), "join-picks")
    hubs = picks.groupBy("pick").agg(F.max(F.struct("central", F.col("node"), "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = staged(hubs.select("pick", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "join-hubs")
    near = picks.join(hubs, "pick").where(f"node <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    first = verified(near.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "join-first")

    labels = staged(components(first, rounds=2), "join-labels")
    named = alive.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node"))
    named = named.select("node", "label", "n", "sketch", "buckets", "keys", "asks")
    # Fewer partitions than buckets: a pair that meets in many groups is told once by each partition.
    entries = alive.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    dealt = int(min(buckets, entries // (4 << 20) + 8))
    packets = named.mapInArrow(_packets(dealt), "part int, members binary, sketches binary, counts binary, buckets binary, keys binary, asks binary")
    lists = packets.repartitionById(dealt, F.col("part")).mapInArrow(_candidates(percent), "a bigint, slot bigint, others binary")
    pairs = lists.repartition(shuffle_width(spark), "a", "slot").sortWithinPartitions("a", "slot").mapInArrow(_united, "a bigint, b bigint")
    rest = verified(staged(pairs, "join-pairs"), "join-rest")

    forest = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = staged(components(forest.unionByName(rest)), "join-components")
    own = classes.join(final.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("k1", "k2", "least_id", F.coalesce("label", "node").alias("label"))
    own = staged(own, "join-own")
    least = staged(own.groupBy("label").agg(F.min("least_id").alias("component_id")), "join-least")
    named = staged(own.join(least, "label").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component_id"), "join-named")
    out = known.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id (null last), of rows that share it any one.

    Rows are named by their place in the files they are read from, so rows that
    repeat an id, or have none, are told apart.
    """
    whole = keyed_rows(docs, "join-rows")
    of = F.col(f"whole.{id_col}")
    rows = whole.select(F.struct(of.isNull().alias("no_id"), of.alias("id"), "row").alias("id"), F.col(f"whole.{text_col}").alias("text"))
    found = near_duplicates(rows, "id", "text", **options)
    gone = staged(found.where(F.col("id") != F.col("component_id")).select("id.row"), "join-gone")
    return whole.join(gone, "row", "left_anti").select("whole.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs)
