"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its documents into training shards of a bounded number of words
and builds a word-level suffix array of each shard by prefix doubling in numpy.
Every suffix of every benchmark text is then binary-searched in the array; the
interval of suffixes that share its first ``window`` words gives the places
where it occurs verbatim. Suffixes that begin with the same window are searched
once, and their items come in only after a document's windows are told apart,
so texts that repeat themselves cost no more than others. From each place the
longest match is found in a suffix array of the benchmark itself; those inside
a match before are left out, and each names one item that holds it. Documents
are never shuffled: all results of a document come from the shard that holds it.

The benchmark is shipped to the tasks in blocks of at most ``block_bytes``
bytes. One block is the usual case; a larger benchmark takes one pass over the
documents for each block, whose partial results meet by row number.

Defined results: a null or empty text has no words and no hits; an item with
fewer words than the window, but not none, is one window of all its words; an
item without words matches nothing; several rows of one ``item_id`` count as
one item; rows with a null ``item_id`` are one item, which counts and is not listed; ties and
repeated rows are judged each on its own; an empty benchmark hits nothing;
further columns are left alone, and a column named like a result column does
not disturb it, as only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, mix, powers, slices, word_hashes
from .scratch import staged

WINDOW = 13
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 32 << 20

MATCH = "array<struct<item:string,doc_word:bigint,item_word:bigint,words:bigint>>"
REPORT = f"n_words bigint, hit array<struct<start:bigint,stop:bigint>>, items array<string>, unnamed boolean, matches {MATCH}"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_MATCH = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


@dataclass(frozen=True)
class TestSuffixes:
    """One block of benchmark texts: their words in one line, the distinct windows to search, and their own suffix array."""

    names: list  # by item
    flat: np.ndarray  # 64-bit hashes of all words, 0 after each item and ``window`` times at the end
    item: np.ndarray  # of each place in ``flat``
    first: np.ndarray  # of each place, the place where its item begins
    start: np.ndarray  # place of each distinct window
    length: np.ndarray  # its words: ``window``, or those of a short item
    holders: np.ndarray  # the items of window w are holders[bounds[w] : bounds[w + 1]]
    bounds: np.ndarray
    ordered: np.ndarray  # sorted distinct word hashes
    places: np.ndarray  # suffix array of ``flat``
    longest: int  # words of the longest item
    ends: np.ndarray  # of each place, where its item ends
    window: int


def test_suffixes(names: list, texts: list, window: int = WINDOW) -> TestSuffixes:
    hashes, rows = word_hashes(pa.array(texts, pa.string()), ALNUM)
    n = np.diff(rows)
    item = np.repeat(np.arange(len(n)), n + 1)
    begin = rows[:-1] + np.arange(len(n))
    flat = np.zeros(len(item) + window, np.uint64)
    flat[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
    count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    start = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n[of], window)
    sums = _Ranges(flat)
    _, one, back = np.unique(sums.hashes(start, length) ^ mix(length.astype(np.uint64)), return_index=True, return_inverse=True)
    held = np.unique(back.astype(np.int64) * max(len(n), 1) + of)
    ordered = np.unique(hashes)
    key = np.where(flat == 0, 0, np.searchsorted(ordered, flat) + 1).astype(np.uint64)
    longest = int(n.max(initial=0))
    places = suffix_array(key, longest + 1)[0] if len(key) > 1 else np.zeros(0, np.int64)
    ends = np.append(np.repeat(begin + n, n + 1), np.zeros(window, np.int64))
    item, where = np.append(item, np.full(window, -1)), np.append(np.repeat(begin, n + 1), np.zeros(window, np.int64))
    return TestSuffixes(list(names), flat, item, where, start[one], length[one], held % max(len(n), 1), np.searchsorted(held // max(len(n), 1), np.arange(len(one) + 1)), ordered, places, longest, ends, window)


class _Ranges:
    """Hashes of any range of words, equal for equal ranges of two lines."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(False, len(words)), out=self.total[1:])
        self.back = powers(True, len(words) + 1)

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.back[start]


def _short(hashes: np.ndarray) -> np.ndarray:
    """32-bit sort keys of words; 0 is kept for what separates documents."""
    return np.maximum(hashes >> np.uint64(32), np.uint64(1))


def suffix_array(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` (or more) keys, and the sorted keys of two words with their positions' order."""
    n = len(key)
    pair = key << np.uint64(32)
    pair[:-1] |= key[1:]
    order = np.argsort(pair)
    two, width = pair[order], 2
    ranked = two
    while width < depth and n > 1:
        new = np.empty(n, dtype=np.uint64)
        new[0] = 1
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        pair = rank << np.uint64(32)
        if width < n:
            pair[:-width] |= rank[width:]
        order = np.argsort(pair)
        ranked = pair[order]
        width *= 2
    return order, two, order


def search(tests: TestSuffixes, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every place where a distinct window's words occur; hashes is 0 between documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(hashes) or not len(tests.start):
        return none
    key = np.where(hashes == 0, np.uint64(0), _short(hashes))
    order, two, _ = suffix_array(key, window)
    # The first two words give the interval in which the search for the rest starts.
    one = tests.length == 1
    head = _short(tests.flat[tests.start])
    second = np.where(one | (window == 1), np.uint64(0), _short(tests.flat[tests.start + 1]))
    low = np.searchsorted(two, (head << np.uint64(32)) | second, side="left")
    high = np.searchsorted(two, (head << np.uint64(32)) | np.where(one, np.uint64(0xFFFFFFFF), second), side="right")
    left = np.flatnonzero(high > low)
    if not len(left):
        return none
    reach = np.arange(window)
    length = tests.length[left]
    whole_want = np.where(reach < length[:, None], tests.flat[tests.start[left][:, None] + reach], np.uint64(0))
    want = np.where(reach < length[:, None], _short(whole_want), np.uint64(0))
    padded = np.concatenate([key, np.zeros(window, np.uint64)])

    def bound(a: np.ndarray, b: np.ndarray, after: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            have = padded[order[mid][:, None] + reach]
            differs = (have != want[open_]) & (reach < length[open_][:, None])
            first = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            less = np.where(differs[rows, first], have[rows, first] < want[open_][rows, first], after)
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]

    low, high = low[left], high[left]
    start = bound(low, high, False)
    stop = bound(start, high, True)
    count = stop - start
    which = np.repeat(np.arange(len(left)), count)
    position = order[np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    # 32-bit keys order the array; the 64-bit hashes decide.
    whole = np.concatenate([hashes, np.zeros(window, np.uint64)])
    same = np.ones(len(position), dtype=bool)
    for k in range(window):
        same &= (whole[position + k] == whole_want[which, k]) | (k >= length[which])
    return left[which[same]], position[same]


def longest_matches(tests: TestSuffixes, found: np.ndarray, position: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, words, and a place in the benchmark of the longest match from each position, without those inside an earlier one.

    The position's suffix is binary-searched in the benchmark's own suffix
    array; the longer match with its two neighbours there is the longest of all.
    """
    order = np.lexsort((-tests.length[found], position))
    found, position = found[order], position[order]
    new = np.append(True, position[1:] != position[:-1])
    found, position = found[new], position[new]
    doc, test = _Ranges(hashes), _Ranges(tests.flat)
    at = np.searchsorted(tests.ordered, hashes)
    exact = tests.ordered[np.minimum(at, len(tests.ordered) - 1)] == hashes
    # Ranks of words on one scale: the benchmark's are even, what ends a document is below all.
    rank = np.append(np.where(hashes == 0, -1, 2 * at + np.where(exact, 2, 1)), -1)
    own = np.append(np.where(tests.flat == 0, 0, 2 * np.searchsorted(tests.ordered, tests.flat) + 2), 0)
    steps = [1 << k for k in reversed(range(max(tests.longest, 1).bit_length()))]

    def common(place: np.ndarray) -> np.ndarray:
        size = np.zeros(len(place), np.int64)
        for step in steps:
            more = size + step
            fits = (position + more <= len(hashes)) & (place + more <= len(tests.flat))
            a, b = np.where(fits, position, 0), np.where(fits, place, 0)
            more_ = np.where(fits, more, 0)
            same = fits & (doc.hashes(a, more_) == test.hashes(b, more_))
            size = np.where(same, more, size)
        # A match ends where its item or document does: nothing is equal to a mark between texts.
        stop = tests.ends[place] - place
        return np.minimum(size, np.maximum(stop, 0))

    low, high = np.zeros(len(position), np.int64), np.full(len(position), len(tests.places))
    while (low < high).any():
        mid = np.minimum((low + high) >> 1, len(tests.places) - 1)
        place = tests.places[mid]
        size = common(place)
        less = own[place + size] < rank[position + size]
        open_ = low < high
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    words, where = tests.length[found].copy(), tests.start[found].copy()
    for beside in (low - 1, low):
        place = tests.places[np.clip(beside, 0, len(tests.places) - 1)]
        size = np.where((beside >= 0) & (beside < len(tests.places)), common(place), 0)
        better = size > words
        # A piece of a longer item counts from a window on.
        better &= size >= np.minimum(tests.window, tests.ends[place] - tests.first[place])
        words, where = np.where(better, size, words), np.where(better, place, where)
    end = position + words
    inside = np.append(False, end[1:] <= np.maximum.accumulate(end)[:-1])
    return position[~inside], words[~inside], where[~inside]


def _shard(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a shard's documents in one line with 0 after each, words by document, and where each begins."""
    counts = np.concatenate([np.diff(rows) for _, rows in parts])
    begin = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    hashes = np.zeros(begin[-1], dtype=np.uint64)
    hashes[np.arange(counts.sum()) + np.repeat(np.arange(len(counts)), counts)] = np.concatenate([h for h, _ in parts])
    return hashes, counts, begin


def _cover(tests: TestSuffixes, found: np.ndarray, position: np.ndarray, n: int) -> np.ndarray:
    """Which words are inside an occurrence."""
    stop = position + tests.length[found]
    return np.cumsum(np.bincount(position, minlength=n + 1) - np.bincount(stop, minlength=n + 1)) > 0


def _judge(parts: list[tuple[np.ndarray, np.ndarray]], tests: TestSuffixes, window: int) -> Iterator[tuple]:
    """For each document of a shard: words, hit spans, items, whether an unnamed item is among them, matches."""
    hashes, counts, begin = _shard(parts)
    found, position = search(tests, hashes, window)
    if not len(found):
        for n in counts:
            yield int(n), [], [], False, []
        return
    cover = _cover(tests, found, position, len(hashes))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover]).astype(np.int8)))
    spans, doc_of = edge.reshape(-1, 2), np.searchsorted(begin, edge[::2], side="right") - 1
    by_span = np.searchsorted(doc_of, np.arange(len(counts) + 1))
    where, words, place = longest_matches(tests, found, position, hashes)
    by_match = np.searchsorted(where, begin)
    # Items come in after places are told apart by document and window only.
    pairs = np.unique((np.searchsorted(begin, position, side="right") - 1) * len(tests.start) + found)
    by_pair = np.searchsorted(pairs // len(tests.start), np.arange(len(counts) + 1))
    for k, n in enumerate(counts):
        own = pairs[by_pair[k] : by_pair[k + 1]] % len(tests.start)
        if not len(own):
            yield int(n), [], [], False, []
            continue
        names = {tests.names[i] for i in np.unique(np.concatenate([tests.holders[tests.bounds[w] : tests.bounds[w + 1]] for w in own]))}
        here = slice(by_match[k], by_match[k + 1])
        matches = [
            {"item": tests.names[tests.item[t]], "doc_word": int(p - begin[k]), "item_word": int(t - tests.first[t]), "words": int(w)}
            for p, w, t in zip(where[here], words[here], place[here], strict=True)
        ]
        hit = [{"start": int(a - begin[k]), "stop": int(b - begin[k])} for a, b in spans[by_span[k] : by_span[k + 1]]]
        yield int(n), hit, sorted(names - {None}), None in names, matches


def _verdicts(parts: list[tuple[np.ndarray, np.ndarray]], tests: TestSuffixes, window: int) -> np.ndarray:
    """Whether each document of a shard is contaminated."""
    hashes, counts, begin = _shard(parts)
    found, position = search(tests, hashes, window)
    if not len(found):
        return np.zeros(len(counts), bool)
    total = np.append(0, np.cumsum(_cover(tests, found, position, len(hashes))))
    hits = total[begin[1:]] - total[begin[:-1]]
    return (hits > 0) & (20 * hits >= counts)


def _reporter(tests, window: int, shard_words: int, keep: list[str], text: str) -> Callable:
    """mapInArrow function: the kept columns and the report of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tests.value
        rows: list[pa.RecordBatch] = []
        shard: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks()
            words, hit, items, unnamed, matches = zip(*_judge(shard, own, window), strict=True)
            more = [pa.array(words, pa.int64()), pa.array(hit, _SPAN), pa.array(items, pa.list_(pa.string())), pa.array(unnamed), pa.array(matches, _MATCH)]
            for name, col in zip(("n_words", "hit", "items", "unnamed", "matches"), more, strict=True):
                table = table.append_column(name, col)
            rows.clear()
            shard.clear()
            yield from table.to_batches()

        for batch in batches:
            texts = batch.column(text)
            kept = batch.select(keep)
            for a, b in slices(texts):
                hashes, at = word_hashes(texts.slice(a, b - a), ALNUM)
                shard.append((hashes, at))
                rows.append(kept.slice(a, b - a))
                size += len(hashes)
                if size >= shard_words:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _items(bench: DataFrame, item_col: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's names and texts, and in how many blocks they are sent."""
    items = bench.select(F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return items, -(-total // block_bytes) or 1


def _sent(items: DataFrame, blocks: int, k: int, window: int):
    """Block k of the benchmark, prepared and broadcast."""
    block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
    got = block.distinct().collect()  # at most about block_bytes
    return items.sparkSession.sparkContext.broadcast(test_suffixes([x["name"] for x in got], [x["text"] for x in got], window))


def find_matches(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``hit`` (merged word spans), ``items`` and ``matches`` (longest verbatim matches with their places)."""
    items, blocks = _items(bench, item_col, item_text, block_bytes)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    if blocks > 1:  # the number of a row in its scan names it in every pass
        picked = staged(picked.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    keep = [c for c in picked.columns if c != "body"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name != "body") + ", " + REPORT
    parts = []
    for k in range(blocks):
        tests = _sent(items, blocks, k, window)
        part = picked.mapInArrow(_reporter(tests, window, shard_words, keep, "body"), kind)
        parts.append(part if blocks == 1 else staged(part.where("size(matches) > 0 OR n_words IS NULL") if k else part, "decontaminate-pass"))
    out = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("row").agg(
            F.first("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hit")).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max("unnamed").alias("unnamed"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        merged = F.aggregate(
            F.array_sort("hit"),
            F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)"),
            lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x))),
        )
        out = out.withColumn("hit", F.when(F.size("hit") > 0, merged).otherwise(F.col("hit"))).drop("row")
    return out.withColumnRenamed("id", id_col)


def contaminated(report: DataFrame) -> DataFrame:
    """The report with ``n_hit`` and the rule's verdict: hit words are 5 % of the words or more."""
    hits = F.aggregate("hit", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return report.withColumn("n_hit", hits).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated documents.

    Rows leave by the verdict on that very text, so no join is needed and rows
    that repeat an id are judged each on its own. With one block only texts go
    to the workers; with several, the report of all runs over whole rows.
    """
    items, blocks = _items(bench, item_col, item_text, block_bytes)
    if blocks > 1:
        whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("text"))
        report = contaminated(find_matches(whole, bench, "whole", "text", item_col, item_text, window, shard_words, block_bytes))
        return report.where(~F.col("contaminated")).select("whole.*")
    tests = _sent(items, 1, 0, window)

    def clean(texts: pa.Array) -> pa.Array:
        out, shard, size = [np.zeros(0, bool)], [], 0
        for a, b in slices(texts):
            shard.append(word_hashes(texts.slice(a, b - a), ALNUM))
            size += len(shard[-1][0])
            if size >= shard_words:
                out.append(_verdicts(shard, tests.value, window))
                shard, size = [], 0
        if shard:
            out.append(_verdicts(shard, tests.value, window))
        return pa.array(~np.concatenate(out))

    return docs.where(F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string")))


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's columns."""
    got = contaminated(find_matches(docs, bench))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("unnamed").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS said
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS said
  FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM docs, (SELECT DISTINCT n FROM windows))
), found AS (SELECT r, places.n, k, item FROM places JOIN windows ON places.said = windows.said AND places.n = windows.n
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN hit ON hit.r = docs.r LEFT JOIN named ON named.r = docs.r
"""
