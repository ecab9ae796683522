"""The trie of all prefixes that conversations share, summed up by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text); the textless root
has depth 0. The node's conversations are its members, and what its last turn
would cost a second time is saved for every member but one.

1. Turns are numbered over ranges of (conversation, turn) and prefixes are
   named by prefix sums over those ranges: a prefix is the depth and four sums
   of the 32-bit halves of two hashes of (place, SHA-256 of the turn). So a
   conversation that holds a third of all turns is spread over many tasks.
2. Rows with equal names are one node, called by its smallest member and its
   depth. Its parent's name is its own without the last turn.
3. Every node has an enter and an exit arc. An enter arc leads to the enter arc
   of the first child or to the own exit arc, an exit arc to the enter arc of
   the next sibling or to the parent's exit arc: one list of 2n arcs, the tour.
4. The list is ranked: runs of arcs inside a chunk of nodes (in the order of
   their top ancestor, smallest member and depth) are summed up where they lie,
   the heads of the runs are ranked over all chunks - in one more chunk if they
   fit, by pointer jumping otherwise - and the sums come back to the arcs.
5. Enter arcs weigh 1 for a leaf, and the saving. With the sums from each arc to
   the end of the tour, a subtree's leaves and savings are the difference
   between its enter and its exit arc.

No step gathers a conversation, a node's members or a node's children in one
group; the only string built per node, the ids of the conversations that end
there, is hashed as a stream of sorted blocks.

Defined results: a null role or text is an empty one; rows without a
conversation id take no part; turns are ordered by number (null first), equal
numbers by role and text (as one string, U+0000 between), and repeated rows are
turns of their own; an empty table has no nodes, not even a root; further
columns are not read. Prefixes are told apart by 128 bits of hash sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import discard, shuffle_width, staged

#: Nodes of a chunk whose arcs are linked in memory (about 200 bytes each), and run heads that one chunk may take.
CHUNK_NODES = 100_000
#: Conversation ids in one block of the list that a node's digest covers.
ID_BLOCK = 4096
#: What a conversation takes over from another: at most ``MOST_HEAD - 1`` turns, from the first of its ``FAMILY``.
FAMILY, MOST_HEAD = 5, 9

NAME = ["s1", "s2", "s3", "s4"]
PARENT = ["p1", "p2", "p3", "p4"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def in_ranges(df: DataFrame, ranges: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` in ascending order over ranges: ``part`` is the range, ``row`` the place inside it. Written and read back."""
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *ranges).sortWithinPartitions(*order)
    return staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), name)


def _before(parts: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """For each (key, part): the sums of the key's earlier parts."""
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns (``conv_id``, ``part``, ``place`` from 0, ``digest``, ``n_bytes``), and all conversations (``conv_id``, ``n`` turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    rows = rows.withColumn("said", F.concat("role", F.lit("\0"), "text")).withColumn("opening", F.substring("said", 1, 64))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    rows = rows.select("conv_id", "turn", "said", "opening", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", "turn", "opening").sortWithinPartitions("conv_id", "turn", "said")
    dealt = dealt.select("conv_id", "digest", "n_bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    turns = staged(dealt, "trie-turns")
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("row")) - 1
    placed = turns.withColumn("own", own).join(_before(parts, "conv_id", ["n"]), ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("own") + F.col("n_before")).alias("place"), "digest", "n_bytes"), parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of c - c % 5 in place of its own first h; h = crc32(decimal c) % 9."""
    turns = staged(turns, "trie-placed")
    plan = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("giver"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("giver"), F.col("n").alias("n_giver")), "giver", "left")
    own = F.col("conv_id") == F.col("giver")
    head = F.when(own, 0).otherwise(F.least("h", F.coalesce("n_giver", F.lit(0)))).cast("bigint")
    plan = staged(plan.select("conv_id", "giver", F.when(own, 0).otherwise(F.col("h")).cast("bigint").alias("h"), head.alias("head"), "n"), "trie-plan")
    # A conversation's plan travels to its turns by (conversation, part), so that one of a third of all turns is no hot key.
    by_part = turns.select("conv_id", "part").distinct().join(plan, "conv_id")
    kept = turns.join(by_part.select("conv_id", "part", "h", "head"), ["conv_id", "part"]).where("place >= h")
    kept = kept.select("conv_id", "part", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "digest", "n_bytes")
    givers = turns.where(F.col("place") < MOST_HEAD - 1).select(F.col("conv_id").alias("giver"), F.col("place"), "digest", "n_bytes")
    given = plan.where("conv_id <> giver AND head > 0").join(givers, "giver").where("place < head")
    given = given.select("conv_id", F.lit(-1).alias("part"), "place", "digest", "n_bytes")
    return kept.unionByName(given), plan.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("head")).alias("n"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 1: the name of the prefix and of the one before, and whether the conversation ends."""
    halves = []
    for seed in (0, 1):
        value = F.xxhash64("digest", "place", F.lit(seed))
        halves += [value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)]
    rows = staged(turns.select("*", *[x.alias(f"g{k}") for k, x in enumerate(halves, 1)]), "trie-rows")
    gs = ["g1", "g2", "g3", "g4"]
    sums = rows.groupBy("conv_id", "part").agg(*[F.sum(g).alias(g) for g in gs])
    by_part = _before(sums, "conv_id", gs).join(convs.select("conv_id", "n"), "conv_id")
    so_far = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *[F.sum(g).over(so_far).alias(f"run{k}") for k, g in enumerate(gs, 1)]).join(by_part, ["conv_id", "part"])
    names = [(F.col(f"run{k}") + F.col(f"g{k}_before")).alias(f"s{k}") for k in range(1, 5)]
    parents = [(F.col(f"run{k}") + F.col(f"g{k}_before") - F.col(f"g{k}")).alias(f"p{k}") for k in range(1, 5)]
    named = staged(running.select("conv_id", (F.col("place") + 1).alias("depth"), *names, *parents, "n_bytes", (F.col("place") + 1 == F.col("n")).alias("ends")), "trie-prefixes")
    discard(rows)
    return named


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each node, which arrive in order; one digest is open at a time."""
    names = ["depth", *NAME]
    now, open_digest = None, None

    def row(key, digest):
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([digest.hexdigest()])], [*names, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*[batch.column(n).to_pylist() for n in [*names, "ids"]], strict=True):
            if key != now:
                if now is not None:
                    yield row(now, open_digest)
                now, open_digest = key, hashlib.sha256()
            else:
                open_digest.update(b",")
            open_digest.update(ids.encode())
    if now is not None:
        yield row(now, open_digest)


def _ends(last: DataFrame) -> DataFrame:
    """``ends_sha256`` of every node at which conversations end: their ids in ascending order, comma-joined."""
    blocks = last.groupBy("depth", *NAME, F.expr(f"conv_id div {ID_BLOCK}").alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(shuffle_width(last.sparkSession), "depth", *NAME).sortWithinPartitions("depth", *NAME, "block")
    kind = ", ".join(f"{n} bigint" for n in ["depth", *NAME])
    return dealt.mapInArrow(_stream_digests, f"{kind}, ends_sha256 string")


def _tree(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes: ``conv_id`` (smallest member), ``depth``, ``parent``, ``first_child``, ``n_children``, ``n_convs``, ``saving``, ``ends_sha256``, ``top`` (smallest member of the ancestor at depth 1)."""
    convs = staged(convs, "trie-convs")
    rows = _prefixes(turns, convs)
    zero = [F.lit(0).cast("bigint").alias(n) for n in NAME]
    grouped = rows.groupBy("depth", *NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *[F.min(p).alias(p) for p in PARENT])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("bigint").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_bytes"), *[F.lit(None).cast("bigint").alias(p) for p in PARENT])
    last = rows.where("ends").select("conv_id", "depth", *NAME).unionByName(convs.where("n = 0").select("conv_id", F.lit(0).cast("bigint").alias("depth"), *zero))
    nodes = grouped.withColumn("depth", F.col("depth").cast("bigint")).unionByName(root).join(_ends(last), ["depth", *NAME], "left")
    nodes = staged(nodes.select("*", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving")), "trie-nodes")

    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for s, p in zip(NAME, PARENT, strict=True)], F.col("conv_id").alias("parent"))
    linked = staged(nodes.join(above, ["depth", *PARENT], "left").select("conv_id", "depth", "parent", "n_convs", "saving", "ends_sha256", *NAME), "trie-linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    # Of each smallest member, its ancestor at depth 1.
    tops = rows.where("depth = 1").select("conv_id", *NAME).join(linked.where("depth = 1").select(*NAME, F.col("conv_id").alias("top")), NAME)
    tree = linked.drop(*NAME).join(children, ["conv_id", "depth"], "left").join(tops.select("conv_id", "top"), "conv_id", "left")
    # Siblings follow one another by smallest member; the next one may stand in the next range.
    tree = in_ranges(tree, ["depth", "parent", "conv_id"], ["depth", "parent", "conv_id"], "trie-siblings")
    discard(convs, rows, nodes, linked)
    line = Window.partitionBy("part").orderBy("row")
    first = tree.groupBy("part").agg(F.min(F.struct("row", "depth", "parent", "conv_id")).alias("f")).select("part", "f.depth", "f.parent", "f.conv_id")
    onward = first.select(F.lead("depth").over(Window.orderBy("part")).alias("next_depth"), F.lead("parent").over(Window.orderBy("part")).alias("next_parent"), F.lead("conv_id").over(Window.orderBy("part")).alias("next_conv"), "part")
    follows = tree.select("*", F.lead(F.struct("depth", "parent", "conv_id")).over(line).alias("f")).join(F.broadcast(onward), "part", "left")  # a row for each range
    at = lambda field, other: F.when(F.col("f").isNotNull(), F.col("f")[field]).otherwise(F.col(other))
    sibling = (at("depth", "next_depth") == F.col("depth")) & (at("parent", "next_parent") == F.col("parent"))
    return follows.select("conv_id", "depth", "parent", "n_convs", "saving", "ends_sha256", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "first_child", "top", F.when(sibling, at("conv_id", "next_conv")).alias("sibling"))


#: A run's way on (an arc: conversation, depth, 0 enter or 1 exit), and the sums from an arc to the end of its run.
_TO = ["to_conv", "to_depth", "to_kind"]
_SUMS = ["arcs", "leaves", "saved"]


def _link(conv, depth, kind, to, weights):
    """Adds up the arcs of a chunk along their links: for each arc the sums to the end of its run, and the run's way on."""
    codes = np.unique(conv)
    high = max(int(depth.max(initial=0)), 0) + 2

    def key(c, d, k):
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        return np.where((codes[at] == c) & (d >= 0) & (d < high), (at * high + d) * 2 + k, -1)

    own = key(conv, depth, kind)
    order = np.argsort(own)
    asked = key(*to)
    at = order[np.minimum(np.searchsorted(own, asked, sorter=order), len(own) - 1)]
    n = len(own)
    # The last arc of a run points to a stop that weighs nothing.
    follow = np.append(np.where((asked >= 0) & (own[at] == asked), at, n), n)
    sums = [np.append(w, 0) for w in weights]
    tail = np.append(np.arange(n), n)
    while True:
        ahead = follow[follow]
        if (follow == n).all():
            break
        sums = [s + s[follow] for s in sums]
        tail = np.where(follow == n, tail, tail[follow])
        follow = ahead
    tail = tail[:n]
    return [x[tail] for x in to], [s[:n] for s in sums]


def _nullable(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=missing)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        while n + len(batch) >= size:
            head = size - n
            yield pa.Table.from_batches([*held, batch.slice(0, head)]).combine_chunks().to_batches()[0]
            held, n, batch = [], 0, batch.slice(head)
        if len(batch):
            held.append(batch)
            n += len(batch)
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _runs_of_nodes(size: int) -> Callable:
    """For each node of a chunk its two arcs, added up along the chunk's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            col = lambda name: chunk.column(name).fill_null(0).to_numpy()  # noqa: E731, B023
            has = lambda name: chunk.column(name).is_valid().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            conv, depth, n = col("conv_id"), col("depth"), len(chunk)
            child, sibling, parent = has("first_child"), has("sibling"), has("parent")
            enter = (np.where(child, col("first_child"), conv), np.where(child, depth + 1, depth), np.where(child, 0, 1))
            leave = (np.where(sibling, col("sibling"), col("parent")), np.where(sibling, depth, depth - 1), np.where(sibling, 0, 1))
            to = [np.concatenate(x) for x in zip(enter, leave, strict=True)]  # the root's exit leads to depth -1: nowhere
            none = np.zeros(n, np.int64)
            weights = [np.ones(2 * n, np.int64), np.concatenate([(~child).astype(np.int64), none]), np.concatenate([col("saving"), none])]
            kind = np.repeat([0, 1], n)
            on, sums = _link(np.tile(conv, 2), np.tile(depth, 2), kind, to, weights)
            end = on[1] < 0
            arrays, names = list(chunk.columns), list(chunk.schema.names)
            for k, side in enumerate(("enter", "exit")):
                part = slice(k * n, (k + 1) * n)
                arrays += [_nullable(x[part], end[part]) for x in on] + [pa.array(s[part]) for s in sums]
                names += [f"{side}_{c}" for c in (*_TO, *_SUMS)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _runs_of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for run heads, all in one chunk."""
    held = list(batches)
    for chunk in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        col = lambda name: chunk.column(name).fill_null(-1).to_numpy()  # noqa: E731, B023
        on, sums = _link(col("conv"), col("depth"), col("kind"), [col(c) for c in _TO], [col(c) for c in _SUMS])
        end = on[1] < 0
        yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in ("conv", "depth", "kind")], *[_nullable(x, end) for x in on], *[pa.array(s) for s in sums]], ["conv", "depth", "kind", *_TO, *_SUMS])


_HEAD = ", ".join(f"{c} bigint" for c in ("conv", "depth", "kind", *_TO, *_SUMS))


def rank_heads(heads: DataFrame, chunk_nodes: int) -> DataFrame:
    """Run heads (an arc, the run's way on, the run's sums) with the sums to the end of the whole list."""
    heads = staged(heads, "trie-heads")
    if heads.count() <= chunk_nodes:
        return staged(heads.repartition(1).mapInArrow(_runs_of_heads, _HEAD), "trie-ranked")
    while True:
        # Pointer jumping: every head's way doubles, until all ways end.
        ahead = heads.select(F.col("conv").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("kind").alias("to_kind"), F.struct(*_TO, *_SUMS).alias("then"))
        jumped = heads.join(ahead, _TO, "left").select("conv", "depth", "kind", *[F.col(f"then.{c}").alias(c) for c in _TO], *[(F.col(c) + F.coalesce(F.col(f"then.{c}"), F.lit(0))).alias(c) for c in _SUMS])
        after = staged(jumped, "trie-heads")
        discard(heads)
        heads = after
        if not heads.where("to_conv IS NOT NULL").limit(1).count():
            return heads


def trie(turns: DataFrame, convs: DataFrame, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """All nodes of the prefix trie of numbered turns.

    ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the places of its arcs
    on the tour from 0: ``enter``, ``exit``.
    """
    spark = turns.sparkSession
    tree = siblings = _tree(turns, convs)
    tree = tree.repartitionByRange(shuffle_width(spark), "top", "conv_id", "depth").sortWithinPartitions("top", "conv_id", "depth")
    kinds = {f.name: f.dataType.simpleString() for f in tree.schema.fields}
    more = [f"{side}_{c} bigint" for side in ("enter", "exit") for c in (*_TO, *_SUMS)]
    local = staged(tree.mapInArrow(_runs_of_nodes(chunk_nodes), ", ".join([*[f"{n} {t}" for n, t in kinds.items()], *more])), "trie-runs")
    discard(siblings)

    def arcs(side: str, kind: int) -> DataFrame:
        return local.select(F.col("conv_id").alias("conv"), "depth", F.lit(kind).cast("bigint").alias("kind"), *[F.col(f"{side}_{c}").alias(c) for c in (*_TO, *_SUMS)])

    both = arcs("enter", 0).unionByName(arcs("exit", 1))
    asked = both.where("to_conv IS NOT NULL").select(*[F.col(c).alias(n) for c, n in zip(_TO, ("conv", "depth", "kind"), strict=True)]).distinct()
    ranked = rank_heads(both.join(asked, ["conv", "depth", "kind"], "left_semi"), chunk_nodes)

    done = local
    for side in ("enter", "exit"):
        onward = ranked.select(*[F.col(n).alias(f"{side}_{c}") for c, n in zip(_TO, ("conv", "depth", "kind"), strict=True)], *[F.col(c).alias(f"{side}_then_{c}") for c in _SUMS])
        done = done.join(onward, [f"{side}_{c}" for c in _TO], "left")
    whole: Callable[[str, str], Column] = lambda side, c: F.col(f"{side}_{c}") + F.coalesce(F.col(f"{side}_then_{c}"), F.lit(0))
    n_arcs = 2 * local.count()
    return done.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (whole("enter", "leaves") - whole("exit", "leaves")).alias("n_leaves"),
        (whole("enter", "saved") - whole("exit", "saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        (F.lit(n_arcs) - whole("enter", "arcs")).alias("enter"),
        (F.lit(n_arcs) - whole("exit", "arcs")).alias("exit"),
    )


def digest(conversations: DataFrame, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """The contract's columns, over rebuilt conversations."""
    return trie(*rebuilt(*numbered(conversations)), chunk_nodes).drop("enter", "exit")


#: The polynomial and start of CRC-32.
_CRC = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bits), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), b AS (
  SELECT conv_id, list((CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER) + 1, 1)) AS BIGINT) >> CAST(j AS INTEGER)) & 1 ORDER BY i, j) AS bits
  FROM n, range(20) AS r(i), range(8) AS s(j) WHERE i < length(CAST(conv_id AS VARCHAR)) GROUP BY conv_id
), h AS (
  SELECT conv_id, conv_id - conv_id % 5 AS giver, xor({_CRC}, 4294967295) % 9 AS h FROM b
), taken AS (
  SELECT h.conv_id, t.place, t.role, t.text FROM h JOIN t ON t.conv_id = h.giver WHERE t.place < h.h
  UNION ALL
  SELECT h.conv_id, t.place + 100, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.place >= h.h
), r AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS n_bytes,
         md5(array_to_string(list(md5(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',')) AS name
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), p AS (
  SELECT conv_id, depth, n_bytes, name, lag(name, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM r
  UNION ALL
  SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM n
), node AS (
  SELECT name, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saving,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY name, depth
), kids AS (
  SELECT parent AS name, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT a.name, sum(CASE WHEN k.name IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(v.saving) AS saved_tokens
  FROM node v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN kids k ON k.name = v.name
  GROUP BY a.name
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v LEFT JOIN node u ON u.name = v.parent LEFT JOIN kids k ON k.name = v.name JOIN below b ON b.name = v.name
"""
