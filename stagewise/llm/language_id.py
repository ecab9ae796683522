"""Language of documents, by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of a window of ``window`` bytes
from both ends. Each direction is a gated recurrent unit of ``units`` units
(update gate, reset gate after the product, tanh candidate) whose input weights
are one row per byte. Both states at a position give that position's log odds
of the languages. A document's probabilities are the mean of those of all its
letter bytes; windows cover the whole text without gaps.

It is trained in numpy by backpropagation through time, with ``steps`` Adam steps, in
one task: from at most ``per_lang`` documents of each language (those with the
smallest hash of their id) and ``max_rows`` in all, the text of each through at
most ``spread`` windows evenly spaced over it. Predictions read the text only.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so are all texts if nothing could be learnt; documents with a null language or
id are not learnt from, and a null id is not held out; rows that repeat an id
are learnt from once, and each is predicted; ties go to the smaller language by
code points; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import LOWER, slices, utf8
from .scratch import staged

WINDOW, UNITS = 64, 8
PER_LANG, MAX_ROWS, SPREAD = 1500, 20_000, 6
STEPS, BATCH, RATE = 300, 256, 0.01
#: Windows that are read at a time.
GROUP = 4096
UNKNOWN = "und"

#: Bytes of letters: A-Z, a-z, and all of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Arrays of both directions: ``table`` (2, 3 units, 256), ``own`` (2, 3 units, units), ``out`` (2, languages, units); ``bias`` (languages, 1)."""

    langs: list[str]
    table: np.ndarray
    own: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, langs: list[str], units: int, seed: int = 0, kind=np.float32) -> Network:
        r = np.random.default_rng(seed)
        some = lambda *shape, scale: (r.normal(size=shape) * scale).astype(kind)
        n = len(langs)
        return cls(langs, some(2, 3 * units, 256, scale=0.3), some(2, 3 * units, units, scale=units**-0.5), some(2, n, units, scale=0.3), np.zeros((n, 1), kind))

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.own, self.out, self.bias]

    def states(self, side: int, symbols: np.ndarray, alive: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The states after each step; of ``symbols`` (steps, windows) only the first ``alive[t]`` windows go on in step t."""
        table, own = self.table[side], self.own[side]
        units = own.shape[1]
        h = np.zeros((units, symbols.shape[1]), table.dtype)
        for t in range(len(symbols)):
            n = alive[t]
            if not n:
                return
            h = h[:, :n] if n < h.shape[1] else h
            x = np.take(table, symbols[t, :n], axis=1)
            g = own @ h
            gates = x[: 2 * units]
            gates += g[: 2 * units]
            _sigmoid(gates)
            own_new = g[2 * units :]
            new = own_new * gates[units:]
            new += x[2 * units :]
            # tanh by the logistic function
            new *= 2
            _sigmoid(new)
            new *= 2
            new -= 1
            if keep is not None:
                keep.append((h, gates, own_new, new))
            h = new + gates[:units] * (h - new)
            yield h

    def positions(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities (languages, steps, windows) at each position of windows, which stand in descending order of size."""
        steps = int(size[0])
        at = np.arange(steps)[:, None]
        alive = (size > at).sum(axis=1)
        logits = np.zeros((len(self.langs), steps, len(start)), self.table.dtype)
        for t, h in enumerate(self.states(0, buf[np.minimum(start + at, len(buf) - 1)], alive)):
            logits[:, t, : h.shape[1]] = self.out[0] @ h
        whole = int(alive[-1])  # the windows of full size: their places backwards are the same for all
        for t, h in enumerate(self.states(1, buf[np.maximum(start + size - 1 - at, 0)], alive)):
            odds = self.out[1] @ h
            logits[:, steps - 1 - t, :whole] += odds[:, :whole]
            if h.shape[1] > whole:
                rest = np.arange(whole, h.shape[1])
                logits[:, size[rest] - 1 - t, rest] += odds[:, whole:]
        logits += self.bias[:, :, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def documents(self, buf: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
        """Mean probabilities (documents, languages) over the letter bytes of each document; zeros without any."""
        buf = LOWER[buf]
        start, size, doc = windows(offsets, window)
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        letters = np.zeros(len(offsets) - 1)
        for at in range(0, len(start), GROUP):
            order = at + np.argsort(-size[at : at + GROUP], kind="stable")
            s, n, d = start[order], size[order], doc[order]
            probs = self.positions(buf, s, n)
            steps = np.arange(probs.shape[1])[:, None]
            counts = _LETTER[buf[np.minimum(s + steps, len(buf) - 1)]] & (steps < n)
            letters += np.bincount(d, counts.sum(axis=0), len(letters))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(d, (probs[k] * counts).sum(axis=0), len(letters))
        return total / np.maximum(letters, 1)[:, None]


def windows(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and document of all windows: they cover every byte once."""
    length = np.diff(offsets)
    each = -(-length // window)
    doc = np.repeat(np.arange(len(length)), each)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[doc] + place * window
    return start, np.minimum(window, offsets[doc + 1] - start), doc


def loss_and_gradients(net: Network, symbols: np.ndarray, size: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy at the letter positions of windows (steps, windows; descending size), and its gradients, through time."""
    steps, count = symbols.shape
    at = np.arange(steps)[:, None]
    alive = (size > at).sum(axis=1)
    back = np.take_along_axis(symbols, np.maximum(size - 1 - at, 0), axis=0)
    held = ([], [])
    after = ([], [])
    for side, line in enumerate((symbols, back)):
        after[side].extend(net.states(side, line, alive, held[side]))
    weights = (_LETTER[symbols] & (at < size)).astype(net.table.dtype)
    weights /= max(weights.sum(), 1)
    grads = [np.zeros_like(a) for a in net.arrays()]
    loss, by_state = 0.0, [[np.zeros_like(h) for h in after[side]] for side in (0, 1)]
    cols = np.arange(count)
    # Odds at a position: the forward state of its step and the backward state of the step that reads it.
    logits = np.zeros((len(net.langs), steps, count), net.table.dtype)
    for t, h in enumerate(after[0]):
        logits[:, t, : h.shape[1]] += net.out[0] @ h
    for t, h in enumerate(after[1]):
        own = cols[: h.shape[1]]
        logits[:, size[own] - 1 - t, own] += net.out[1] @ h
    logits += net.bias[:, :, None]
    logits -= logits.max(axis=0)
    probs = np.exp(logits)
    probs /= probs.sum(axis=0)
    loss = float(-(np.log(np.maximum(probs[lang, :, cols].T, 1e-30)) * weights).sum())
    probs[lang, :, cols] -= 1
    by_odds = probs * weights
    grads[3][:, 0] = by_odds.sum(axis=(1, 2))
    for t, h in enumerate(after[0]):
        d = by_odds[:, t, : h.shape[1]]
        grads[2][0] += d @ h.T
        by_state[0][t] += net.out[0].T @ d
    for t, h in enumerate(after[1]):
        own = cols[: h.shape[1]]
        d = by_odds[:, size[own] - 1 - t, own]
        grads[2][1] += d @ h.T
        by_state[1][t] += net.out[1].T @ d
    units = net.own.shape[2]
    for side, line in enumerate((symbols, back)):
        carry = np.zeros((units, 0), net.table.dtype)
        for t in reversed(range(len(after[side]))):
            before, gates, own_new, new = held[side][t]
            n = before.shape[1]
            d = by_state[side][t]
            d[:, : carry.shape[1]] += carry
            z, r = gates[:units], gates[units:]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * own_new * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new])
            d_own = np.concatenate([d_z, d_r, d_new * r])
            onto = np.zeros((256, 3 * units), net.table.dtype)
            np.add.at(onto, line[t, :n], d_in.T)
            grads[0][side] += onto.T
            grads[1][side] += d_own @ before.T
            carry = net.own[side].T @ d_own + d * z
    return loss, grads


def train(texts: list[bytes], langs: list[str], window: int = WINDOW, units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Network:
    """A network trained on windows (lower-cased bytes, at most ``window`` each) with their languages."""
    names = sorted(set(langs))
    net = Network.random(names, units, seed)
    code = np.searchsorted(np.array(names), langs) if names else np.zeros(0, np.int64)
    r = np.random.default_rng(seed + 1)
    mean, square, step = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    while step < steps and len(names) > 1:
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            if step == steps:
                break
            some = sorted(order[at : at + batch], key=lambda k: -len(texts[k]))
            size = np.array([len(texts[k]) for k in some])
            symbols = np.zeros((size[0], len(some)), np.intp)
            for col, k in enumerate(some):
                symbols[: size[col], col] = np.frombuffer(texts[k], np.uint8)
            _, grads = loss_and_gradients(net, symbols, size, code[some])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            pace = rate * (1 - 0.9 * step / steps)
            for a, g, m, s in zip(net.arrays(), grads, mean, square, strict=True):
                g *= min(1.0, 1.0 / max(norm, 1e-12))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                a -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(a.dtype)
    return net


def _spread(window: int, spread: int) -> Callable:
    """At most ``spread`` windows of each text, evenly spaced, that hold a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out, which = batch.column("lang").to_pylist(), [], []
            buf, offsets = utf8(batch.column("text"))
            buf = LOWER[buf]
            start, size, doc = windows(offsets, window)
            first = np.searchsorted(doc, np.arange(len(batch) + 1))
            for k in range(len(batch)):
                all_of = np.arange(first[k], first[k + 1])
                for w in all_of[np.unique(np.linspace(0, max(len(all_of) - 1, 0), spread).astype(int))] if len(all_of) else []:
                    piece = buf[start[w] : start[w] + size[w]]
                    if _LETTER[piece].any():
                        out.append(piece.tobytes())
                        which.append(langs[k])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(which, pa.string())], ["piece", "lang"])

    return run


def _trainer(options: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column("piece").to_pylist()
            langs += batch.column("lang").to_pylist()
        net = train(texts, langs, **options)
        yield pa.RecordBatch.from_arrays([pa.array([net.langs], pa.list_(pa.string())), *[pa.array([a.tobytes()]) for a in net.arrays()]], ["langs", "table", "own", "out", "bias"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = WINDOW, units: int = UNITS, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, spread: int = SPREAD, **options) -> Network:
    """The network, trained on a bounded sample of the documents that have a language and a letter."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    named = rows.select("lang", F.xxhash64("id").alias("draw"), "id")
    chosen = named.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("place") <= per_lang)
    chosen = chosen.orderBy("draw", "id").limit(max_rows).select("id").distinct()  # max_rows ids
    pieces = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x")).select("id", "x.lang", "x.text")
    pieces = staged(pieces.select("lang", "text", "id").mapInArrow(_spread(window, spread), "piece binary, lang string"), "language-sample")
    one = pieces.repartition(1).sortWithinPartitions("lang", "piece").mapInArrow(_trainer({"window": window, "units": units, **options}), "langs array<string>, table binary, own binary, out binary, bias binary").first()
    if one is None:
        return Network.random([], units)
    n = len(one["langs"])
    shapes = {"table": (2, 3 * units, 256), "own": (2, 3 * units, units), "out": (2, n, units), "bias": (n, 1)}
    return Network(list(one["langs"]), *[np.frombuffer(one[name], np.float32).reshape(shape) for name, shape in shapes.items()])


def _predictor(net, window: int, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network = net.value
        for batch in batches:
            col, known = batch.column("text"), batch.column("known").to_numpy(zero_copy_only=False)
            langs, scores = [], []
            for a, b in slices(col):
                probs = own.documents(*utf8(col.slice(a, b - a)), window) if own.langs else np.zeros((b - a, 1))
                best = probs.argmax(axis=1)
                sure = known[a:b] & (probs[np.arange(len(best)), best] > 0)
                langs += [own.langs[k] if ok else UNKNOWN for k, ok in zip(best, sure, strict=True)]
                scores.append(np.where(sure, np.minimum(probs[np.arange(len(best)), best], 1), 0.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of all documents with ``lang_pred`` and ``score``, where they are read: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = [f"_{k}" for k in range(len(keep))]
    kind = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.select(*keep).schema, strict=True))
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = rows.withColumn("known", F.col("text").rlike(r"\p{L}")).mapInArrow(_predictor(sent, window, names), f"{kind}, lang_pred string, score double")
    return got.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns: a quarter of the documents, by crc32 of their ids, is held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    net = fit(rows.where("NOT held_out"), **options)
    got = predict(rows.withColumn("held_out", F.coalesce("held_out", F.lit(False))), net, ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", F.round("score", 4).alias("score"))
