"""Document log-likelihoods by a gated recurrent language model.

1. Every word of the training documents is counted (Spark sums the counts).
2. The most frequent words are the model's vocabulary, dealt by frequency to classes; every
   other word belongs to one of 32 tail classes by its last letter and by whether it has
   bytes beyond ASCII. The output is factored: a softmax over classes, then one in the
   class; in a tail class a word has its share by count.
3. Tasks train by truncated backpropagation in numpy on their share of the documents, from
   common parameters, and Spark averages the parameters by tokens; so for each round. The
   rounds share out the documents, so each is learned from once.
4. Texts are scored whole: the state goes on from window to window. Counts of rare words come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out, written

HIDDEN = 16
CLASSES = 32
PER_CLASS = 32
TAILS = 32
#: Words whose counts every task gets; the others' come by a join.
HEAD = 100_000
#: They are looked up among those of equal leading bits.
LEAD = 18
LANES, WINDOW = 96, 24
#: A text that is spread over lanes is cut into runs of so many tokens at least.
LEAST_RUN = 2 * WINDOW
#: In each round another share of the training documents is learned from; together they are all.
ROUNDS = 2
RATE = 0.01
END = np.uint64(0x0E4D_0F7E_C7A1_2345)
ADD = 0.1
#: Rows of a block of targets in one class.
BLOCK = 8
#: Tokens that are learned from or scored together.
GROUP = 1 << 20
#: Different words that a counting task holds before it emits them.
KEPT = 1 << 21


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, tail classes, first token of each text), an end after each text."""
    for i, j, data, offsets in tv.texts(column):
        low = tv.LOWER[data]
        starts, ends, first = tv.words(low, offsets)
        counts = np.diff(first)
        at = np.concatenate(([0], np.cumsum(counts + 1)))
        hashes, tails = np.full(at[-1], END, np.uint64), np.zeros(at[-1], np.int32)
        place = np.arange(len(starts)) + np.repeat(np.arange(j - i), counts)
        hashes[place] = tv.segment_hashes(low, starts, ends)
        if len(starts):
            wide = np.maximum.reduceat(np.append(low, 0), np.stack([starts, ends], 1).ravel())[::2] >= 128
            tails[place] = wide * 16 + (low[ends - 1] & 15)
        yield i, j, hashes, tails, at


def grouped(slices: Iterator[tuple], least: int = GROUP) -> Iterator[tuple]:
    """Slices of tokens() put together to at least so many tokens: long texts then run beside others."""
    held, n = [], 0
    for x in slices:
        held.append(x)
        n += len(x[2])
        if n >= least:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    starts = np.cumsum([0, *(len(x[2]) for x in held)])
    first = np.concatenate([x[4][:-1] + s for x, s in zip(held, starts, strict=False)] + [starts[-1:]])
    return held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), first


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, tail, c) of the tokens of docs (text), one row for each different token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, t, c = h[order], t[order], c[order]
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[begin], t[begin], np.add.reduceat(c, begin)

        def batch_of(h, t, c) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(c)], ["h", "tail", "c"])

        for batch in batches:
            for _, _, h, t, _ in tokens(batch.column(0)):
                h, at, c = np.unique(h, return_index=True, return_counts=True)
                held.append((h, t[at], c.astype(np.int64)))
                if sum(len(x[0]) for x in held) > KEPT:
                    held = [merged()]
                    if len(held[0][0]) > KEPT // 2:
                        yield batch_of(*held[0])
                        held = []
        if held:
            yield batch_of(*merged())

    counted = docs.select("text").mapInArrow(run, "h bigint, tail int, c bigint")
    return counted.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Net:
    """A gated recurrent network of one layer and its factored output, in numpy."""

    SHAPES = {
        "embed": (CLASSES * PER_CLASS + TAILS + 1, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
        "wc": (HIDDEN, CLASSES + TAILS), "bc": (CLASSES + TAILS,), "wo": (CLASSES, PER_CLASS, HIDDEN), "bo": (CLASSES, PER_CLASS),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
    START = CLASSES * PER_CLASS + TAILS  # the input before the first token

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, tail_counts: np.ndarray, seed: int = 7) -> Net:
        """Random weights, biases such that the first predictions are those of the counts."""
        r = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE, np.float32))
        net.embed[:] = r.normal(0, 0.3, net.embed.shape)
        for w in (net.wx, net.wh):
            w[:] = r.normal(0, 0.3, w.shape)
        net.b[HIDDEN : 2 * HIDDEN] = 1.0  # the state is kept at first
        by_class = counts.reshape(CLASSES, PER_CLASS)
        net.bc[:] = np.log(np.concatenate([by_class.sum(1), tail_counts]) + 1e-3)
        net.bc -= net.bc.max()
        net.bo[:] = np.log(by_class + 1e-3)
        return net

    def step(self, px: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        g = h @ self.wh
        k = HIDDEN
        gates = sigmoid(px[:, : 2 * k] + g[:, : 2 * k])
        r, z, hn = gates[:, :k], gates[:, k:], g[:, 2 * k :]
        n = np.tanh(px[:, 2 * k :] + r * hn)
        return n + z * (h - n), r, z, n, hn

    def output(self, h: np.ndarray, target: np.ndarray, grad: Net | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each target given its state: of the word, or of the tail class
        (targets from CLASSES * PER_CLASS on). With grad, the gradients of the sum too."""
        n = len(target)
        own = np.where(target < CLASSES * PER_CLASS, target // PER_CLASS, target - CLASSES * PER_CLASS + CLASSES)
        every = np.arange(n)
        logits = self.wc.T @ h.T  # a target a column: numpy takes the most and the sum of long rows faster
        logits += self.bc[:, None]
        logits -= logits.max(0)
        out = logits[own, every]
        p = np.exp(logits, out=logits)
        total = p.sum(0)
        out -= np.log(total)
        dh = None
        if grad is not None:
            p /= -total
            p[own, every] += 1
            grad.wc += (p @ h).T
            grad.bc += p.sum(1)
            dh = (self.wc @ p).T.copy()
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(CLASSES + 1))
        if grad is not None:
            self._in_class(h, target, order, edges, out, dh, grad)
            return out, dh
        for c in range(CLASSES):
            at = order[edges[c] : edges[c + 1]]
            if not len(at):
                continue
            s = self.wo[c] @ h[at].T
            s += self.bo[c][:, None]
            s -= s.max(0)
            own = s[target[at] % PER_CLASS, np.arange(len(at))]
            out[at] += own - np.log(np.exp(s, out=s).sum(0))
        return out, dh

    def _in_class(self, h: np.ndarray, target: np.ndarray, order: np.ndarray, edges: np.ndarray, out: np.ndarray, dh: np.ndarray, grad: Net) -> None:
        """Adds the part of the softmax in the class, for all classes at once: each class's targets lie in blocks of BLOCK rows."""
        counts = np.diff(edges)
        blocks = -(-counts // BLOCK)
        if not blocks.any():
            return
        at, kind = order[: edges[-1]], np.repeat(np.arange(CLASSES), blocks)
        ends = np.cumsum(blocks)
        place = np.arange(len(at)) + np.repeat((ends - blocks) * BLOCK - edges[:-1], counts)
        hb = np.zeros((len(kind) * BLOCK, HIDDEN), h.dtype)
        hb[place] = h[at]
        hb = hb.reshape(-1, BLOCK, HIDDEN)
        wo, word = self.wo[kind], target[at] % PER_CLASS
        s = (hb @ wo.transpose(0, 2, 1) + self.bo[kind][:, None]).reshape(-1, PER_CLASS)
        s -= s.max(1, keepdims=True)
        own = s[place, word]
        q = np.exp(s, out=s)
        total = q @ np.ones((PER_CLASS, 1), q.dtype)
        out[at] += own - np.log(total[place, 0])
        q /= -total
        q[place, word] += 1
        empty = np.ones(len(q), bool)
        empty[place] = False
        q[empty] = 0
        q = q.reshape(-1, BLOCK, PER_CLASS)
        here = np.flatnonzero(blocks)
        first = (ends - blocks)[here]
        grad.wo[here] += np.add.reduceat(q.transpose(0, 2, 1) @ hb, first)
        grad.bo[here] += np.add.reduceat(q.sum(1), first)
        dh[at] += (q @ wo).reshape(-1, HIDDEN)[place]


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes, longest first, each to the shortest lane."""
    import heapq

    heap = [(0, i) for i in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for t in np.argsort(-lengths, kind="stable").tolist():
        n, i = heap[0]
        out[i].append(t)
        heapq.heapreplace(heap, (n + int(lengths[t]), i))
    return sorted((x for x in out if x), key=lambda x: -sum(lengths[t] for t in x))


def runs_of(first: np.ndarray, most: int) -> np.ndarray:
    """Edges of the texts, a text of more than `most` tokens cut into runs of about equal length."""
    lengths = np.diff(first)
    cuts = np.maximum(1, -(-lengths // most))
    number = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    return np.append(np.repeat(first[:-1], cuts) + np.repeat(lengths, cuts) * number // np.repeat(cuts, cuts), first[-1])


def laid_out(ids: np.ndarray, first: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, texts, runs): for each lane and step the token's place (-1 past the end), whether a text starts there and
    whether a run does. A text longer than a lane's share is spread over lanes as runs of LEAST_RUN tokens or more."""
    edges = runs_of(first, max(2 * LEAST_RUN, -(-len(ids) // lanes)))
    dealt = lanes_of(np.diff(edges), lanes)
    rows = [np.concatenate([np.arange(edges[t], edges[t + 1]) for t in lane]) for lane in dealt]
    places = np.full((len(rows), max(len(x) for x in rows)), -1, np.int64)
    for i, x in enumerate(rows):
        places[i, : len(x)] = x
    begins = np.zeros((2, len(ids) + 1), bool)
    begins[0, first[:-1]] = True
    begins[1, edges[:-1]] = True
    return places, begins[0][places] & (places >= 0), begins[1][places] & (places >= 0)


def train(net: Net, ids: np.ndarray, first: np.ndarray, moments: list[np.ndarray], step: int) -> int:
    """Truncated backpropagation over texts in lanes, WINDOW steps at a time; the state goes on to the end of a run.
    Every token is learned from; where few lanes are left, by smaller steps."""
    k, enough = HIDDEN, max(2, LANES // 8)
    places, starts, fresh = (np.ascontiguousarray(x.T) for x in laid_out(ids, first, LANES))
    kind = net.flat.dtype
    h0 = np.zeros((places.shape[1], k), kind)
    grad = Net(np.zeros(Net.SIZE, kind))
    half = np.repeat(np.array([0.5, 1.0], kind), [2 * k, k])  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    for at in range(0, len(places), WINDOW):
        active = int(np.count_nonzero(places[at] >= 0))
        window, begin = places[at : at + WINDOW, :active], fresh[at : at + WINDOW, :active]
        live, size = window >= 0, len(window)
        before = np.where(starts[at : at + WINDOW, :active], Net.START, ids[window - 1])
        keep, begun = (~begin)[:, :, None], begin.any(1).tolist()
        grad.flat[:] = 0
        px, wh = (net.embed[before] @ net.wx + net.b) * half, net.wh * half
        past, states = np.empty((size, active, k), kind), np.empty((size, active, k), kind)
        gates, hidden = np.empty((size, active, 2 * k), kind), np.empty((size, active, k), kind)
        new = np.empty((size, active, k), kind)
        g, h = np.empty((active, 3 * k), kind), h0[:active]
        for t in range(size):
            if begun[t]:
                np.multiply(h, keep[t], out=past[t])
            else:
                past[t] = h
            np.matmul(past[t], wh, out=g)
            hidden[t] = g[:, 2 * k :]
            x, n, h = gates[t], new[t], states[t]
            np.add(px[t, :, : 2 * k], g[:, : 2 * k], out=x)
            np.tanh(x, out=x)
            x *= 0.5
            x += 0.5
            np.multiply(x[:, :k], hidden[t], out=n)
            n += px[t, :, 2 * k :]
            np.tanh(n, out=n)
            np.subtract(past[t], n, out=h)
            h *= x[:, k:]
            h += n
        h0[:active] = h
        d = np.zeros_like(states)
        _, d[live] = net.output(states[live], ids[window[live]], grad)
        # the gradients of a step are those of its state times what all steps have at hand
        r, z = gates[:, :, :k], gates[:, :, k:]
        dn = (1 - z) * (1 - new * new)
        by_state = np.stack([dn * hidden * r * (1 - r), (past - new) * z * (1 - z), dn * r], 2)
        dg, back = np.empty((size, active, 3, k), kind), net.wh.T.copy()
        carry = np.zeros((active, k), kind)
        for t in range(size - 1, -1, -1):
            d[t] += carry
            np.multiply(d[t][:, None], by_state[t], out=dg[t])
            np.matmul(dg[t].reshape(active, 3 * k), back, out=carry)
            carry += d[t] * z[t]
            if begun[t]:
                carry *= keep[t]
        grad.wh += past.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        dg[:, :, 2] = d * dn
        flat_px, flat_in = dg.reshape(-1, 3 * k), before.ravel()
        grad.b += flat_px.sum(0)
        grad.wx += net.embed[flat_in].T @ flat_px
        order = np.argsort(flat_in, kind="stable")
        words = flat_in[order]
        edges = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        grad.embed[words[edges]] += np.add.reduceat((flat_px @ net.wx.T)[order], edges)
        g = grad.flat
        g /= max(1, np.count_nonzero(live))
        g *= min(1.0, 1.0 / (np.sqrt(g @ g) + 1e-9))
        step += 1
        m, v = moments
        m += 0.1 * (g - m)
        g *= g
        g -= v
        g *= 0.005
        v += g
        np.sqrt(v, out=g)
        g /= np.sqrt(1 - 0.995**step)
        g += 1e-6
        np.divide(m, g, out=g)
        g *= RATE * min(1.0, active / enough) / (1 - 0.9**step)
        net.flat += g
    return step


def log_probabilities(net: Net, ids: np.ndarray, first: np.ndarray, lanes: int = 192, window: int = 64) -> np.ndarray:
    """The log-probability of every token given all before it in its text."""
    out = np.zeros(len(ids), np.float32)
    if not len(ids):
        return out
    lengths_of = np.diff(first)
    dealt = lanes_of(lengths_of, lanes)
    order = np.concatenate([np.asarray(x) for x in dealt])
    ends = np.cumsum(lengths_of[order])
    places = np.arange(ends[-1]) + np.repeat(first[order] - (ends - lengths_of[order]), lengths_of[order])
    before = np.append(Net.START, ids[:-1])
    before[first[:-1]] = Net.START
    before, ids = before[places], ids[places]
    begins = np.zeros(len(ids), bool)
    begins[ends - lengths_of[order]] = True
    lengths = np.array([int(lengths_of[x].sum()) for x in dealt])
    base = np.cumsum(lengths) - lengths
    k, half = HIDDEN, np.repeat(np.array([0.5, 1.0], np.float32), [2 * HIDDEN, HIDDEN])  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    table, wh = (net.embed @ net.wx + net.b) * half, net.wh * half
    h = np.zeros((len(dealt), HIDDEN), np.float32)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right").tolist()
    for at in range(0, longest, window):
        states, where = [], []
        for t in range(at, min(at + window, longest)):
            m = active[t]
            here = base[:m] + t
            h, new = h[:m], begins[here]
            if new.any():
                h = np.where(new[:, None], np.float32(0), h)
            g, x = h @ wh, table[before[here]]
            gates = x[:, : 2 * k] + g[:, : 2 * k]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = gates[:, :k] * g[:, 2 * k :]
            n += x[:, 2 * k :]
            np.tanh(n, out=n)
            h = h - n
            h *= gates[:, k:]
            h += n
            states.append(h)
            where.append(here)
        place = np.concatenate(where)
        out[places[place]] = net.output(np.concatenate(states), ids[place])[0]
    return out


class Vocabulary:
    """Counts of frequent words and the model's own words, by sorted hash."""

    def __init__(self, h: np.ndarray, tail: np.ndarray, c: np.ndarray, total: int, different: int, tail_c: np.ndarray, tail_n: np.ndarray):
        """h, tail, c: the most frequent tokens, first the most frequent; tail_c and tail_n: count and number of all words by tail class."""
        self.total, self.scale = total, np.log10(total + ADD * (different + 1))
        own = CLASSES * PER_CLASS
        lead = np.flatnonzero(h != END)[: own - 1]
        model = np.concatenate((np.flatnonzero(h == END), lead))
        # classes of equal size by rank: frequent words share classes with frequent ones
        self.counts = np.zeros(own)
        self.counts[: len(model)] = c[model]
        word = np.full(len(h), -1, np.int64)
        word[model] = np.arange(len(model))
        for i in model.tolist():
            if h[i] != END:
                tail_c[tail[i]] -= c[i]
                tail_n[tail[i]] -= 1
        self.tail_counts = tail_c
        self.tail_log = np.log10(np.maximum(tail_c + ADD * (tail_n + 1), 1e-9)) - self.scale
        order = np.argsort(h)
        self.h, self.word = h[order], word[order]
        self.base = (np.log10(c[order] + ADD) - self.scale).astype(np.float64)
        self.edges = np.append(np.searchsorted(self.h, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)), len(self.h)).astype(np.int32)
        self.deep = int(np.diff(self.edges).max()).bit_length()

    def lookup(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input and target numbers, base log10 where known, whether the count is known here)."""
        if not len(self.h):
            return CLASSES * PER_CLASS + tails.astype(np.int64), np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        lead = (hashes >> np.uint64(64 - LEAD)).astype(np.int64)
        at, end = self.edges[lead], self.edges[lead + 1]
        for _ in range(self.deep):
            mid = (at + end) >> 1
            less = (self.h[np.minimum(mid, len(self.h) - 1)] < hashes) & (at < end)
            at, end = np.where(less, mid + 1, at), np.where(less, end, mid)
        at[at == len(self.h)] = 0
        here = self.h[at] == hashes
        word = np.where(here, self.word[at], -1)
        return np.where(word >= 0, word, CLASSES * PER_CLASS + tails), np.where(here, self.base[at], 0.0), here


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """counts: (h, tail, c). The driver gets `head` rows and sums by tail class."""
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.col("c").desc(), "h").limit(head).union(counts.where(F.col("h") == int(END.view(np.int64)))).distinct().orderBy(F.col("c").desc(), "h").toPandas()
    tail_c, tail_n = np.zeros(TAILS), np.zeros(TAILS)
    for t, c, n in counts.where(F.col("h") != int(END.view(np.int64))).groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect():
        tail_c[t], tail_n[t] = c, n
    return Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["tail"].to_numpy(np.int64), top["c"].to_numpy(np.int64), total, different, tail_c, tail_n)


def fit(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Net:
    """A net from all docs (doc_id, text): in round i from those whose hash modulo rounds is i."""
    net = Net.start(words.counts, words.tail_counts)
    for i in range(rounds):
        common = docs.sparkSession.sparkContext.broadcast((net.flat, words))

        def run(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            flat, vocab = common.value
            own, moments, step, seen = Net(flat.copy()), [np.zeros(Net.SIZE, np.float32) for _ in range(2)], 0, 0
            for _, _, hashes, tails, first in grouped(x for batch in batches for x in tokens(batch.column(0))):
                ids = vocab.lookup(hashes, tails)[0]
                step = train(own, ids, first, moments, step)
                seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(Net.SIZE, dtype=np.int32)), pa.array(own.flat.astype(np.float64) * seen), pa.array(np.full(Net.SIZE, float(seen)))], ["i", "v", "w"])

        part = docs.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == i).select("text")
        mean = part.mapInArrow(run, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).orderBy("i").toPandas()
        if len(mean):
            net = Net(mean["v"].to_numpy(np.float32).copy())
    return net


def score_documents(docs: DataFrame, parts: int = 10) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10).

    Documents whose crc32(doc_id as text) modulo parts is not 0 are learned from; a row with
    a null id is neither learned from nor held out. A null text is empty and has one token,
    the end. Without training documents every word is unseen and the model is its start.
    Rows that repeat are kept, and each counts.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts))
    counts = written(token_counts(learn), "counts")
    words = vocabulary(counts)
    net = fit(learn, words)
    shared = spark.sparkContext.broadcast((net.flat, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, vocab = shared.value
        own, row = Net(flat), TaskContext.get().partitionId() << 40
        ln10 = np.log(10.0)
        for batch in batches:
            for i, j, hashes, tails, first in grouped(tokens(batch.column(1))):
                ids, base, known = vocab.lookup(hashes, tails)
                logs = log_probabilities(own, ids, first) / ln10
                in_tail = ids >= CLASSES * PER_CLASS
                logs = logs.astype(np.float64) + np.where(in_tail, base - vocab.tail_log[np.where(in_tail, ids - CLASSES * PER_CLASS, 0)], 0.0)
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, logs)]
                n_known = np.add.reduceat(known.astype(np.int64), first[:-1])
                rare = np.flatnonzero(~known)
                edges = np.searchsorted(rare, first).astype(np.int32)
                rows = np.arange(row, row + j - i)
                row += j - i
                arrays = [batch.column(0).slice(i, j - i), pa.array(rows), pa.array(np.diff(first).astype(np.int64)), pa.array(n_known), *(pa.array(x) for x in sums)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes[rare].view(np.int64)))], ["doc_id", "row", "n_tokens", "n_known", "base", "model", "rare"])

    schema = f"doc_id {kind}, row bigint, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>"
    scored = written(docs.mapInArrow(run, schema), "scored")
    rare = scored.where(F.size("rare") > 0).select("row", F.explode("rare").alias("h"))
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD)) - F.lit(float(words.scale))
    per_row = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(log).alias("rare_log"), F.count("c").alias("rare_known"))
    full = scored.drop("rare").join(per_row, "row", "left")
    added = F.coalesce("rare_log", F.lit(0.0))
    return full.select(
        "doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"), (F.col("base") + added).alias("base_score"), (F.col("model") + added).alias("score"),
    )
