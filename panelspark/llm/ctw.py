"""Operator 8: language-model scoring by context-tree weighting.

A text is a sequence of tokens (words, then one end); a token is its bytes and a
terminator, each byte eight binary decisions.  The context of a decision is the
bits of its byte so far and up to DEPTH bytes before it within the token.  Every
context has a Krichevsky-Trofimov estimate, and context-tree weighting mixes the
estimates of all depths by how well each coded the training tokens.  There is a tree
for each of the most frequent values of a label column (the language, say), and a
text's probability is the mean over these trees: scoring never sees the label.

Counts cover every training document: words are counted by a shuffle, and byte
contexts by a second one over the distinct words.  Every context that occurs stays
in the tree, however rare.  Depths up to TOP, which the alphabet bounds, are weighed
on the driver and broadcast; the subtrees below are dealt over shards by their TOP + 1
nearest bytes, folded there for the top, and meet the distinct contexts that chunks of
distinct words ask for.  Word counts for the base score come from a join; the words
that make up a 1/HOT share of all tokens or more (HOT at the most) are broadcast
instead, so no join key is hot.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, load, row_keys, scratch, slices, text_batches
from .language import remainder
from .words import Lookup, joined

DEPTH, TOP, HOT, CLASSES = 7, 2, 500_000, 6
#: About so many rows of counts make a shard of the trees, and so many distinct words a chunk.
SHARD_ROWS, CHUNK_WORDS = 50_000, 100_000
#: Distinct words that a worker counts at a time, and bytes of text handled at a time.
COUNTED, CHUNK_BYTES = 300_000, 2_000_000
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, then the end."""
    out = text.lower().split()
    out.append(END)
    return out


# --- counting ---------------------------------------------------------------


def _count_words(batches):
    """(class, text) to (class, word, n), merged per worker up to COUNTED words; class -1 gives words that don't count."""
    counts: dict[int, Counter[bytes]] = {}

    def flush():
        for k, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(list(own), pa.binary()), pa.array(list(own.values()) if k >= 0 else [0] * len(own), pa.int64())], ["class", "word", "n"])
        counts.clear()

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            counts.setdefault(k, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from flush()
    yield from flush()


def _coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words between spaces (the end has no terminator but itself), offsets in their word, and starts."""
    data, starts = joined(words, b" ", b" ")
    offset = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    return data, offset, starts


def _past_end(words: list[bytes], starts: np.ndarray) -> list[int]:
    """Places of the terminators of ends: an end needs none but itself."""
    return [int(starts[i]) + 2 for i, w in enumerate(words) if w == END] if END in words else []


def _contexts(data: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before each position, the nearest in the lowest byte."""
    out = np.zeros(len(data), np.uint64)
    for k in range(1, depth + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * (k - 1))
    return out


def _count_grams(depth: int, most: int = CHUNK_BYTES):
    """(word, n) of one class to (class, depth, context, byte, n) at the deepest context each byte has."""
    low = np.uint64(255)

    def run(batches):
        kept: dict[tuple[int, int], list] = {}
        size = 0

        def merge() -> int:
            total = 0
            for own in kept.values():
                keys, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                own[:] = [(keys, np.bincount(back, np.concatenate([n for _, n in own])))]
                total += len(keys)
            return total

        def flush():
            for (k, d), own in kept.items():
                for keys, n in own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), d, np.int32)), pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array((keys & low).astype(np.int32)), pa.array(n.astype(np.int64))], ["class", "depth", "context", "byte", "n"])
            kept.clear()

        for batch in batches:
            of, words, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lo, hi in slices([len(w) + 2 for w in words], CHUNK_BYTES // 4):
                data, offset, starts = _coded(words[lo:hi])
                context = _contexts(data, depth)
                times = np.repeat(n[lo:hi], np.diff(starts)).astype(np.float64)
                times[_past_end(words[lo:hi], starts)] = 0
                each = np.repeat(of[lo:hi], np.diff(starts))
                for k in np.unique(of[lo:hi]).tolist():
                    for d in range(1, depth + 1):
                        own = np.flatnonzero((offset == d if d < depth else offset >= d) & (times > 0) & (each == k))
                        kept.setdefault((k, d), []).append(((context[own] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | data[own], times[own]))
                        size += len(own)
            if size > 3 * most:
                size = merge()
                if size > most:
                    yield from flush()
                    size = 0
        merge()
        yield from flush()

    return run


# --- the trees ----------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series after a shift by eight."""
    y = x + 8.0
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


class Tree:
    """A weighted tree as log10 probabilities.

    By depth: sorted context numbers with an escape each, and sorted (context, byte)
    numbers with a probability each.  A byte never seen after a context gets the
    escape times its probability after the parent context; one never seen at all
    gets an equal part of what the root leaves.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels
        self.lookups: list[tuple[Lookup, Lookup]] = []
        self.edge: tuple = ()

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each token."""
        return self.coded_scores(words, *_coded(words))

    def coded_scores(self, words: list[bytes], data: np.ndarray, offset: np.ndarray, starts: np.ndarray, full: np.ndarray | None = None) -> np.ndarray:
        if not words:
            return np.zeros(0)
        full = _contexts(data, max(0, len(self.levels) - 1)) if full is None else full
        each = self.byte_scores(data, offset, full)
        each[_past_end(words, starts)] = 0
        return np.add.reduceat(each, starts[:-1])

    def byte_scores(self, data: np.ndarray, offset: np.ndarray, full: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after the ``offset`` bytes of its context at the most; 0 at offset 0."""
        self.lookups = self.lookups or [(Lookup(contexts), Lookup(keys)) for contexts, _, keys, _ in self.levels]
        each = np.zeros(len(data))
        depth = len(self.levels) - 1
        known = np.zeros(len(data), np.int64)  # the deepest context of each position
        at = np.flatnonzero(offset > 0)
        todo: list[tuple[np.ndarray, np.ndarray]] = [(at, np.zeros(len(at), np.int64))] if depth >= 0 and len(self.levels[0][0]) else []
        for d in range(1, depth + 1 if todo else 0):
            at = at[offset[at] >= d]
            place = self.lookups[d][0].find(full[at] & np.uint64((1 << 8 * d) - 1))
            at, place = at[place >= 0], place[place >= 0]
            known[at] = d
            todo.append((at, place))
        if not todo:
            each[at] = -8 * math.log10(2)
        left = np.zeros(len(data), bool)
        for d in range(len(todo) - 1, -1, -1):
            at, place = todo[d]
            own = (known[at] == d) | left[at]
            at, place = at[own], place[own]
            key = (full[at] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | data[at]
            found = self.lookups[d][1].find(key)
            hit = found >= 0
            each[at[hit]] += self.levels[d][3][found[hit]]
            each[at[~hit]] += self.levels[d][1][place[~hit]]
            left[at] = ~hit
        return each


def _nodes(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary decomposition of rows (context number, byte, n): sorted node keys with their zeros and ones, and the nodes on each row's path (rows x 8)."""
    k = np.arange(8)
    node = (1 << k) | (byte[:, None] >> (8 - k))
    bit = (byte[:, None] >> (7 - k)) & 1
    keys, path = np.unique(context[:, None] * 256 + node, return_inverse=True)
    path = path.reshape(node.shape)
    times = np.repeat(n[:, None], 8, 1).astype(np.float64)
    ones = np.bincount(path.ravel(), (times * bit).ravel(), len(keys))
    zeros = np.bincount(path.ravel(), (times * (1 - bit)).ravel(), len(keys))
    return keys, zeros, ones, path


def _low(d: int) -> np.uint64:
    return np.uint64((1 << 8 * d) - 1)


def _fold(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0, under: tuple | None = None):
    """Bottom-up: contexts, their numbers by row, nodes, their parents' places, weights and leaves by depth, and the log weighted probability of the first depth's nodes.

    What a context has seen beyond its children in the tree is one more child, a leaf.
    """
    contexts = [np.unique(c) for c, _, _ in rows]
    number = [np.searchsorted(u, c) for u, (c, _, _) in zip(contexts, rows, strict=True)]
    made = [_nodes(i, b.astype(np.int64), n) for i, (_, b, n) in zip(number, rows, strict=True)]
    depths = len(rows)
    up = [np.zeros(0, np.int64)]
    for d in range(1, depths):
        above = np.searchsorted(contexts[d - 1], contexts[d] & _low(first + d - 1))
        keys = made[d][0]
        up.append(np.searchsorted(made[d - 1][0], above[keys >> 8] * 256 + (keys & 255)) if len(keys) else np.zeros(0, np.int64))
    weight, leaf = [np.zeros(0)] * depths, [np.zeros(0)] * depths
    below = np.zeros(0)
    for d in range(depths - 1, -1, -1):
        keys, zeros, ones, _ = made[d]
        left0, left1, split = zeros.copy(), ones.copy(), np.zeros(len(zeros))
        m = len(zeros)
        if d + 1 < depths and len(below):
            left0 -= np.bincount(up[d + 1], made[d + 1][1], m)
            left1 -= np.bincount(up[d + 1], made[d + 1][2], m)
            split += np.bincount(up[d + 1], below, m)
        elif d + 1 == depths and under is not None and len(under[0]):
            place = np.searchsorted(keys, np.searchsorted(contexts[d], under[0]) * 256 + under[1])
            left0[place] -= under[2]
            left1[place] -= under[3]
            split[place] += under[4]
        estimate = _log_kt(zeros, ones)
        split += _log_kt(left0, left1)
        weight[d] = 1 / (1 + np.exp(np.clip(split - estimate, -700, 700)))
        leaf[d] = (left1 + 0.5) / (left0 + left1 + 1)
        below = np.logaddexp(estimate, split) - math.log(2)
    return contexts, number, made, up, weight, leaf, below


def weigh(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0, under: tuple | None = None, above: tuple | None = None) -> Tree:
    """Weight a tree.  rows: by depth, (context, byte, n) sorted by context and byte; the parent of every context is in the tree.

    A top has ``under``: the (context, node, zeros, ones, log weighted probability) that
    its deepest nodes' children sum to.  A subtree from depth ``first`` on has ``above``,
    the ``edge`` of the top's tree.
    """
    contexts, number, made, up, weight, leaf, _ = _fold(rows, first, under)
    levels, before = [], np.zeros(0)
    sums = remaining = np.zeros(0)
    for d in range(len(rows)):
        keys, zeros, ones, path = made[d]
        one = (ones + 0.5) / (zeros + ones + 1)
        if d == 0 and above is None:
            sums, remaining = weight[0] * one, 1 - weight[0]
        else:
            if d == 0:
                nodes, sums, remaining, upper, before = above
                place = np.searchsorted(nodes, (contexts[0][keys >> 8] & _low(first - 1)) << np.uint64(8) | (keys & 255).astype(np.uint64))
            else:
                place = up[d]
            sums, remaining = sums[place] + remaining[place] * weight[d] * one, remaining[place] * (1 - weight[d])
        final = np.log10(np.stack([1 - (p := sums + remaining * leaf[d]), p]))
        byte = rows[d][1].astype(np.int64)
        bits = (byte[:, None] >> (7 - np.arange(8))) & 1
        probability = final[bits, path].sum(1) if len(byte) else np.zeros(0)
        m = len(contexts[d])
        unseen = np.maximum(1 - np.bincount(number[d], 10**probability, m), 1e-12)
        if d == 0 and above is None:
            escape = np.log10(unseen / np.maximum(1, 256 - np.bincount(number[d], minlength=m)))
        elif m:
            row = np.searchsorted(levels[d - 1][2] if d else upper, (rows[d][0] & _low(first + d - 1)) << np.uint64(8) | byte.astype(np.uint64))
            escape = np.log10(unseen / np.maximum(1 - np.bincount(number[d], 10 ** before[row], m), 1e-12))
        else:
            escape = np.zeros(0)
        levels.append((contexts[d], escape, rows[d][0] << np.uint64(8) | byte.astype(np.uint64), probability))
        before = probability
    tree = Tree(levels)
    tree.edge = (contexts[-1][keys >> 8] << np.uint64(8) | (keys & 255).astype(np.uint64), sums, remaining, levels[-1][2], before)
    return tree


def _rows(deepest: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray, first: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts at each byte's deepest context to those at all depths from ``first`` on."""
    keys, times, out = np.zeros(0, np.uint64), np.zeros(0), []
    for d in range(depth, first - 1, -1):
        own = (deepest == d) | ((deepest > d) & (d == depth))
        keys = np.concatenate([keys, context[own].astype(np.uint64) << np.uint64(8) | byte[own].astype(np.uint64)]) & _low(d + 1)
        keys, back = np.unique(keys, return_inverse=True)
        times = np.bincount(back, np.concatenate([times, n[own]]), len(keys))
        out.insert(0, (keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64), times))
    return out


def _columns(table: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (((context & _low(TOP + 1)).astype(np.int64) * 2_654_435_761) >> 16) % shards


def _fold_shard(depth: int):
    """A class's counts in a shard to what the nodes of its shallowest contexts sum to by their parent's node."""

    def run(key, table):
        _, _, made, _, _, _, below = folded = _fold(_rows(*_columns(table, ("depth", "context", "byte", "n")), TOP + 1, depth), TOP + 1)
        keys, zeros, ones, _ = made[0]
        nodes, back = np.unique((folded[0][0][keys >> 8] & _low(TOP)).astype(np.int64) << 8 | (keys & 255), return_inverse=True)
        sums = [np.bincount(back, x, len(nodes)) for x in (zeros, ones, below)]
        return pa.table([pa.array(np.full(len(nodes), key[0].as_py(), np.int32)), pa.array(nodes >> 8), pa.array((nodes & 255).astype(np.int32)), *map(pa.array, sums)], ["class", "context", "node", "zeros", "ones", "below"])

    return run


def _trees(grams: DataFrame, classes: int, depth: int) -> list[Tree]:
    """The top of each class's tree, weighed with all that the shards hold below it."""
    top = min(TOP, depth)
    shallow = grams.groupBy("class", F.least("depth", F.lit(top)).alias("depth"), F.col("context").bitwiseAND(int(_low(top))).alias("context"), "byte").agg(F.sum("n").alias("n")).toArrow()
    k_of, *counts = _columns(shallow, ("class", "depth", "context", "byte", "n"))
    under_of, under = None, []
    if depth > TOP:
        folded = grams.where(F.col("depth") > TOP).groupBy("class", "shard").applyInArrow(_fold_shard(depth), "class int, context long, node int, zeros double, ones double, below double")
        sums = folded.groupBy("class", "context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
        under_of, *under = _columns(sums, ("class", "context", "node", "zeros", "ones", "below"))
        under[0] = under[0].astype(np.uint64)
    return [weigh(_rows(*(x[k_of == k] for x in counts), 0, top), 0, tuple(x[under_of == k] for x in under) if under else None) for k in range(classes)]


def _classes(docs: DataFrame, column: str | None, most: int):
    """(class number column, log10 share of each class's training rows): the most frequent values, and one class for the rest."""
    if column is None:
        return F.lit(0), [0.0]
    counts = docs.where("not held_out").groupBy("label").agg(F.count("*").alias("n"))
    top = [r for r in counts.where("label is not null").orderBy(F.desc("n"), "label").limit(most).collect()]
    every = counts.agg(F.sum("n")).first()[0] or 0
    rest = every - sum(r.n for r in top)
    number = F.lit(len(top))
    for i, r in enumerate(top):
        number = F.when(F.col("label") == r.label, i).otherwise(number)
    shares = [r.n / every for r in top] + ([rest / every] if rest else [])
    return number, [math.log10(x) for x in shares] or [0.0]


# --- scoring -----------------------------------------------------------------


def _ask(depth: int, shards: int):
    """A chunk of words to the (context, byte) keys that it needs of each shard."""

    def run(key, table):
        words, found = table.column("word").to_pylist(), []
        for lo, hi in slices([len(w) + 2 for w in words], CHUNK_BYTES):
            data, offset, _ = _coded(words[lo:hi])
            at = offset > TOP
            found.append(np.unique(_keys(data, offset, depth)[at]))
        keys = np.unique(np.concatenate(found))
        of = _shard_of(keys >> np.uint64(8), shards)
        by = np.argsort(of, kind="stable")
        which, starts = np.unique(of[by], return_index=True)
        parts = [x.tobytes() for x in np.split(keys[by], starts[1:])] if len(keys) else []
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array(which, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "shard", "keys"])

    return run


def _keys(data: np.ndarray, offset: np.ndarray, depth: int) -> np.ndarray:
    """Each byte behind its context, which doesn't go beyond the space before its word."""
    keep = np.uint64(8) * np.minimum(offset, depth).astype(np.uint64)
    return (_contexts(data, depth) & ((np.uint64(1) << keep) - np.uint64(1))) << np.uint64(8) | data


def _key_depths(keys: np.ndarray, depth: int) -> np.ndarray:
    """Depth of each key's context: up to the space before the word, which no word holds."""
    out = np.full(len(keys), depth, np.int64)
    for d in range(depth - 1, 0, -1):
        out[(keys >> np.uint64(8 * d)) & np.uint64(255) == 32] = d
    return out


def _answer(shared, depth: int):
    """A shard's keys by chunk, and its counts, to each key's log10 probability in each class's tree."""

    def run(key, asked, counts):
        chunks = asked.column("chunk").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in asked.column("keys").to_pylist()]
        if not parts:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["chunk", "keys", "scores"])
        keys = np.unique(np.concatenate(parts))
        k_of, *own = _columns(counts, ("class", "depth", "context", "byte", "n"))
        data, offset, full = (keys & np.uint64(255)).astype(np.uint8), _key_depths(keys, depth), keys >> np.uint64(8)
        scores = np.zeros((len(keys), len(shared.value)), np.float32)
        for k, (levels, edge) in enumerate(shared.value):
            deep = weigh(_rows(*(x[k_of == k] for x in own), TOP + 1, depth), TOP + 1, above=edge).levels
            scores[:, k] = Tree(levels + deep).byte_scores(data, offset, full)
        found = [scores[np.searchsorted(keys, x)].tobytes() for x in parts]
        return pa.table([pa.array(chunks, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(found, pa.binary())], ["chunk", "keys", "scores"])

    return run


def _finish(shared, depth: int):
    """A chunk of words and the answers to its keys to (word, n, scores): the log10 probability of a token in each class's tree."""

    def run(key, words, answers):
        tops = [Tree(levels) for levels, _ in shared.value]
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in answers.column("keys").to_pylist())])
        scores = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in answers.column("scores").to_pylist())]).reshape(-1, len(tops))
        by = np.argsort(keys)
        keys, scores = keys[by], scores[by]
        flat, out = words.column("word").to_pylist(), []
        for lo, hi in slices([len(w) + 2 for w in flat], CHUNK_BYTES):
            own = flat[lo:hi]
            data, offset, starts = _coded(own)
            full = _contexts(data, depth)
            deep = np.flatnonzero(offset > TOP) if depth > TOP else np.zeros(0, np.int64)
            place = np.searchsorted(keys, _keys(data, offset, depth)[deep])
            near = np.flatnonzero((offset > 0) & (offset <= TOP)) if depth > TOP else np.flatnonzero(offset > 0)
            end = _past_end(own, starts)
            each = np.zeros((len(data), len(tops)))
            each[deep] = scores[place]
            for k, tree in enumerate(tops):
                each[near, k] = tree.byte_scores(data[near], offset[near], full[near])
            each[end] = 0
            out.append(np.add.reduceat(each, starts[:-1]).astype(np.float32))
        flat_scores = np.concatenate(out).ravel() if out else np.zeros(0, np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(tops)), pa.array(flat_scores))
        return pa.table([words.column("word"), words.column("n"), lists], ["word", "n", "scores"])

    return run


def _scored_words(by_class: DataFrame, classes: int, depth: int) -> DataFrame:
    """(word, n, scores) of all distinct words: trees in shards meet the keys of words in chunks."""
    spark = by_class.sparkSession
    grams = by_class.where("class >= 0").mapInArrow(_count_grams(depth), "class int, depth int, context long, byte int, n long").groupBy("class", "depth", "context", "byte").agg(F.sum("n").alias("n"))
    grams = scratch(grams, "ctw-grams")
    shards = grams.count() // SHARD_ROWS + 1
    grams = grams.withColumn("shard", F.shiftright(F.col("context").bitwiseAND(int(_low(TOP + 1))) * F.lit(2_654_435_761), 16) % shards)
    tops = spark.sparkContext.broadcast([(t.levels, t.edge) for t in _trees(grams, classes, depth)])
    words = scratch(by_class.groupBy("word").agg(F.sum("n").alias("n")), "ctw-vocabulary")
    words = words.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(words.count() // CHUNK_WORDS + 1)))
    answered = spark.createDataFrame([], "chunk long, keys binary, scores binary")
    if depth > TOP:
        asked = words.groupBy("chunk").applyInArrow(_ask(depth, shards), "chunk long, shard long, keys binary")
        answered = asked.groupBy("shard").cogroup(grams.where(F.col("depth") > TOP).groupBy("shard")).applyInArrow(_answer(tops, depth), "chunk long, keys binary, scores binary")
    return words.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_finish(tops, depth), "word binary, n long, scores array<float>")


def _score(shared, classes: int):
    """(doc_id, held_out, text) to one row per text with what its common words give, and one per text and other word, for the join."""
    names = ["word", "row", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", *(f"s{k}" for k in range(classes))]

    def run(batches):
        hot, hot_base, hot_scores = shared.value
        number, seen = dict(zip(hot, range(len(hot)), strict=True)).get, 0
        hot_known = hot_base[1]
        hot_base = hot_base[0]
        for batch in batches:
            keys = row_keys(seen, batch.num_rows).to_numpy()
            seen += batch.num_rows
            texts = as_bytes(batch.column(2))
            for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
                n = hi - lo
                own = [tokens(t) for t in texts[lo:hi]]
                sizes = np.fromiter(map(len, own), np.int64, n)
                at = np.fromiter((number(w, -1) for x in own for w in x), np.int64, int(sizes.sum()))
                of = np.repeat(np.arange(n), sizes)
                known = at >= 0
                place, of_known = at[known], of[known]
                base = np.bincount(of_known, hot_base[place], n)
                hits = np.bincount(of_known, hot_known[place], n)
                sums = [np.bincount(of_known, hot_scores[place, k], n) for k in range(classes)]
                rare: list[tuple[int, bytes, int]] = []
                cuts = np.searchsorted(np.flatnonzero(~known), np.concatenate([[0], np.cumsum(sizes)])).tolist()
                places = (np.flatnonzero(~known) - np.repeat(np.cumsum(sizes) - sizes, np.diff(cuts))).tolist()
                for i, x in enumerate(own):
                    if cuts[i] < cuts[i + 1]:
                        rare += [(i, w, k) for w, k in Counter([x[j] for j in places[cuts[i] : cuts[i + 1]]]).items()]
                rows, words, times = zip(*rare, strict=True) if rare else ((), (), ())
                m = len(rows)
                pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])  # noqa: E731, B023
                every = [
                    pa.array([b" %d" % k for k in keys[lo:hi].tolist()] + list(words), pa.binary()),
                    pa.array(np.concatenate([keys[lo:hi], keys[lo:hi][list(rows)] if m else np.zeros(0, np.int64)])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), np.array(times, np.int64)])),
                    pa.concat_arrays([batch.column(0).slice(lo, n), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([batch.column(1).slice(lo, n), pa.nulls(m, pa.bool_())]),
                    pad(sizes, pa.int64()),
                    pad(hits.astype(np.int64), pa.int64()),
                    pad(base, pa.float64()),
                    *(pad(x, pa.float64()) for x in sums),
                ]
                yield pa.RecordBatch.from_arrays(every, names)

    schema = "word binary, row long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double" + "".join(f", s{k} double" for k in range(classes))
    return run, schema


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", folds: int = 10, depth: int = DEPTH, hot: int = HOT, classes: int = CLASSES) -> DataFrame:
    """Return (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Rows whose crc32(doc_id as text) modulo ``folds`` is not 0 train both models (a
    null id counts as an empty text).  A null text has the end token alone; equal
    texts get equal scores; without training rows the base and the trees are uniform.
    Without ``label_col`` there is one tree; a null label counts among the rest.
    Each distinct word is scored once, in the table that the join reads.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == 0).alias("held_out"), label.alias("label"), F.col(text_col).cast("string").alias("text"))
    number, shares = _classes(docs, label_col, classes)
    counted = docs.select(F.when(F.col("held_out"), -1).otherwise(number).cast("int").alias("class"), "text").mapInArrow(_count_words, "class int, word binary, n long")
    by_class = scratch(counted.groupBy("class", "word").agg(F.sum("n").alias("n")), "ctw-class-words")
    broadcast = docs.sparkSession.sparkContext.broadcast
    vocabulary = scratch(_scored_words(by_class, len(shares), depth), "ctw-words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    least = max(1.0, total / hot)
    common = vocabulary.where(F.col("n") >= least).toArrow()
    below = math.log10(total + 0.1 * (distinct + 1))
    hot_scores = np.array(common.column("scores").to_pylist(), np.float32).reshape(-1, len(shares))
    hot_n = common.column("n").to_numpy()
    run, schema = _score(broadcast((common.column("word").to_pylist(), (np.log10(hot_n + 0.1) - below, (hot_n > 0).astype(np.float64)), hot_scores)), len(shares))
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)
    rare = vocabulary.where(F.col("n") < least).withColumnRenamed("n", "count")
    base = F.col("times") * (F.log10(F.col("count") + 0.1) - below)
    ranks = range(len(shares))
    sums = rows.join(rare, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("count") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", base)).alias("base_score"),
        *(F.sum(F.coalesce(f"s{k}", F.col("times") * F.get("scores", F.lit(k)))).alias(f"s{k}") for k in ranks),
    )
    each = [F.col(f"s{k}") + shares[k] for k in ranks]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    mixture = best + F.log10(sum(F.pow(F.lit(10.0), x - best) for x in each))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", mixture.alias("score"))


def op8_ctw(spark, sf_dir):
    return score(load(spark, sf_dir, "documents"))


QUERIES = {"op8_ctw": op8_ctw}
ORACLES: dict[str, str] = {}
