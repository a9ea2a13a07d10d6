"""Operator 7: quality classifier by the perplexity of an interpolated modified Kneser-Ney model.

The model predicts each byte of a text, its words between single spaces, from up to
DEPTH bytes before it, which run over word boundaries.  It is trained on trusted text: documents labelled
good and not toxic, every one of them but the share kept out for the thresholds.
Counts, continuation counts, discounts and interpolated
probabilities of each order are tables sharded by context and joined with each
other and with the order below.  The finished table has a row for each distinct run of
DEPTH + 1 bytes and its ends, not for each text, and is broadcast to score whole documents.  A document is rejected if
its perplexity per byte is beyond a threshold that its language's rows of quality 1
kept out of training give: the median plus a quantile of the excess, both exact.  A mean over few
words scatters more, so the excess is taken times the square root of their number.
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, load, scratch, slices, text_batches
from .ctw import COUNTED, Tree, _coded, _contexts, _count_grams

DEPTH = 4
#: One in so many of a language's trusted rows is kept out of training, for its threshold; all others train.
KEPT_OUT = 4
#: Share of a language's rows of quality 1 kept out, toxic or not, that its threshold keeps.
QUANTILE = 0.99
#: Languages with fewer rows kept out share the threshold of all.
LEAST_ROWS = 30
CACHED, CHUNK_BYTES = 200_000, 500_000
#: Distinct runs of bytes that a worker counts at a time.
COUNTED_RUNS = 1_000_000
#: Share of the rows on either side of an approximate quantile among which the exact one is looked for first.
AROUND = 0.0005


def _count_words(batches):
    counts: Counter[bytes] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(counts), np.int32)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["class", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            counts.update(text.split())
            if len(counts) > COUNTED:
                yield flush()
    yield flush()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(first) else np.zeros(0, np.int64)


def _count_texts(depth: int):
    """Texts, one token each, with single spaces between their words, to (depth, context, byte, n) at the deepest context each byte has; texts without words go."""
    low = np.uint64(255)

    def run(batches):
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth + 1)]
        size = merged = 0

        def merge() -> int:
            for own in kept:
                if len(own) > 1:
                    own[:] = [_summed(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))]
            return sum(len(k) for own in kept for k, _ in own)

        def flush():
            for d, own in enumerate(kept):
                for keys, n in own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, np.int32)), pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array((keys & low).astype(np.int32)), pa.array(n)], ["depth", "context", "byte", "n"])
                own.clear()

        for batch in batches:
            texts = [t for t in (b" ".join(t.split()) for t in as_bytes(batch.column(0))) if t]
            for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
                data, offset, _ = _coded(texts[lo:hi])
                context = _contexts(data, depth)
                for d in range(1, depth + 1):
                    at = np.flatnonzero(offset == d) if d < depth else offset >= d
                    keys = np.sort((context[at] & np.uint64(_mask(d))) << np.uint64(8) | data[at])
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                    kept[d].append((keys[first], np.diff(np.append(first, len(keys)))))
                    size += len(first)
                if size > 2 * merged + COUNTED_RUNS:
                    size = merged = merge()
                    if size > COUNTED_RUNS:
                        yield from flush()
                        size = merged = 0
        merge()
        yield from flush()

    return run


def _discounts(level: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney, from the numbers of rows with counts 1 to 4."""
    n1, n2, n3, n4 = level.agg(*(F.sum(F.when(F.col("c") == k, 1).otherwise(0)) for k in (1, 2, 3, 4))).first()
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), k - 0.1) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * (n3 or 0) / n2), (3, 3 - 4 * y * (n4 or 0) / n3 if n3 else 1.5))]


def _mask(d: int) -> int:
    return (1 << 8 * d) - 1


def train(texts: DataFrame, text_col: str = "text", depth: int = DEPTH, across: bool = False) -> list[tuple]:
    """With ``across``, contexts run over word boundaries; else each word stands alone.

    Returns the levels of a ``Tree``: by order, contexts with the log10 weight of the order below, and (context, byte) with log10 probabilities.
    """
    if across:
        runs = texts.select(text_col).mapInArrow(lean(_count_texts(depth)), "depth int, context long, byte int, n long")
    else:
        words = texts.select(text_col).mapInArrow(_count_words, "class int, word binary, n long").groupBy("class", "word").agg(F.sum("n").alias("n"))
        runs = words.mapInArrow(lean(_count_grams(depth, CHUNK_BYTES)), "class int, depth int, context long, byte int, n long")
    raw = scratch(runs.groupBy("depth", "context", "byte").agg(F.sum("n").alias("c")), "kn-counts")
    levels = [raw.where(F.col("depth") == depth).select("context", "byte", "c")]
    for d in range(depth - 1, -1, -1):  # continuation counts; runs from a word's begin keep their own
        shorter = levels[0].select(F.col("context").bitwiseAND(_mask(d)).alias("context"), "byte").groupBy("context", "byte").agg(F.count("*").alias("c"))
        begin = raw.where(F.col("depth") == d)
        if across:  # these also occur after other bytes: a text's begin is one more place to continue
            level = shorter.union(begin.select("context", "byte", F.lit(1).cast("long"))).groupBy("context", "byte").agg(F.sum("c").alias("c"))
        else:
            level = shorter.union(begin.select("context", "byte", "c"))
        levels.insert(0, scratch(level, "kn-continuations"))
    below, out = None, []
    for d, level in enumerate(levels):
        d1, d2, d3 = _discounts(level)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        once, twice, more = (F.count_if(x) for x in (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2))  # whole numbers: their sums have no order
        stats = level.groupBy("context").agg(F.sum("c").alias("total"), (once * d1 + twice * d2 + more * d3).alias("freed"))
        rows = level.join(stats, "context").withColumn("own", (F.col("c") - discount) / F.col("total")).withColumn("weight", F.col("freed") / F.col("total"))
        if below is None:
            rows = rows.withColumn("p", F.col("own") + F.col("weight") / 256)
        else:
            lower = below.select(F.col("context").alias("shorter"), "byte", F.col("p").alias("lower"))
            rows = rows.withColumn("shorter", F.col("context").bitwiseAND(_mask(d - 1))).join(lower, ["shorter", "byte"]).withColumn("p", F.col("own") + F.col("weight") * F.col("lower"))
        below = scratch(rows.select("context", "byte", "weight", "p"), "kn-probabilities")
        found = below.toArrow()
        context, byte, p = found.column("context").to_numpy().astype(np.uint64), found.column("byte").to_numpy().astype(np.uint64), found.column("p").to_numpy()
        key = context << np.uint64(8) | byte
        by = np.argsort(key)
        contexts, at = np.unique(context, return_index=True)
        weight = np.log10(np.maximum(found.column("weight").to_numpy()[at], 1e-12)) - (math.log10(256) if d == 0 else 0.0)
        out.append((contexts, weight, key[by], np.log10(p[by])))
    return out


class Reader:
    """Scores of whole texts: a word's bytes from the DEPTH-th on depend on the word alone and are kept by word, those before also on the text before it."""

    def __init__(self, levels: list[tuple]):
        self.tree, self.depth = Tree(levels), len(levels) - 1
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.late = np.zeros(0), np.zeros(0)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability, and number of bytes and word ends, of each list of words."""
        sizes = np.array([len(x) for x in texts], np.int64)
        flat = [w for x in texts for w in x]
        if not flat:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        at = self._places(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        of = np.repeat(np.arange(len(texts)), sizes)
        opens = np.concatenate([[True], of[1:] != of[:-1]])
        each = np.where(opens, self.first[at], self.late[at])
        each[~opens] += self._early(flat, lengths, opens)
        return np.bincount(of, each, len(texts)), np.bincount(of, lengths, len(texts))

    def _places(self, flat: list[bytes]) -> np.ndarray:
        found = [self.number.get(w) for w in flat]
        if None in found:
            if len(self.number) > CACHED:
                self._forget()
                found = [None] * len(flat)
            new = list({w for w, i in zip(flat, found, strict=True) if i is None})
            self.number.update(zip(new, range(len(self.first), len(self.first) + len(new)), strict=True))
            data, offset, starts = _coded(new)
            each = self.tree.byte_scores(data, offset, _contexts(data, self.depth))
            self.first = np.concatenate([self.first, np.add.reduceat(each, starts[:-1])])
            self.late = np.concatenate([self.late, np.add.reduceat(np.where(offset >= self.depth, each, 0.0), starts[:-1])])
            found = [self.number[w] for w in flat]
        return np.array(found, np.int64)

    def _early(self, flat: list[bytes], lengths: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """What the first DEPTH - 1 bytes give of each word that isn't its text's first; equal surroundings are scored once."""
        depth, pad = self.depth, 8
        data = np.frombuffer(b" " * pad + b" ".join(flat) + b" " * pad, np.uint8)
        starts = np.cumsum(lengths) - lengths + pad
        begin = np.maximum.accumulate(np.where(opens, starts, 0))
        starts, begin, n = starts[~opens], begin[~opens], lengths[~opens]
        reach = np.minimum(starts - begin + 1, depth)  # with the space that opens the text
        head = np.minimum(n, depth - 1)
        # bytes before the word, its first ones, and both numbers, as a record
        key = np.zeros((len(starts), 16), np.uint8)
        for k in range(1, depth + 1):
            key[:, depth - k] = np.where(reach >= k, data[starts - k], 0)
        for k in range(depth - 1):
            key[:, depth + k] = np.where(head > k, data[starts + k], 0)
        key[:, 14], key[:, 15] = reach, head
        pairs = key.view(np.uint64)
        order = np.lexsort((pairs[:, 0], pairs[:, 1]))
        ranked = pairs[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]) if len(order) else np.zeros(0, bool)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        key = key[order[new]]
        reach, head = key[:, 14].astype(np.int64), key[:, 15].astype(np.int64)
        context, out = np.zeros(len(key), np.uint64), np.zeros(len(key))
        for k in range(depth):
            context = context << np.uint64(8) | key[:, k]
        low = np.uint64((1 << 8 * depth) - 1)
        for k in range(depth - 1):
            own = np.flatnonzero(head > k)
            out[own] += self.tree.byte_scores(key[own, depth + k], np.minimum(reach[own] + k, depth), context[own])
            context = (context << np.uint64(8) | key[:, depth + k]) & low
        return out[back]


def _measure(shared):
    """(..., text) to (..., n_words, log_perplexity): minus the mean natural-log probability of a byte or word end; null without words."""

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            counts, values = [], []
            texts = as_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
                own = [t.split() for t in texts[lo:hi]]
                total, n = reader(own)
                counts += [len(x) for x in own]
                values += [-t * math.log(10) / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(values, pa.float64())], [*batch.schema.names[:-1], "n_words", "log_perplexity"])

    return run


def _shares(counts: dict, total: int) -> dict:
    """Share of each language's rows that train, if a caller bounds them: ``total`` rows in all, dealt evenly; what a rare language leaves goes to the others."""
    out = {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        take = min(n * (1 - 1 / KEPT_OUT), total / (len(counts) - i))
        out[lang], total = take / n, total - take
    return out


def _quantiles(table: DataFrame, value, quantile: float) -> tuple[float | None, dict[str, float]]:
    """The exact quantile (least value that this share of the rows don't exceed) of all rows, and of each language with enough rows.

    Approximate ones give a range of values; what is below is counted, and the few values inside are counted one by one.
    """
    group = F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("every"), F.col("lang"))))
    rows = table.select(value.cast("double").alias("v"), group.alias("g")).select("g.every", "g.lang", "v").where("every or lang is not null")
    found: dict = {}
    around: float | None = AROUND
    while True:
        lo, hi = (quantile, quantile) if around is None else (max(0.0, quantile - around), min(1.0, quantile + around))
        ends = rows.groupBy("every", "lang").agg(F.count("*").alias("k"), F.percentile_approx("v", F.array(F.lit(lo), F.lit(hi))).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
        todo = {(r.every, r.lang): r for r in ends.collect() if (r.every or r.k >= LEAST_ROWS) and (r.every, r.lang) not in found}
        limit = {g: (r.least, r.most) if around is None else tuple(r.ends) for g, r in todo.items()}

        def bound(side: int, limit=limit):
            out = F.lit(None).cast("double")
            for (every, lang), x in limit.items():
                out = F.when(F.col("every") if every else ~F.col("every") & (F.col("lang") == lang), F.lit(float(x[side]))).otherwise(out)
            return out

        near = rows.withColumn("lo", bound(0)).withColumn("hi", bound(1)).where("v <= hi")
        counted: dict = {}
        for r in near.groupBy("every", "lang", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n")).collect():
            counted.setdefault((r.every, r.lang), []).append((-math.inf if r.v is None else r.v, r.n))
        for g, own in counted.items():
            left = max(1, math.ceil(quantile * todo[g].k - 1e-9))
            for v, n in sorted(own):
                left -= n
                if left <= 0:
                    if v > -math.inf:
                        found[g] = v
                    break
        if all(g in found for g in todo):
            return found.get((True, None)), {lang: v for (every, lang), v in found.items() if not every}
        around = None if around is None or around > 0.1 else 10 * around


def _by_lang(table: DataFrame, value, quantile: float):
    """The quantile of each language with enough rows and of all rows, as a column over ``lang``."""
    every, each = _quantiles(table, value, quantile)
    out = F.lit(every).cast("double")
    for lang, at in each.items():
        out = F.when(F.col("lang") == lang, at).otherwise(out)
    return out


def _limits(measured: DataFrame, quantile: float):
    """Threshold as a column over ``lang`` and ``n_words``, from (lang, n_words, log_perplexity) of good rows."""
    words = F.sqrt(F.greatest("n_words", F.lit(1)))
    median = _by_lang(measured, F.col("log_perplexity"), 0.5)
    return median + _by_lang(measured, (F.col("log_perplexity") - median) * words, quantile) / words


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int | None = None, quantile: float = QUANTILE, whole: bool = False) -> DataFrame:
    """Return (doc_id, lang, n_words, log_perplexity, threshold, keep), one row per row of ``docs``.

    With ``whole``, a column ``row`` holds all columns of ``docs``.  Trusted are rows with a label of quality 1 and no toxic 1, and all but one in KEPT_OUT of them
    train (by their doc_id); ``train_rows`` bounds these to about so many, dealt over the languages.  Thresholds also look at toxic
    rows of quality 1.  A text without words
    (null, empty) has no perplexity and is rejected; a null or rare language has the
    threshold of all; without trusted rows nothing else is rejected.  Equal texts of
    one language get equal results.
    """
    spark = docs.sparkSession
    good = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("labelled is not null and quality = 1")
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    own = text_batches(docs).select(*row, F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = F.lit(1 - 1 / KEPT_OUT)
    if train_rows is not None:
        known = own.select("doc_id", "lang").join(good, F.col("doc_id") == F.col("labelled")).where("toxic = 0").groupBy("lang").agg(F.count("*").alias("n"))
        shares = _shares({r.lang: r.n for r in known.collect()}, train_rows)
        share = F.coalesce(F.from_json(F.lit(json.dumps({k: v for k, v in shares.items() if k is not None})), "map<string,double>")[F.col("lang")], F.when(F.col("lang").isNull(), F.lit(float(shares.get(None, 0.0)))), F.lit(0.0))
    trains = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000
    chosen = scratch(good.where("toxic = 0").select("labelled"), "kn-trusted")
    # labels grow with the documents: never a broadcast
    trusted = own.where(trains).join(chosen.hint("merge"), F.col("doc_id") == F.col("labelled")).select("text")
    shared = spark.sparkContext.broadcast(train(trusted, across=True))
    kept = f"row {docs.schema.simpleString()}, " if whole else ""
    scored = scratch(own.mapInArrow(lean(_measure(shared)), kept + "doc_id long, lang string, n_words long, log_perplexity double"), "kn-scored")
    shared.destroy()
    measured = scored.select("doc_id", "lang", "n_words", "log_perplexity").where(F.col("log_perplexity").isNotNull() & ~trains)
    measured = scratch(measured.join(good, F.col("doc_id") == F.col("labelled")).select("lang", "n_words", "log_perplexity"), "kn-measured")
    scored = scored.withColumn("threshold", _limits(measured, quantile))
    return scored.withColumn("keep", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.col("threshold").isNull() & F.col("log_perplexity").isNotNull(), F.lit(False)))


def op7_quality(spark, sf_dir):
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
