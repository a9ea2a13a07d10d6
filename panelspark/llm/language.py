"""Operator 2: language identification of mixed-language text.

The script of a word narrows its candidate languages, n-gram statistics score the
word in each, and a Viterbi search with a penalty for each switch labels spans of
words.  Counts of hashed n-grams are gathered from a bounded sample of labelled
rows per language, so the model has a fixed size for each language.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, load, slices, text_batches
from .words import gram_buckets, joined

BITS, ORDERS = 16, (1, 2, 3, 4)
#: Bound of the training sample: about so many labelled rows per language.
TRAIN_ROWS = 2_000
#: Labels learned at the most, those with most rows: a model of 512 is 270 MB.
MOST_LANGS = 512
SWITCH, UNLIKELY, SMOOTHING = 18.0, -30.0, 0.5
#: Word types kept by a worker, and bytes of text handled at a time.
CACHED, CHUNK_BYTES = 200_000, 2_000_000

#: First and last code point of scripts' main ranges.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
NAMES = list(SCRIPTS)

#: ASCII but for letters becomes a space.
_SPACED = bytes(i if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256))


def letter_words(text: str) -> list[bytes]:
    """Lower-cased runs between white space, ASCII digits and ASCII signs."""
    return text.lower().encode().translate(_SPACED).split()


def script(word: bytes) -> int:
    """Number of the first letter's script; -1 for another script, -2 without a letter."""
    for c in word.decode():
        if c.isalpha():
            x = ord(c)
            return next((i for i, n in enumerate(NAMES) if any(a <= x <= b for a, b in SCRIPTS[n])), -1)
    return -2


class Model:
    """Log probabilities of n-gram buckets, languages x buckets, and which scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        used = share >= 0.01
        self.allowed = np.where(used | ~used.any(0, keepdims=True), 0.0, UNLIKELY).T.astype(np.float32)  # scripts x languages

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Scores per word and language (relative to the word's best), and each word's script."""
        data, starts = joined(words, b"^", b"$")
        size = np.diff(starts)
        total = np.zeros((len(words), len(self.langs)), np.float32)
        for at in gram_buckets(data, ORDERS, BITS):
            total += np.add.reduceat(self.table[at], starts[:-1], axis=0)
        total *= (1.0 / len(ORDERS)) * np.minimum(1.0, 12.0 / size)[:, None].astype(np.float32)
        kinds = [script(w) for w in words]
        known = [i for i, k in enumerate(kinds) if k >= 0]
        total[known] += self.allowed[[kinds[i] for i in known]]
        return total - total.max(1, keepdims=True), kinds


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each sequence of words x languages; one more word costs ``penalty`` where the label changes."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    longest, n_langs = int(lengths[0]), scores[0].shape[1]
    flat = np.concatenate([scores[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    came = np.empty((len(flat), n_langs), np.int16)
    best = flat[first].astype(np.float64)
    final = np.empty((len(order), n_langs))
    own = np.arange(n_langs, dtype=np.int16)
    active = len(order)
    for t in range(1, longest + 1):
        still = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
        final[still:active] = best[still:active]
        active = still
        if not active:
            break
        at, best = first[:active] + t, best[:active]
        top = best.argmax(1)
        moved = best[np.arange(active), top][:, None] - penalty
        stay = best >= moved
        came[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, moved) + flat[at]
    out: list[np.ndarray] = [np.empty(0)] * len(order)
    state = final.argmax(1)
    labels = np.empty(len(flat), np.int16)
    for t in range(longest - 1, -1, -1):
        active = int(np.searchsorted(-lengths, -t, "left"))
        at = first[:active] + t
        labels[at] = state[:active]
        if t:
            state[:active] = came[at, state[:active]]
    for rank, i in enumerate(order):
        out[i] = labels[first[rank] : first[rank] + lengths[rank]]
    return out


def label(flat: np.ndarray, starts: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Viterbi labels of sequences in one array.

    A sequence keeps its best single language throughout if no stretch of words
    gains more than half the penalty in another: k stretches then gain at most
    k / 2 penalties, and cost at least k - 1 (k, if a word keeps the best language).
    Only the other sequences are searched.
    """
    n = len(starts) - 1
    total = np.add.reduceat(flat, starts[:-1], axis=0)
    top = total.argmax(1)
    sizes = np.diff(starts)
    of = np.repeat(np.arange(n), sizes)
    gain = flat.astype(np.float64) - flat[np.arange(len(flat)), top[of]].astype(np.float64)[:, None]
    sums = np.cumsum(gain, axis=0)
    before = np.vstack([np.zeros((1, flat.shape[1])), sums[:-1]])
    base = before[starts[:-1]][of]
    apart = np.abs(sums).max() * 2 + 1 if len(sums) else 1.0
    lowest = np.minimum.accumulate(before - base - (of * apart)[:, None], axis=0) + (of * apart)[:, None]
    rise = (sums - base - lowest).max(1)
    mixed = np.maximum.reduceat(rise, starts[:-1]) > penalty / 2 - 1e-6
    out = [np.full(sizes[i], top[i], np.int16) for i in range(n)]
    if mixed.any():
        which = np.flatnonzero(mixed)
        for i, found in zip(which, viterbi([flat[starts[i] : starts[i + 1]] for i in which], penalty), strict=True):
            out[i] = found
    return out


class Labeller:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the table; -1 for words without a letter."""
        get = self.number.get
        found = [get(w) for w in words]
        if None in found:
            if len(self.number) > CACHED:
                self.number.clear()
                self.table = self.table[:0]
                found = [None] * len(words)
            new = list({w for w, i in zip(words, found, strict=True) if i is None})
            made, kinds = self.model.scores(new)
            at = len(self.table)
            self.table = np.vstack([self.table, made])
            self.number.update((w, -1 if k == -2 else at + i) for i, (w, k) in enumerate(zip(new, kinds, strict=True)))
            get = self.number.__getitem__
            found = [get(w) for w in words]
        return np.array(found, np.int64)

    def __call__(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """(language, share of the words in it, spans) of each text."""
        words = [letter_words(t) for t in texts]
        numbers = self._numbers([w for ws in words for w in ws])
        sizes, lo, kept = [len(w) for w in words], 0, []
        for n in sizes:
            own = numbers[lo : lo + n]
            kept.append(np.flatnonzero(own >= 0))
            lo += n
        out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
        which = [i for i, k in enumerate(kept) if len(k)]
        if not which:
            return out
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.table[np.concatenate([numbers[offsets[i] + kept[i]] for i in which])]
        starts = np.concatenate([[0], np.cumsum([len(kept[i]) for i in which])])
        langs = self.model.langs
        for i, labels in zip(which, label(flat, starts, self.penalty), strict=True):
            counts = np.bincount(labels, minlength=len(langs))
            top = int(counts.argmax())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
            spans = [{"start": int(a), "end": int(b), "lang": langs[labels[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out[i] = (langs[top], float(counts[top] / len(labels)), spans)
        return out


def _count(batches):
    """(lang, text) to (lang, kind, at, n): n-gram buckets (kind 0) and letters by script (kind 1)."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = letter_words(text)
            if not words:
                continue
            grams, scripts = tables.setdefault(lang, (np.zeros(1 << BITS), np.zeros(len(NAMES))))
            for at in gram_buckets(joined(words, b"^", b"$")[0], ORDERS, BITS):
                np.add.at(grams, at, 1)
            for w, n in Counter(words).items():
                if (k := script(w)) >= 0:
                    scripts[k] += n
    for lang, both in tables.items():
        for kind, table in enumerate(both):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(table[at], pa.float64())], ["lang", "kind", "at", "n"])


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-gram counts, script counts) from about ``train_rows`` rows of each language, chosen by a hash of id and text.

    Rows without a language or a text are left out, and so are labels beyond the
    ``most_langs`` with most rows (ties by name).  What reaches the driver is bounded
    by the number of languages times the number of buckets.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("key")
    rows = text_batches(rows).select(key, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    share = {r.lang: min(1.0, train_rows / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(share)
    counts, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(NAMES)))
    if not langs:
        return langs, counts, scripts
    limit = F.from_json(F.lit(json.dumps(share)), "map<string,double>")
    sample = rows.where(F.pmod("key", F.lit(1_000_000)) < limit[F.col("lang")] * 1_000_000)
    found = sample.select("lang", "text").mapInArrow(lean(_count), "lang string, kind int, at int, n double").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    row = {x: i for i, x in enumerate(langs)}
    at_lang = np.array([row[x] for x in found.column("lang").to_pylist()], np.int64)
    kind, at, n = (found.column(c).to_numpy() for c in ("kind", "at", "n"))
    counts[at_lang[kind == 0], at[kind == 0]] = n[kind == 0]
    scripts[at_lang[kind == 1], at[kind == 1]] = n[kind == 1]
    return langs, counts, scripts


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _identify(shared, penalty: float):
    def run(batches):
        labeller = Labeller(Model(*shared.value), penalty)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            out: list[tuple] = []
            for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
                out += labeller(texts[lo:hi]) if labeller.model.langs else [("und", 0.0, [])] * (hi - lo)
            langs, scores, spans = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], [*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[Column], schema: str, *, text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Return the columns ``keep`` (named and typed by ``schema``) and lang_pred, score, spans of each row.

    Spans count words that have a letter; lang_pred labels most of them and score
    is its share.  A null text, one without a letter, and any text under a model
    without languages get ``und``, 0 and no spans.  Equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = f"{schema}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return text_batches(docs).select(*keep, F.col(text_col).cast("string").alias("text_to_label")).mapInArrow(lean(_identify(shared, penalty)), out)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op2_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return identify(docs, model, [F.col("doc_id").cast("long"), remainder("doc_id", 5) == 0], "doc_id long, held_out boolean").drop("spans")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
