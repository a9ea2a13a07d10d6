"""Operator 6: document fingerprints by locally consistent parsing.

Symbols (bytes at first) are cut into phrases where deterministic coin tossing, a
function of a few neighbours alone, puts a local maximum; each phrase gets a name,
and the names are the symbols of the next level.  Equal substrings are therefore
parsed alike away from their ends, wherever they stand, and share phrase names.  A
fingerprint is a bottom-k sketch of a text's phrase names (the k-th occurrence of a name
counts as a name of its own), whose overlap estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, slices, text_batches
from .words import BASE, mixed

SKETCH, LEVELS, FIRST = 48, 5, 1
#: Bytes parsed at a time, and rows that a range of documents holds on average.
CHUNK_BYTES, RANGE_ROWS = 1_000_000, 8_000
MOST_RANGES = 20_000


_LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def coin(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """2 * p + bit p of ``right``, p being the lowest bit where the neighbours differ: labels below 128, of 8-bit symbols below 16."""
    apart = left ^ right
    if apart.dtype == np.uint8:
        place = _LOWEST[apart]
        return 2 * place + ((right >> place) & np.uint8(1))
    low = apart & (~apart + np.uint64(1))
    place = np.maximum(np.frexp(low.astype(np.float64))[1] - 1, 0).astype(np.uint64)
    return (2 * place + ((right >> place) & np.uint64(1))).astype(np.uint8)


def _left(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(symbols)
    out[1:] = symbols[:-1]
    out[first] = 0
    return out


def boundaries(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each sequence's start (``first``) and at local maxima of the labels of three rounds of coin tossing.

    Symbols equal to their left neighbour have no coin; runs of them are cut every
    eight symbols from the run's start on.
    """
    n = len(symbols)
    same = np.zeros(n, bool)
    same[1:] = symbols[1:] == symbols[:-1]
    same[first] = False
    label = symbols
    for _ in range(3):
        label = coin(_left(label, first), label)
    tag = label.astype(np.int8)
    tag[same] = -1
    start = np.zeros(n, bool)
    start[1:-1] = (tag[1:-1] > tag[:-2]) & (tag[1:-1] >= tag[2:])
    start[first[1:] - 1] = False  # a sequence's last symbol has no right neighbour
    runs = np.flatnonzero(same)
    if len(runs):
        opens = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])) - 1
        step = runs - opens[np.searchsorted(opens, runs, "left") - 1]
        start[runs[step % 8 == 0]] = True
    start[first] = True
    return start


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            made = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                column = np.full(size, base, np.uint64)
                column[0] = 1
                made.append(np.cumprod(column, dtype=np.uint64))
        _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


def names(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name for each phrase: a polynomial of its symbols, scrambled with its length."""
    power, inverse = _tables(len(symbols))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[: len(symbols)], dtype=np.uint64)])
        end = np.append(begin[1:], len(symbols))
        value = (sums[end] - sums[begin]) * inverse[begin]
        return mixed(value + (end - begin).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def counted(found: np.ndarray) -> np.ndarray:
    """Distinct names for a multiset: sorted, the second and later occurrences of a name renamed by their number."""
    found = np.sort(found)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    if new.all():
        return found
    place = np.arange(len(found))
    again = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.sort(np.where(new, found, mixed(found + again * np.uint64(0xD6E8FEB86659FD93))))


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted phrase names of each text, with multiplicity, at levels FIRST..LEVELS, and of the whole text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return [np.zeros(0, np.uint64) for _ in texts]
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    for i, name in zip(filled, names(symbols, whole[filled]), strict=True):
        out[i].append(name[None])
    first = whole[filled]
    for level in range(1, LEVELS + 1):
        begin = np.flatnonzero(boundaries(symbols, first))
        symbols = names(symbols, begin)
        first = np.searchsorted(begin, first)
        if level >= FIRST:
            for i, own in zip(filled, np.split(mixed(symbols + np.uint64(level)), first[1:]), strict=True):
                out[i].append(own)
    return [counted(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def sketches(texts: list[bytes]) -> list[bytes]:
    """Bottom-k sketches: the top 32 bits of the SKETCH smallest names, ascending, big-endian; empty for an empty text."""
    out: list[bytes] = []
    for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
        out += [np.unique(x[:SKETCH] >> np.uint64(32)).astype(">u4").tobytes() for x in signatures(texts[lo:hi])]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: the part of the bottom SKETCH of both sketches' union that both hold (of the whole union, if neither is full, when it is exact).  Equal sketches are alike."""
    if a == b:
        return 1.0
    x, y = (set(np.frombuffer(s, ">u4").tolist()) for s in (a, b))
    if not x or not y:
        return 0.0
    lowest = sorted(x | y)[: SKETCH if max(len(x), len(y)) >= SKETCH else None]
    return sum(s in x and s in y for s in lowest) / len(lowest)


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, n_chars, fingerprint), one row per row of ``docs``: whole texts, null as empty, without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x.hex() for x in sketches([t.encode() for t in texts])], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return text_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_RANGED = [("part", pa.int32()), ("extra", pa.bool_()), ("place", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary()), ("sketch", pa.binary())]
_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def cuts_of(quantiles: list[int]) -> list[tuple[int, int]]:
    """Where ranges begin, as (place, hash): a place that is several quantiles is cut evenly by hash."""
    return sorted((v, -(2**63) + j * (2**64 // k)) for v, k in Counter(quantiles).items() for j in range(k))


def parts_of(place: np.ndarray, hashes: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The range of each (place, hash): how many cuts are at or before it."""
    at = np.array([p for p, _ in cuts], np.int64)
    low, part = np.searchsorted(at, place, "left"), np.searchsorted(at, place, "right")
    for i in np.flatnonzero(low < part):
        part[i] = bisect_right(cuts, (int(place[i]), int(hashes[i])), int(low[i]), int(part[i]))
    return part


def _heads(cuts: list[tuple[int, int]]):
    """(place, hash) to (range, least place, least hash there), per batch."""

    def run(batches):
        for batch in batches:
            place, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((hashes, place))
            part = parts_of(place[order], hashes[order], cuts)
            _, first = np.unique(part, return_index=True)
            yield _batch([(int(part[i]), int(place[order[i]]), int(hashes[order[i]])) for i in first], [("part", pa.int32()), ("place", pa.int64()), ("hash", pa.int64())])

    return run


def _slots(spark, n: int) -> list[int]:
    """For each of n ranges a number of its own that Spark's hash deals to the partition of that number, so that no two ranges share one."""
    number = F.col("id").cast("int")
    found = dict(spark.range(32 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("to")).agg(F.min(number).alias("number")).collect())
    spare = iter(range(32 * n, 33 * n))
    return [found[i] if i in found else next(spare) for i in range(n)]


def _spread(cuts: list[tuple[int, int]], heads: dict[tuple[int, int], int], slots: list[int]):
    """(place, hash, doc_id, text) to ranged rows with compressed texts.  A document that begins a range also goes to the range before, as its extra row (once per task)."""

    def run(batches):
        squeeze, given = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            place, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t or b"" for t in batch.column(3).cast(pa.binary()).to_pylist()]
            out = []
            for part, at, key, doc, text, sketch in zip(parts_of(place, hashes, cuts).tolist(), place.tolist(), hashes.tolist(), batch.column(2).to_pylist(), texts, sketches(texts), strict=True):
                row = (at, key, doc, squeeze(text), sketch)
                out.append((slots[part], False, *row))
                if (at, key) in heads and (at, key) not in given:
                    given.add((at, key))
                    out.append((slots[heads[at, key]], True, *row))
            yield _batch(out, _RANGED)

    return run


def _edit(batches):
    """Rows sorted within their ranges to results: the row after a document, in its range, gives what replaces its end."""
    open_ = zstandard.ZstdDecompressor().decompress
    waiting: tuple | None = None
    for batch in batches:
        rows = []
        for part, extra, _, _, doc, packed, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = open_(packed).decode()
            if waiting and waiting[0] == part:
                own = waiting[2]
                k = len(own) // 4
                rows.append((*waiting[1:], own[: len(own) - k] + text[:k], sketch))
            waiting = None if extra else (part, doc, text, sketch)
        edited = [r[3].encode() for r in rows]
        out = []
        for (doc, text, sketch, _, after), changed, edit in zip(rows, sketches(edited), edited, strict=True):
            out.append((doc, len(text), hashlib.sha256(edit).hexdigest(), sketch.hex(), changed.hex(), likeness(sketch, changed), likeness(sketch, after)))
        yield _batch(out, _OUT)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each document and of its edited text: its last quarter replaced by the head of the next document.

    Documents go by ascending id, null ids first, rows of one id by a hash of the
    text; after the last comes the first.  A null text is empty; an empty text or
    one of under four characters is not changed.  An empty table gives no rows.
    Rows are dealt to ranges of ids (cut at approximate quantiles, the only thing the
    driver gathers; an id with many rows is cut by the texts' hashes), one range a
    partition, sorted there and read in one pass.  Beyond MOST_RANGES, ranges grow.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    docs = text_batches(docs).select(place.alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ranges = min(MOST_RANGES, docs.count() // range_rows + 1)
    cuts = cuts_of(docs.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]) if ranges > 1 else []
    found = docs.select("place", "hash").mapInArrow(_heads(cuts), "part int, place long, hash long").groupBy("part").agg(F.min(F.struct("place", "hash")).alias("head")).orderBy("part").collect()
    heads = {tuple(r.head): found[i - 1].part for i, r in enumerate(found)}
    slots = _slots(spark, len(cuts) + 1)
    ranged = docs.mapInArrow(_spread(cuts, heads, slots), "part int, extra boolean, place long, hash long, doc_id long, packed binary, sketch binary")
    ordered = ranged.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "extra", "place", "hash")
    return ordered.mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark, sf_dir):
    return edited_fingerprints(load(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprint": op6_fingerprint}
ORACLES: dict[str, str] = {}
