"""Operator 9: pack tokenized documents into fixed windows, best fit decreasing.

Texts are tokenized once, documents longer than a window are first cut into full
windows, and what is left over is placed by best fit decreasing: a segment tree
over remaining capacities finds the tightest open window.  Groups of a bounded
number of documents are packed independently, so no task grows with the input;
only piece descriptions (never token ids, unless asked for) are shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, load, row_keys, slices, text_batches, worker_state

WINDOW, END_ID, GROUP_DOCS = 2048, 1, 8192
#: Pre-tokens that a generation of a worker's cache holds before the next one begins (some 200 bytes each), the
#: longest that is kept, and characters cut at a time.
CACHED, CACHED_CHARS, CHUNK_CHARS = 200_000, 48, 500_000
#: Pre-tokens that the tokenizer is given at a time: its own form of an encoding is large.
ENCODED = 2_000

# The vocabulary's pre-tokenizer pattern for Latin-1 texts, classes written out; words and numbers,
# which don't begin like the rest, first.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r\xa0"
_PIECES = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_UNSURE = re.compile("[\x1c-\x1f\x85]").search
_INNER = re.compile(r"(?<=\S) (?=\S)").split
_WORD = re.compile(r" ?\S+").fullmatch


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Byte-level BPE with a cache of pre-tokens, which are encoded independently of each other.

    A text beyond Latin-1, where classes of characters depend on a Unicode version, is
    only cut at spaces between two characters that aren't white space; the
    tokenizer always cuts there too.  A text that holds the literal of a special token
    goes to the tokenizer as it is, which gives that token's id.  New pre-tokens without white space
    but one space before the rest go to it as lines of one text: it always cuts around their ends.  The cache is of two
    generations: what the older one alone knows is forgotten when the newer is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            sure = not _UNSURE(text)
        except UnicodeEncodeError:
            sure = False
        if sure:
            return _PIECES(text)
        first, *rest = _INNER(text)
        return [first, *(" " + x for x in rest)]

    def _encoded(self, units: list[str]) -> list[bytes]:
        """Each pre-token's ids."""
        if len(self.line_end) == 1 and all(map(_WORD, units)):
            data = np.array(self.tokenizer.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(data == self.line_end[0])).tolist()
            raw = data.tobytes()
            return [raw[i:j] for i, j in zip([0, *(i + 4 for i in ends)], [*ends, len(raw)], strict=True)]
        words = list(filter(_WORD, units)) if len(self.line_end) == 1 else []
        known = dict(zip(words, self._encoded(words), strict=True)) if words else {}
        return [known[x] if x in known else _packed(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in units]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for lo, hi in slices([len(t) for t in texts], CHUNK_CHARS):
            whole = [any(x in t for x in self.literals) for t in texts[lo:hi]]
            parts = [[] if w else self._cut(t) for t, w in zip(texts[lo:hi], whole, strict=True)]
            if len(self.known) > CACHED:
                self.old, self.known = self.known, {}
            known, old = self.known, self.old
            missing = set().union(*parts).difference(known)
            again = [x for x in missing if x in old]
            known.update(zip(again, map(old.__getitem__, again), strict=True))
            new = list(missing.difference(again))
            for at in range(0, len(new), ENCODED):
                own = new[at : at + ENCODED]
                known.update(zip(own, self._encoded(own), strict=True))
            for text, own, w in zip(texts[lo:hi], parts, whole, strict=True):
                out.append(_packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if w else b"".join(map(known.__getitem__, own)))
            for x in new:
                if len(x) > CACHED_CHARS:
                    del known[x]
        return out


def _pieces(path: str, window: int, end_id: int, keep_ids: bool):
    """Batches of (doc_id, text) to one row per piece: full windows, then what is left."""
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder, seen = worker_state(f"encoder {path}", lambda: Encoder(path)), 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            keys = row_keys(seen, len(docs)).to_pylist()
            seen += len(docs)
            out: list[tuple] = []
            for key, doc, ids in zip(keys, docs, encoder.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    out.append((key, doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if keep_ids else None))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary()], strict=True)], ["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


class SegmentTree:
    """Numbers of open windows by remaining capacity 0..window; finds the least capacity that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, capacity: int) -> int:
        """The least capacity >= ``capacity`` with an open window, or -1."""
        count, i = self.count, self.size + capacity
        if count[i]:
            return capacity
        while i > 1:  # up to the first right sibling that holds a window
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece: longest first, ties in the order given."""
    tree, open_by = SegmentTree(window), [[] for _ in range(window + 1)]
    used, out = [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.least(n) if n < window else -1
        if room < 0:
            at, room = len(used), window
            used.append(0)
        else:
            at = open_by[room].pop()
            tree.add(room, -1)
        out[i] = (at, used[at])
        used[at] += n
        if room > n:
            open_by[room - n].append(at)
            tree.add(room - n, 1)
    return out


def _place(groups: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("start", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), window)
        group = table.column("grp")[0].as_py()
        table = table.drop_columns(["grp", "key"])
        table = table.append_column("sequence_id", pa.array([at * groups + group for at, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS, keep_ids: bool = False) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as little-endian bytes with ``keep_ids``).

    A document is its ids plus ``end_id``; a null or empty text has that id alone, and the
    literal of a special token in a text is that token.
    Repeated rows and equal or null doc_ids are packed as separate documents.
    sequence_ids are unique but may have gaps; an empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    schema = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = text_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(_pieces(tokenizer_path, window, end_id, keep_ids), f"encoder {tokenizer_path}"), schema)
    if not keep_ids:
        pieces = pieces.drop("ids")
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return pieces.groupBy("grp").applyInArrow(_place(groups, window), out)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
