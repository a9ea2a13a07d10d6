"""Operator 4: exact n-gram Jaccard join of whole texts by vertical partitioning, reduced to components.

Texts with equal shingle sets form a class.  All shingles have one global order:
frequent ones last, by frequency, the others by hash.  Two sets similar enough to
link share a shingle among the first few of each in that order, so those prefixes
are indexed.  The order is cut into fragments; a candidate pair's overlap is counted
in each fragment separately and summed, after the smaller of each pair of counts in
fixed hash cells, summed, has shown that enough overlap is possible at all.

A list of classes that share a shingle is not expanded into pairs: its members are
compared with a few hubs first.  Members that turn out connected need no comparison
with each other, so only pairs across components remain, and those are compared in
full at the end: no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, forget_worker_state, lean, load, scratch, slices, text_batches, tidy
from .components import components
from .fingerprint import _tables
from .words import mixed

SHINGLE = 5
#: Link where LINK_A * intersection >= LINK_B * union.
LINK_A, LINK_B = 100, 80
CHUNK_BYTES = 2_000_000
#: A shingle is frequent if that many classes among the documents that a worker counts at a time have it; at most MOST_FREQUENT of them are put last.
LEAST_FREQUENT, MOST_FREQUENT = 2, 1 << 20
#: Shingles counted at a time by a worker.
COUNTED = 4_000_000
#: Bits of the filter that says which classes' sets are needed; CELLS counts bound overlaps from above.
FILTER_BITS, CELLS = 25, 256
#: Hubs of each list in the first round and in later ones; the most rounds before pairs
#: across components are expanded, and how many pairs a row may cost for that to come sooner.
FIRST_HUBS, LATER_HUBS, HUB_ROUNDS, EXPAND = 2, 8, 2, 8
#: Shingles before a list's that tell whether a pair has met before.
LOOK_BACK = 6
#: Columns that hold one bit for each value of the hash's low ten bits: whether the set has such shingles; looked at in lists of more than LONG members.
BITS, LONG = [f"bits{i}" for i in range(16)], 32
#: Number of frequent shingles' first order key; all others' are below.
_LAST = 1 << 62

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 62-bit hashes of each text's runs of n words (of all its words, if it has fewer; none without words)."""
    out: list[np.ndarray] = []
    for lo, hi in slices([len(t) for t in texts], CHUNK_BYTES):
        out += _sets([t.lower() for t in texts[lo:hi]], n)
    return out


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    words_to = np.searchsorted(begin, ends)  # words up to each text's end
    power, inverse = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        word = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        runs = word.copy()
        for k in range(1, min(n, len(word))):
            runs[:-k] = runs[:-k] * np.uint64(0x100000001B3) + word[k:]
        runs = mixed(runs) >> np.uint64(2)
        out, at = [], 0
        for to in words_to.tolist():
            if to - at >= n:
                out.append(np.unique(runs[at : to - n + 1]))
            elif to > at:
                short = np.zeros(1, np.uint64)
                for x in word[at:to]:
                    short = short * np.uint64(0x100000001B3) + x
                out.append(mixed(short + np.uint64(to - at)) >> np.uint64(2))
            else:
                out.append(np.zeros(0, np.uint64))
            at = to
    return out


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set and its size."""
    with np.errstate(over="ignore"):
        total = mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * np.uint64(0x9FB21C651E98DF25)], np.uint64))
    return int(total.astype(np.int64)[0])


def prefix(n: int) -> int:
    """How many first shingles of a set of n must be indexed: n - ceil(0.8 n) + 1."""
    return n - -(-n * LINK_B // LINK_A) + 1


_FIRST = [("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), *((b, pa.int64()) for b in BITS), ("shingle", pa.int64()), ("times", pa.int64())]


def cells_of(shingles: np.ndarray) -> bytes:
    """A set's counts in cells of the hash's low bits; 255 stands for any larger count."""
    return np.minimum(np.bincount((shingles & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def bits_of(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's row of len(BITS) signed 64-bit numbers."""
    size = 64 * len(BITS)
    marks = np.zeros(len(sets) * size, bool)
    for i, s in enumerate(sets):
        marks[i * size + (s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks.reshape(len(sets), size), axis=1).view(np.int64)


def _classify(n: int):
    """(doc_id, text) to a row (doc_id, cls, n, cells, bits) per text, and rows (shingle, times) for shingles frequent here."""

    def run(batches):
        forget_worker_state()
        held: dict[int, np.ndarray] = {}
        size = 0

        def frequent():
            values, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
            keep = times >= LEAST_FREQUENT
            m = int(keep.sum())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(m, t) for _, t in _FIRST[:-2]] + [pa.array(values[keep].astype(np.int64)), pa.array(times[keep].astype(np.int64))], [x for x, _ in _FIRST])

        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(1)), n)
            owners, m = [class_of(s) for s in sets], len(sets)
            cells = [cells_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(owners, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cells, pa.binary()), *(pa.array(np.ascontiguousarray(b)) for b in bits_of(sets).T), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], [x for x, _ in _FIRST])
            for own, s in zip(owners, sets, strict=True):
                if own not in held:
                    held[own] = s
                    size += len(s)
                if size > COUNTED:
                    yield frequent()
                    size = 0
        if held:
            yield frequent()

    return run


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, ranks): the most frequent shingles, MOST_FREQUENT at the most, ranked by ascending frequency."""
    counts = scratch(counted.groupBy("shingle").agg(F.sum("times").alias("times")), "jaccard-frequent")
    least, total = 1, 0
    for r in counts.groupBy("times").agg(F.count("*").alias("k")).orderBy(F.desc("times")).collect():
        total += r.k
        if total > MOST_FREQUENT:
            least = r.times + 1
            break
    common = counts.where(F.col("times") >= least).toArrow()
    hashes, times = common.column("shingle").to_numpy().astype(np.uint64), common.column("times").to_numpy()
    ranks = np.empty(len(hashes), np.uint64)
    ranks[np.lexsort((hashes, times))] = np.arange(len(hashes), dtype=np.uint64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash], ranks[by_hash]


def order_keys(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places in the global order, ascending: hashes, then 2**62 plus the rank of frequent shingles (``frequent``: hashes ascending, ranks)."""
    hashes, ranks = frequent
    if not len(hashes) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    return np.sort(np.where(hashes[at] == shingles, np.uint64(_LAST) + ranks[at], shingles))


def _index(shared, n: int):
    """(text) to (shingle, cls, pos, n) for the prefix of each class, once per task; pos is the place in the whole set's order, n its size."""

    def run(batches):
        frequent, seen = shared.value, set()
        for batch in batches:
            keys, owners, counts, sizes = [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(0)), n):
                own = class_of(s)
                if len(s) and own not in seen:
                    seen.add(own)
                    first = order_keys(s, frequent)[: prefix(len(s))]
                    keys.append(first)
                    owners.append(own)
                    counts.append(len(first))
                    sizes.append(len(s))
            flat = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
            places = np.concatenate([np.arange(c, dtype=np.int32) for c in counts]) if counts else np.zeros(0, np.int32)
            repeat = lambda x, kind: pa.array(np.repeat(np.array(x, kind), counts))
            yield pa.RecordBatch.from_arrays([pa.array(flat), repeat(owners, np.int64), pa.array(places), repeat(sizes, np.int32)], ["shingle", "cls", "pos", "n"])

    return run


def _filter_places(cls: int | np.ndarray, bits: int):
    mask = (1 << bits) - 1
    return cls & mask, (cls >> 32) & mask


def _sets_of(shared, n: int):
    """(text) to (cls, fragment, part) for classes in the filter: the set's order keys, fragment by fragment."""

    def run(batches):
        frequent, words = shared.value
        seen = set()
        for batch in batches:
            rows: list[tuple] = []
            for s in shingle_sets(as_bytes(batch.column(0)), n):
                own = class_of(s)
                if not len(s) or own in seen or not all(int(words[p >> 6]) >> (p & 63) & 1 for p in _filter_places(own & (2**64 - 1), FILTER_BITS)):
                    continue
                seen.add(own)
                keys = order_keys(s, frequent)
                cuts = np.searchsorted(keys, np.arange(1, 5, dtype=np.uint64) << np.uint64(60))
                for fragment, part in enumerate(np.split(keys, cuts)):
                    if len(part):
                        rows.append((own, fragment, part.astype("<u8").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["cls", "fragment", "part"])

    return run


def _possible(batches):
    """Pairs whose overlap can be large enough, by the sum of the smaller counts in each cell (a count of 255 stands for any larger one)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, CELLS) for x in ("cells_a", "cells_b"))
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        most = np.where(((a == 255) & (b == 255)).any(1), np.minimum(na, nb), np.minimum(a, b).sum(1, dtype=np.int64))
        keep = pa.array((LINK_A + LINK_B) * most >= LINK_B * (na + nb))
        yield batch.select(["a", "b", "na", "nb"]).filter(keep)


def _overlap(batches):
    for batch in batches:
        parts = zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist(), strict=True)
        common = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose cells leave room for enough overlap."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("cells").alias(f"cells_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_possible), "a long, b long, na long, nb long")


def _links(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb) that link: fragments' overlaps are counted separately and summed."""
    left = pairs.join(parts.select(F.col("cls").alias("a"), "fragment", F.col("part").alias("part_a")), "a")
    both = left.join(parts.select(F.col("cls").alias("b"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", "part_a", "part_b").mapInArrow(lean(_overlap), "a long, b long, na long, nb long, common long")
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where((LINK_A + LINK_B) * F.col("common") >= LINK_B * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _filter_words(members: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with two of them set for each class, put together on the executors."""
    mask = (1 << FILTER_BITS) - 1
    place = lambda p: members.select(p.alias("p"))
    places = place(F.col("cls").bitwiseAND(mask)).union(place(F.shiftrightunsigned("cls", 32).bitwiseAND(mask)))
    got = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint64)
    return words


def _lists(docs: DataFrame, frequent, shingle: int) -> DataFrame:
    """(shingle, cls, n, pos): the prefix shingles that at least two classes share."""
    found = docs.select("text").mapInArrow(lean(_index(docs.sparkSession.sparkContext.broadcast(frequent), shingle)), "shingle long, cls long, pos int, n int")
    rare = found.where(F.col("shingle") < _LAST).repartition("shingle")
    shared = rare.selectExpr("*", "min(cls) over (partition by shingle) as low", "max(cls) over (partition by shingle) as high").where("low <> high").select("shingle", "cls", "pos", "n")
    return shared.union(found.where(F.col("shingle") >= _LAST)).distinct().select("shingle", "cls", F.col("n").cast("long").alias("n"), "pos")


def _fits(a: str, b: str):
    return LINK_A * F.least(a, b) >= LINK_B * F.greatest(a, b)


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with their members' components, the component that holds most of a list, and the list's size; lists within one component are left out."""
    if labels is None:
        own = index.withColumn("comp", F.col("cls"))
    else:
        own = index.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    held = own.groupBy("shingle", "comp").agg(F.count("*").alias("k"))
    lists = held.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    return own.join(lists.drop("comps"), "shingle")


def _ordered(near: DataFrame) -> DataFrame:
    """Sides x and y as distinct pairs (a, b, na, nb) with a < b."""
    low = F.col("cls_x") < F.col("cls_y")
    pick = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
    return near.select(pick("cls_x", "cls_y").alias("a"), pick("cls_y", "cls_x").alias("b"), pick("n_x", "n_y").alias("na"), pick("n_y", "n_x").alias("nb")).distinct()


def _room() -> Column:
    """Whether what is left of both sets from a shared shingle on could be enough overlap, if that is the first one shared."""
    return (LINK_A + LINK_B) * F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= LINK_B * (F.col("n_x") + F.col("n_y"))


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "pos", "comp", *more)))


def _hub_pairs(members: DataFrame, hubs_of: DataFrame, hubs: int, turn: int) -> DataFrame:
    """Each member of a list with ``hubs`` hubs of that list, where their components differ and a link is possible as far as the list tells."""
    by = Window.partitionBy("shingle").orderBy(F.xxhash64("cls", F.lit(turn)))
    chosen = hubs_of.withColumn("r", F.row_number().over(by)).where(F.col("r") <= hubs)
    near = _side(members, "x").join(_side(chosen, "y"), "shingle")
    return _ordered(near.where((F.col("comp_x") != F.col("comp_y")) & _fits("n_x", "n_y") & _room()))


def _likely() -> str:
    """Whether enough overlap is left when no shingle counts whose bit is unset in the other set; null without bits."""
    gone = lambda p, q: " + ".join(f"bit_count({b}_{p} & ~{b}_{q})" for b in BITS)
    return f"{LINK_A + LINK_B} * least(n_x - ({gone('x', 'y')}), n_y - ({gone('y', 'x')})) >= {LINK_B} * (n_x + n_y)"


def _cross_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of a list's members across components that can link as far as the list and both sets' cells tell.

    One of a pair is outside the list's main component, so members of that are never
    paired with each other, not even to be thrown away.  A pair is left to an earlier
    list if one of the LOOK_BACK shingles before this one is common too; in the first
    list that it shares, what is left of both sets from there on bounds the overlap.
    """
    earlier = F.collect_list("shingle").over(Window.partitionBy("cls").orderBy("shingle").rowsBetween(-LOOK_BACK, -1))
    lists = lists.join(classes.select("cls", *BITS), "cls").withColumn("before", earlier)
    lists = lists.withColumns({b: F.when(F.col("size") > LONG, F.col(b)) for b in BITS})
    both = _side(lists.where("comp <> main"), "x", "before", *BITS).join(_side(lists, "y", "before", "main", *BITS), "shingle")
    once = (F.col("comp_y") == F.col("main_y")) | (F.col("cls_x") < F.col("cls_y"))
    first = ~F.arrays_overlap("before_x", "before_y")
    return _ordered(both.where((F.col("comp_x") != F.col("comp_y")) & once & _fits("n_x", "n_y") & _room() & F.coalesce(F.expr(_likely()), F.lit(True)) & first))


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Return (doc_id, n_shingles, component_id), one row per row of ``docs``.

    component_id is the least doc_id among all rows reachable by links, the row
    itself included (null only where none of them has a doc_id).  A text without
    words, or a null text, has an empty set and links with nothing: its
    component_id is its doc_id.  Rows with equal sets are linked; a repeated doc_id
    is no link.  Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = "".join(f", {b} long" for b in BITS)
    first = scratch(docs.mapInArrow(lean(_classify(shingle)), f"doc_id long, cls long, n long, cells binary{bits}, shingle long, times long"), "jaccard-classes")
    rows = first.where("n is not null")
    frequent = _frequent(first.where("shingle is not null"))
    classes = scratch(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "cells", *BITS))), "jaccard-sizes")
    index = scratch(_lists(docs, frequent, shingle), "jaccard-index")
    tidy(spark)

    links = labels = parts = fetched = None
    for turn in range(HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS
        if turn or last:
            lists = scratch(_labelled(index, labels), "jaccard-open")
            members, costs = lists.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("comp") != F.col("main"), F.col("size"))), F.lit(0))).first()
            if not costs:
                break
            last = last or costs <= EXPAND * members + 100_000
            near = _cross_pairs(lists, classes) if last else _hub_pairs(lists.where("comp <> main"), lists.where("comp = main"), LATER_HUBS, turn)
        else:
            lists = index.withColumn("comp", F.col("cls"))
            near = _hub_pairs(lists, lists, FIRST_HUBS, turn)
        pairs = scratch(_candidates(near, classes), "jaccard-pairs")
        if turn or last:
            discard(lists)
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        needed = scratch(needed if fetched is None else needed.join(fetched, "cls", "left_anti"), "jaccard-needed")
        if not needed.isEmpty():
            own = docs.select("text").mapInArrow(lean(_sets_of(spark.sparkContext.broadcast((frequent, _filter_words(needed))), shingle)), "cls long, fragment int, part binary")
            own = scratch(own.join(needed, "cls", "left_semi").dropDuplicates(["cls", "fragment"]), "jaccard-sets")
            parts = own if parts is None else parts.union(own)
            fetched = needed if fetched is None else fetched.union(needed)
        new = scratch(_links(pairs, parts), "jaccard-links") if parts is not None else pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = new if links is None else links.union(new)
        labels = components(links)
        tidy(spark)
        if last:
            break

    if labels is None:
        named = classes.select("cls", F.col("least").alias("component_id"))
    else:
        in_component = labels.join(classes, F.col("node") == F.col("cls"))
        least = in_component.groupBy("component").agg(F.min("least").alias("component_least"))
        of = in_component.join(least, "component").select(F.col("node").alias("linked"), "component_least")
        named = classes.join(of, F.col("cls") == F.col("linked"), "left").select("cls", F.coalesce("component_least", "least").alias("component_id"))
    filled = rows.where("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op4_jaccard(spark, sf_dir):
    return link_components(load(spark, sf_dir, "documents"))


#: The same by joins of all windows or shingles, for small tables.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_n >= 80 * (nx.n + ny.n - both_n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES = {"op4_jaccard": SQL}
