"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, grouping.

1. Each text becomes its set of five-word shingles and a SuperMinHash signature. Element e contributes, at step j, the
   value j + r(e, j) to the bin that a permutation of its own puts in place j; a bin keeps its least value. Steps stop
   as soon as no bin can fall any more (every bin is below j), which for long texts is after the first.
2. Rows with equal sets are one class member, so copies are never expanded.
3. Signatures are cut into BANDS bands of ROWS values. Two sets with similarity 0.75 share no band with probability
   (1 - 0.75**4)**32 < 6e-6. Each member of a bucket is verified against the bucket's
   pivot only: the member that meets the most others in all its buckets, then the first.
4. Verified pairs are joined to components. Where a pivot's buckets hold members of several components, the members
   outside the pivot's component are held against all members of its buckets, in blocks of MANY_X by MANY_Y texts: an
   inverted index of a block's shingles gives the exact similarity of each pair, and only links between different
   components leave the task, one for each two of them.
Links are confirmed on the full shingle sets of the texts, never on signatures.

Defined results: a null, empty or white-space text has no shingles, is linked with nothing and is kept; a text of one
to four words is one shingle; a repeated row is in the class of its text; an empty table gives no rows; other columns are
left alone. Rows are told apart by a row number that is written with them, never by doc_id: null doc_ids and texts that
share a doc_id are rows like others. A class is named by its smallest doc_id (null if it has none) and keeps one row, of
the smallest doc_id (a null one last), then of the smallest row number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.bytewise import MASK, U, mix, shingle_set, texts_bounds, texts_words, word_classes
from recurra.llm.components import components
from recurra.llm.storage import aside, forget, written

WORDS, BINS, ROWS, BANDS = 5, 128, 4, 32
LAST = (1 << 63) - 1
#: A link: OVER * |intersection| >= UNDER * |union|.
OVER, UNDER = 100, 75
#: Texts in a block of members outside their pivot's component, and of members they are held against.
MANY_X, MANY_Y = 256, 1024
#: Bytes of pairs of texts whose words are compared together.
PAIR_BYTES = 1 << 20
#: Elements of several texts sketched together.
TOGETHER = 1 << 16


def superminhash(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of `bins` values for each set of distinct 64-bit elements; inf throughout for an empty one."""
    out = np.full((len(sets), bins), np.inf)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    home = np.repeat(np.arange(len(sets)) * bins, sizes)
    places = None
    for j in range(bins):
        state = mix(element + U((j + 1) * 0x9E3779B97F4A7C15 & MASK))
        value = j + (state >> U(11)).astype(np.float64) * 2.0**-53
        pick = j + (mix(state ^ U(0xA0761D6478BD642F)) % U(bins - j)).astype(np.int64)
        if j == 0:
            bin_, first = pick, pick
        else:
            each = np.arange(len(element))
            if places is None:
                places = np.tile(np.arange(bins, dtype=np.uint8 if bins <= 256 else np.uint16), (len(element), 1))
                places[each, first] = 0
                places[each, 0] = first
            bin_ = places[each, pick].astype(np.int64)
            places[each, pick] = places[:, j]
        np.minimum.at(flat, home + bin_, value)
        done = out.max(axis=1) < j + 1
        live = ~done[home // bins]
        if not live.any():
            break
        if live.sum() < 0.7 * len(live) or j == 0:
            element, home, first = element[live], home[live], first[live]
            places = None if places is None else places[live]
    return out


def hashed_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """The shingle hashes of each text, and 128 bits of a cryptographic digest of those and of its distinct words."""
    for _, data, starts, stops, hashes, rows in texts_words(column):
        for a, b in zip(rows[:-1], rows[1:]):
            elements = shingle_set(hashes[a:b], WORDS)
            _, at = np.unique(hashes[a:b], return_index=True)
            n = stops[a:b][at] - starts[a:b][at]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(starts[a:b][at] - first, n)
            sums = blake2b(elements.tobytes(), digest_size=16)
            sums.update(n.tobytes())
            sums.update(data[place].tobytes())
            yield elements, tuple(np.frombuffer(sums.digest(), np.int64).tolist())


def exact_sets(*columns: pa.Array) -> list[np.ndarray]:
    """The shingles of each text as sorted numbers: equal numbers are equal words, compared byte by byte."""
    whole = pa.concat_arrays([c.cast(pa.large_string()) for c in columns])
    out: list[np.ndarray] = []
    for _, data, starts, stops, rows in texts_bounds(whole, most=None):
        first, word = word_classes(data, starts, stops)
        none, n = len(first), np.diff(rows)
        owner = np.repeat(np.arange(len(n)), n)
        ends = rows[owner + 1]
        place = np.arange(len(word))
        number = word.astype(np.int64)
        for k in range(1, WORDS):  # runs of k + 1 words, numbered anew at each step so that the numbers stay small
            following = np.where(place + k < ends, word[np.minimum(place + k, len(word) - 1)], none)
            number = np.unique(number * (none + 1) + following, return_inverse=True)[1].astype(np.int64)
        begins = place < np.maximum(ends - WORDS + 1, rows[owner] + 1)
        number, owner = number[begins], owner[begins]
        cuts = np.searchsorted(owner, np.arange(len(n) + 1))
        out += [np.unique(number[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows, sets, keys):
        signature = superminhash(sets)
        n = np.array([len(s) for s in sets], np.int64)
        keys = np.array(keys, np.int64).reshape(-1, 2)
        bits = np.ascontiguousarray(signature).view(U).reshape(len(sets), BANDS, ROWS)
        band = np.broadcast_to(np.arange(BANDS, dtype=U) * U(0xD1B54A32D192ED03), bits.shape[:2]).copy()
        for r in range(ROWS):
            band = mix(band * U(0x9E3779B97F4A7C15) + bits[:, :, r])
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
        return pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("doc_id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.astype(np.int64).reshape(-1)))],
            ["row", "doc_id", "n_shingles", "k1", "k2", "bands"],
        )

    for batch in batches:
        sets, keys, first, held = [], [], 0, 0
        for s, k in hashed_sets(batch.column("text")):
            sets.append(s)
            keys.append(k)
            held += len(s)
            if held >= TOGETHER:
                yield out(batch.slice(first, len(sets)), sets, keys)
                first, sets, keys, held = first + len(sets), [], [], 0
        if sets:
            yield out(batch.slice(first, len(sets)), sets, keys)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of the full sets of pairs of texts."""
    for batch in batches:
        bytes_ = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb")))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bytes_, (bytes_[at - 1] if at else 0) + PAIR_BYTES, side="right")))
            part = batch.slice(at, to - at)
            sets = exact_sets(part.column("ta"), part.column("tb"))
            n = part.num_rows
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[:n], sets[n:])], np.int64)
            both = np.array([len(x) + len(y) for x, y in zip(sets[:n], sets[n:])], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(same), pa.array(both - same)], ["a", "b", "common", "total"])
            at = to


def _bridges(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between different components in a block: (a, b) are the components."""
    sets = exact_sets(*rows.column("text").chunks)
    outside, home = np.array(rows.column("x")), np.array(rows.column("c"))
    x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
    found: set[tuple[int, int]] = set()
    if len(x) and len(y):
        owner = np.repeat(np.arange(len(y)), [len(sets[i]) for i in y])
        element = np.concatenate([sets[i] for i in y])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        sizes = np.array([len(sets[i]) for i in y])
        for i in x:
            lo, hi = np.searchsorted(element, sets[i], "left"), np.searchsorted(element, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(y))
            link = (OVER * common >= UNDER * (len(sets[i]) + sizes - common)) & (home[y] != home[i])
            found |= {(min(c, int(home[i])), max(c, int(home[i]))) for c in set(home[y[link]].tolist())}
    return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select("row", "doc_id", "text").mapInArrow(_sketch, "row long, doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, text) of the rows with one of the numbers."""
    few = rows.count() <= 2_000_000  # so many numbers are 16 MB; beyond, they are joined by a shuffle
    return written(docs.select("row", "text").join(F.broadcast(rows) if few else rows, "row", "left_semi"), "near-texts")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with common, total and link, from the texts."""
    ta, tb = (texts.select(F.col("row").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    full = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    out = full.mapInArrow(_confirm, "a long, b long, common long, total long")
    return out.distinct().withColumn("link", OVER * F.col("common") >= UNDER * F.col("total"))


def bridges(groups: DataFrame, label: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that share a pivot's buckets. groups: (p, a), the members of each pivot's buckets."""
    home = label.select(F.col("node").alias("a"), F.col("component").alias("c"))
    placed = groups.join(home, "a", "left").withColumn("c", F.coalesce("c", "a"))
    top = label.select(F.col("node").alias("p"), F.col("component").alias("pc"))
    placed = written(placed.join(top, "p", "left").withColumn("outside", F.col("c") != F.coalesce("pc", "p")).drop("pc"), "near-placed")
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"), F.count_if("outside").alias("k")).where("k > 0")
    blocks = sizes.select("p", F.ceil(F.col("k") / MANY_X).cast("int").alias("bx"), F.ceil(F.col("n") / MANY_Y).cast("int").alias("by"))
    rows = placed.join(blocks, "p")
    part = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where("outside").select("p", "a", "c", F.lit(True).alias("x"), part("bx").alias("i"), every("by").alias("j"))
    y = rows.select("p", "a", "c", F.lit(False).alias("x"), every("bx").alias("i"), part("by").alias("j"))
    full = x.unionByName(y).join(texts.withColumnRenamed("row", "a"), "a")
    return full.groupBy("p", "i", "j").applyInArrow(_bridges, "a long, b long").distinct()


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """docs' columns, or the given ones, and the number `__row` of each row, written so that all that reads it agrees."""
    return written(docs.select(*(columns or [F.col(f"`{c}`") for c in docs.columns]), F.monotonically_increasing_id().alias("__row")), "near-rows")


def _decided(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept for each row of docs (row, doc_id, text)."""
    marks = written(sketches(docs), "near-sketches")
    wide = lambda c: c.cast("decimal(38,0)")
    order = (wide(F.coalesce("doc_id", F.lit(LAST))) * wide(F.lit(str(1 << 63))) + wide(F.col("row"))).cast("decimal(38,0)")
    sets = marks.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("row").alias("a"), F.first("bands").alias("bands"), F.min("doc_id").alias("name"), F.min(order).alias("first"))
    sets = written(sets, "near-sets")
    members = sets.select("a", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(sizes, ["band", "bucket"]), "near-shared")
    # a text that its copies are edits of meets more of them in buckets than they meet each other: it makes the better pivot
    met = shared.groupBy("a").agg(F.sum("size").alias("met"))
    pivots = shared.join(met, "a").groupBy("band", "bucket").agg(F.max(F.struct("met", (-F.col("a")).alias("a"))).alias("best")).select("band", "bucket", (-F.col("best.a")).alias("p"))
    groups = written(shared.join(pivots, ["band", "bucket"]).select("p", "a").where("a != p").distinct(), "near-groups")
    texts = texts_of(docs, written(groups.select("a").union(groups.select("p")).distinct().withColumnRenamed("a", "row"), "near-wanted"))
    stars = confirmed(groups.select(F.col("p").alias("a"), F.col("a").alias("b")), texts)
    label = components(written(stars.where("link").select("a", "b"), "near-stars"))
    more = written(bridges(groups, label, texts), "near-bridges")
    forget(shared, groups, texts)
    if not more.isEmpty():
        over = components(more).select(F.col("node").alias("component"), F.col("component").alias("top"))
        ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        known = label.unionByName(ends.join(label, "node", "left_anti").withColumn("component", F.col("node")))
        label = written(known.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "near-labels")
    members = sets.join(label.withColumnRenamed("node", "a"), "a", "left").select("k1", "k2", "name", "first", F.coalesce("component", "a").alias("component"))
    best = members.groupBy("component").agg(F.min("name").alias("component_id"), F.min("first").alias("first"))
    classes = members.select("k1", "k2", "component").join(best, "component").drop("component")
    out = marks.where("n_shingles > 0").join(classes, ["k1", "k2"]).select("row", "doc_id", "n_shingles", "component_id", (order == F.col("first")).alias("kept"))
    return out.unionByName(marks.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; of each class one row is kept."""
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return _decided(rows.withColumnRenamed("__row", "row")).drop("row")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The row that is kept of each class of near_classes(), and all rows without shingles; their columns as they were."""
    own, back = aside(docs, "doc_id", "text")
    rows = numbered(own)
    decided = _decided(rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    drop = decided.where("not kept").select(F.col("row").alias("__row"))
    return rows.join(drop, "__row", "left_anti").select(*back)
