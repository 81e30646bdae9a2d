"""Line dedup: a segment-partition edit join over the distinct lines of all texts.

Lines are cut at line feeds, without white space at their ends. Two lines are linked if their edit distance, in code
points, is at most what the shorter one's length allows (EDITS). A line that allows e edits is cut into e + 1 segments;
under e edits one of them stays whole, so every line gives its segments to an index, keyed by (length, segment, hash),
and probes the keys of shorter lengths with the substrings that could be that segment (those of the multi-match-aware
selection). Lines of one length meet in the index itself. Hashes of substrings are differences of prefix sums, so all
keys of a batch are made by array arithmetic. They only propose pairs: a pair is verified on its texts, with an edit
distance whose states, the diagonals within reach, are bits of one number for each pair, for all pairs of a task at once.

Keys are dealt out once, packed, to buckets whose number grows with the lines; in a bucket the index comes first and the
probes pass by it: a key goes on only if it has an indexed line and another line. A key that many lines of one run have is
dealt over SALTS buckets. Keys are never expanded into pairs that move: the lines of a
key meet in a cell, those of a large key in cells of PER_BLOCK a side, and only a forest of the links leaves a task.
Linked lines form classes. Of a class the first line of all texts stays, in the order of doc_id and place; white-space
lines always stay.

Equal lines are known by a 128-bit cryptographic digest: for 10**12 distinct lines a wrong merge has a chance of 1.5e-15.

Defined results: a null text counts as empty (no lines that count); rows are told apart by a number, so repeated rows and
rows that share a doc_id, or have none, are texts of their own; a null doc_id comes first; of rows with one doc_id the
order is that of a hash of their texts; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.bytewise import STEP, U, mix
from recurra.llm.components import components
from recurra.llm.storage import forget, written

#: (characters, edits): what lines of so many characters and more allow. Shorter lines than the first must be equal.
EDITS = ((8, 1), (80, 2), (160, 3), (320, 4))
MOST = max(e for _, e in EDITS)
#: Lines of a key that meet in one cell; those of a larger key are dealt over cells with so many on each side.
PER_BLOCK = 256
#: A key of more lines of one run is dealt over so many buckets.
LOCAL, SALTS = 16, 64
#: Lines for each bucket of keys: the index of a bucket is what a task holds at once. Pairs in a row, at most.
PER_BUCKET, PACKED = 1 << 15, 256
#: Code points whose keys are made together, and pairs that are verified together.
TOGETHER, PAIRS = 1 << 19, 1 << 15
#: Classes of characters whose numbers in two lines are compared before the lines are.
BAG = 16
SALTED, NOBODY, FIRST = -(1 << 63), 0, -(1 << 63)


def allowed(n: np.ndarray) -> np.ndarray:
    """Edits that lines of n characters allow."""
    out = np.zeros(len(n), np.int64)
    for least, edits in EDITS:
        out[n >= least] = edits
    return out


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines, and each line's start and length."""
    size = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many characters from places a and b on, n at most, are equal, going by step."""
    out = np.zeros(len(a), np.int64)
    for i in range(len(a)):
        x, y = (points[p[i] : p[i] + n[i]] if step > 0 else points[p[i] - n[i] + 1 : p[i] + 1][::-1] for p in (a, b))
        differ = np.flatnonzero(x != y)
        out[i] = differ[0] if len(differ) else n[i]
    return out


def within(points: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of lines, by number, is linked. reach[e] of a pair: bit d is set if e edits lead to diagonal d - MOST."""
    most = allowed(np.minimum(size[left], size[right]))
    out = np.zeros(len(left), bool)
    live = np.flatnonzero(np.abs(size[left] - size[right]) <= most)
    sa, sb, na, nb = start[left], start[right], size[left], size[right]
    # equal beginnings and ends cost no edits
    head = np.zeros(len(left), np.int64)
    head[live] = _common(points, sa[live], sb[live], np.minimum(na, nb)[live], 1)
    sa, sb, na, nb = sa + head, sb + head, na - head, nb - head
    tail = np.zeros(len(left), np.int64)
    tail[live] = _common(points, (sa + na - 1)[live], (sb + nb - 1)[live], np.minimum(na, nb)[live], -1)
    na, nb = na - tail, nb - tail
    shift, width = nb - na, 2 * MOST + 1
    other = np.concatenate([np.full(MOST, 0xFFFFFFFF, np.uint32), points, np.full(width + 16, 0xFFFFFFFF, np.uint32)])
    mine = np.concatenate([points, np.zeros(16, np.uint32)])
    reach = np.tile(np.array([((1 << (e + 1)) - 1) << MOST & (1 << width) - 1 for e in range(MOST + 1)], np.uint16)[:, None], (1, len(live)))
    full, i = np.uint16((1 << width) - 1), 0
    while len(live):
        if i % 16 == 0:  # the masks of equal characters of the next 16 columns
            alive = reach[most[live], np.arange(len(live))] != 0
            live, reach = live[alive], reach[:, alive]
            place = sb[live][None, :] + np.arange(i, i + 16)[:, None]
            c = mine[np.minimum(sa[live][None, :] + np.arange(i, i + 16)[:, None], len(mine) - 1)]
            j, ends = np.arange(i, i + 16)[:, None] - MOST, nb[live][None, :]
            masks = np.zeros(place.shape, np.uint16)
            for k in range(width):
                masks |= ((other[np.minimum(place + k, len(other) - 1)] == c) & (j + k < ends) & (j + k >= 0)).astype(np.uint16) << np.uint16(k)
        done = na[live] == i
        if done.any():
            at = live[done]
            out[at] = reach[most[at], np.flatnonzero(done)] >> (shift[at] + MOST).astype(np.uint16) & 1
            live, reach, masks = live[~done], reach[:, ~done], masks[:, ~done]
        new = reach & masks[i % 16]
        for e in range(1, MOST + 1):
            new[e] |= reach[e - 1] | reach[e - 1] >> np.uint16(1) | new[e - 1] << np.uint16(1)
            new[e] &= full
        reach, i = new, i + 1
    return out


def keys_of(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, numbers of the lines that have them, whether these are the index) of lines; keys are even."""
    points, start, n = _points(lines)
    power = np.concatenate([np.ones(1, U), np.full(len(points), STEP, U)]).cumprod(dtype=U)
    back = np.concatenate([np.ones(1, U), np.full(len(points), pow(STEP, -1, 1 << 64), U)]).cumprod(dtype=U)
    sums = np.concatenate([np.zeros(1, U), (mix(points.astype(U) + U(1)) * power[:-1]).cumsum(dtype=U)])

    def key(a: np.ndarray, b: np.ndarray, k: np.ndarray, i: int) -> np.ndarray:
        x = (sums[b] - sums[a]) * back[a] + (k * (MOST + 1) + i).astype(U) * U(0xD1B54A32D192ED03)
        x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> U(29))) & ~U(1)).view(np.int64)

    own = allowed(n)
    for edits in sorted({e for _, e in EDITS}):
        for less in range(edits + 1):
            who = np.flatnonzero((own if not less else allowed(n - less)) == edits)
            if not len(who):
                continue
            k, first, last = n[who] - less, start[who], start[who] + n[who]
            cuts = [k * i // (edits + 1) for i in range(edits + 2)]
            for i in range(edits + 1):
                a, b = first + cuts[i], first + cuts[i + 1]
                if not less:
                    yield key(a, b, k, i), who, True
                for by in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                    if less or by:  # else it is the segment itself
                        ok = (a + by >= first) & (b + by <= last)
                        yield (key(a + by, b + by, k, i), who, False) if ok.all() else (key(a[ok] + by, b[ok] + by, k[ok], i), who[ok], False)


def groups_of(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines of about TOGETHER code points."""
    upto = np.cumsum([len(x) for x in lines])
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, side="right")))
        yield lines[at:to]
        at = to


def digest(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _short(line: str) -> int:
    """63 bits that stand for a line while pairs are looked for."""
    return xxhash.xxh3_64_intdigest(line) >> 1


def _split(text: str | None) -> Iterator[tuple[int, str]]:
    for place, line in enumerate((text or "").split("\n")):
        if line := line.strip():
            yield place, line


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, hash of the text, place and digest of each line; a text without lines has one of place -1."""
    names = ["row", "doc_id", "hash", "place", "d1", "d2"]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        count, place, digests, hashes = np.zeros(len(texts), np.int64), [], [], np.zeros(len(texts), np.int32)
        for r, text in enumerate(texts):
            hashes[r] = xxhash.xxh3_64_intdigest(text or "") >> 33
            own = list(_split(text)) or [(-1, "")]
            count[r] = len(own)
            place += [p for p, _ in own]
            digests += [digest(x) for _, x in own]
        who = pa.array(np.repeat(np.arange(len(texts)), count))
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(who) for c in ("row", "doc_id")], pa.array(hashes).take(who), pa.array(place, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], names)


def _distinct(column: pa.Array) -> list[str]:
    """Distinct lines of texts that allow an edit."""
    return list({line for t in column.to_pylist() for _, line in _split(t) if len(line) >= EDITS[0][0]})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = _distinct(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([_short(x) for x in lines], pa.int64()), pa.array(lines, pa.string())], ["id", "line"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.frombuffer(b"".join(map(digest, batch.column("line").to_pylist())), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], [*batch.schema.names, "d1", "d2"])


def _salted(key: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """One of SALTS other keys, by the line's number; done twice, the key itself."""
    return key ^ (mix((mix(ref.view(U)) % U(SALTS)) + U(1)) & ~U(1)).view(np.int64)


PAIR_ROWS = "bucket int, probe boolean, pairs binary"


def _packed(bucket: np.ndarray, key: np.ndarray, ref: np.ndarray, probe: bool) -> pa.RecordBatch:
    """(key, ref) pairs by bucket, in rows of at most PACKED of them."""
    order = np.argsort(bucket, kind="stable")
    bucket, pairs = bucket[order], np.stack([key[order], ref[order]], axis=1)
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    n = np.diff(np.append(begins, len(bucket)))
    rows = -(-n // PACKED)
    cuts = np.repeat(begins, rows) + (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * PACKED
    offsets = pa.array(np.append(cuts, len(bucket)) * 16, pa.int32())
    blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets.buffers()[1], pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(np.full(len(cuts), probe)), blobs], ["bucket", "probe", "pairs"])


def _keys(buckets: int) -> Callable:
    """Pairs of each key and the number of the line that has it, for each distinct line of a run of lines; those of the index apart.

    A key of more than LOCAL lines is salted, which its refs tell by SALTED, and has a pair of no line on each side besides.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in groups_of(_distinct(batch.column("text"))):
                short = np.array([_short(x) for x in lines], np.int64)
                parts = list(keys_of(lines))
                key, ref = np.concatenate([k for k, _, _ in parts]), short[np.concatenate([w for _, w, _ in parts])]
                probe = np.repeat([not i for _, _, i in parts], [len(k) for k, _, _ in parts])
                slot = (key >> 46) & ((1 << 18) - 1)
                maybe = np.flatnonzero((np.bincount(slot, minlength=1 << 18) > LOCAL)[slot])
                signs, which, n = np.unique(key[maybe], return_inverse=True, return_counts=True)
                hot, signs = maybe[n[which] > LOCAL], signs[n > LOCAL]
                key[hot] = _salted(key[hot], ref[hot])
                ref[hot] |= SALTED
                for side in (False, True):
                    k = np.concatenate([key[probe == side], signs])
                    r = np.concatenate([ref[probe == side], np.full(len(signs), NOBODY + side)])
                    yield _packed(((k.view(U) >> U(20)) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32), k, r, side)

    return pairs


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, indexed of the keys that have an indexed line and another line, and of all that are salted.

    Rows come in the order of bucket and side. Of a bucket, the keys of the index are held, with one line each and
    whether it has been given out; a key's other lines, and all probes, pass by.
    """
    now, keys, refs, given = None, *(np.zeros(0, t) for t in (np.int64, np.int64, bool))
    for batch in batches:
        bucket, side = batch.column("bucket").to_numpy(), np.array(batch.column("probe"))
        blobs = batch.column("pairs")
        ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1 + blobs.offset)[blobs.offset :] if len(blobs) else np.zeros(1, np.int32)
        data = np.frombuffer(blobs.buffers()[2], np.uint8) if len(blobs) else b""
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1])) + 1
        out: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for a, b in zip([0, *cuts], [*cuts, len(blobs)] if len(blobs) else []):
            if now != bucket[a]:
                now, keys, refs, given = bucket[a], *(np.zeros(0, t) for t in (np.int64, np.int64, bool))
            pairs = data[ends[a] : ends[b]].tobytes()
            key, ref = np.frombuffer(pairs, np.int64).reshape(-1, 2).T
            probe, salted = bool(side[a]), ref < 0
            if salted.any():
                out.append((_salted(key[salted], ref[salted] ^ SALTED), ref[salted] ^ SALTED, not probe))
                key, ref = key[~salted], ref[~salted]
            if probe:
                if not len(keys):
                    continue
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = (keys[place] == key) & (ref != refs[place])
                out.append((key[met], ref[met], False))
                fresh = np.unique(place[met])
                fresh = fresh[~given[fresh]]
                out.append((keys[fresh], refs[fresh], True))
                given[fresh] = True
            else:
                k, r, g = np.concatenate([keys, key]), np.concatenate([refs, ref]), np.concatenate([given, np.zeros(len(key), bool)])
                old = np.arange(len(k)) < len(keys)
                order = np.argsort(k, kind="stable")
                k, r, g, old = k[order], r[order], g[order], old[order]
                begins = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
                first, number = np.flatnonzero(begins), np.cumsum(begins) - 1
                several = np.zeros(len(first), bool)
                several[number[r != r[first][number]]] = True
                give = (several | g[first])[number] & ~(old & g)
                out.append((k[give], r[give], True))
                keys, refs, given = k[first], r[first], g[first] | several
        for key, ref, indexed in out:
            real = (ref != NOBODY) & (ref != NOBODY + 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[real]), pa.array(ref[real]), pa.array(np.full(int(real.sum()), indexed))], ["key", "id", "indexed"])


def _forest(cells: np.ndarray, side: np.ndarray, node: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """A forest of the links within cells between lines of the probing side (1, 2) and of the index (0, 2). cells: in order."""
    points, start, size = _points(lines)
    bag = np.bincount(np.repeat(np.arange(len(lines)) * BAG, size) + points % BAG, minlength=len(lines) * BAG).reshape(-1, BAG).astype(np.int32)
    top = {i: i for i in node}
    out = []

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    def hold(left: np.ndarray, right: np.ndarray) -> None:
        """Link those pairs of lines that are not in one tree yet."""
        for at in range(0, len(left), PAIRS):
            x, y = left[at : at + PAIRS], right[at : at + PAIRS]
            # an edit changes two numbers of a line's bag of characters by one at most
            maybe = np.abs(bag[x] - bag[y]).sum(axis=1) <= 2 * allowed(np.minimum(size[x], size[y]))
            x, y = x[maybe], y[maybe]
            tops = {i: find(node[i]) for i in {*x.tolist(), *y.tolist()}}
            apart = np.array([tops[i] != tops[j] for i, j in zip(x.tolist(), y.tolist())], bool)
            x, y = x[apart], y[apart]
            ok = within(points, start, size, x, y)
            for i, j in zip(x[ok].tolist(), y[ok].tolist()):
                a, b = find(node[i]), find(node[j])
                if a != b:
                    top[max(a, b)] = min(a, b)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))

    every, own = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
    bounds = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    xs, ys = np.append(np.searchsorted(every, bounds), len(every)), np.append(np.searchsorted(own, bounds), len(own))
    cells_ = [(every[xs[c] : xs[c + 1]], own[ys[c] : ys[c + 1]]) for c in range(len(bounds)) if xs[c] < xs[c + 1] and ys[c] < ys[c + 1]]
    if not cells_:
        return out
    # all against one line of the index, and the index against one of all: most of a crowd are copies of one line
    hold(np.concatenate([x for x, _ in cells_]), np.concatenate([np.full(len(x), y[0]) for x, y in cells_]))
    hold(np.concatenate([np.full(len(y), x[0]) for x, y in cells_]), np.concatenate([y for _, y in cells_]))
    small = [(x, y) for x, y in cells_ if len(x) > 1 and len(y) > 1 and len(x) * len(y) <= 256]
    if small:
        hold(np.concatenate([np.repeat(x, len(y)) for x, y in small]), np.concatenate([np.tile(y, len(x)) for x, y in small]))
    for x, y in cells_:
        if len(x) * len(y) > 256:
            step = max(1, PAIRS // len(y))
            for at in range(0, len(x), step):
                hold(np.repeat(x[at : at + step], len(y)), np.tile(y, len(x[at : at + step])))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the lines of cells (key, i, j), which come one after another."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        parts = [np.array(rows.column(c)) for c in ("key", "i", "j")]
        changes = np.concatenate([[0], np.cumsum(np.any([p[1:] != p[:-1] for p in parts], axis=0))])
        found = _forest(changes, np.array(rows.column("side")), rows.column("node").to_pylist(), rows.column("line").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        key, i, j = (np.array(batch.column(c)) for c in ("key", "i", "j"))
        last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if batch.num_rows else []
        if len(last):  # the last cell may go on
            cut = int(last[-1]) + 1
            held[-1] = batch.slice(0, cut)
            yield links(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
    if held and sum(b.num_rows for b in held):
        yield links(pa.Table.from_batches(held))


def line_links(docs: DataFrame, n_lines: int) -> tuple[DataFrame, DataFrame]:
    """Lines (node, d1, d2) that may be linked, and links (a, b) of nodes with the components that all links have.

    Texts stay where they are until it is known which lines have a key in common with another; only theirs are moved.
    """
    texts = docs.select("text")
    keys = texts.mapInArrow(_keys(n_lines // PER_BUCKET + 1), PAIR_ROWS).repartition("bucket").sortWithinPartitions("bucket", "probe")
    full = written(keys.mapInArrow(_meeting, "key long, id long, indexed boolean").distinct(), "line-members")
    wanted = written(full.select("id").distinct(), "line-wanted")
    few = wanted.count() <= 2_000_000  # so many numbers are 16 MB; beyond, they are joined by a shuffle
    lines = texts.mapInArrow(_texts, "id long, line string").join(F.broadcast(wanted) if few else wanted, "id", "left_semi").distinct()
    lines = lines.withColumn("node", F.monotonically_increasing_id()).mapInArrow(_digests, "id long, line string, node long, d1 long, d2 long")
    lines = written(lines, "line-texts")
    forget(wanted)
    stats = full.groupBy("key").agg(F.count_if("indexed").alias("own"), F.count("*").alias("n")).where("own > 0 and n > 1")
    placed = written(full.join(stats, "key").join(lines.select("id", "node"), "id"), "line-placed")
    forget(full)
    parts = lambda c: F.ceil(F.col(c) / PER_BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    zero = F.lit(0)
    few, many = placed.where(F.col("n") <= PER_BLOCK), placed.where(F.col("n") > PER_BLOCK)
    cells = few.select("key", "node", F.when(F.col("indexed"), 2).otherwise(1).cast("byte").alias("side"), zero.alias("i"), zero.alias("j"))
    cells = cells.unionByName(many.select("key", "node", F.lit(1).cast("byte").alias("side"), part(parts("n")).alias("i"), every(parts("own")).alias("j")))
    cells = cells.unionByName(many.where("indexed").select("key", "node", F.lit(0).cast("byte").alias("side"), every(parts("n")).alias("i"), part(parts("own")).alias("j")))
    full = cells.join(lines.select("node", "line"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    out = written(full.mapInArrow(_linked, "a long, b long").distinct(), "line-links")
    forget(placed)
    return lines, out


def _order() -> Column:
    wide = lambda c: c.cast("decimal(38,0)")
    bits = lambda n: wide(F.lit(str(1 << n)))
    return ((wide(F.coalesce("doc_id", F.lit(FIRST))) * bits(31) + wide(F.col("hash"))) * bits(31) + wide(F.col("place"))).cast("decimal(38,0)")


def line_classes(rows: DataFrame) -> DataFrame:
    """row, doc_id, place, first_doc, first_place, dropped for each line of rows (row, doc_id, text); place -1 and no class for texts without lines."""
    at = written(rows.mapInArrow(_places, "row long, doc_id long, hash int, place int, d1 long, d2 long"), "line-places")
    lines, links = line_links(rows, at.count())
    label = components(links)
    label = label.join(lines.select("node", "d1", "d2"), "node").drop("node")
    order = _order()
    firsts = at.where("place >= 0").groupBy("d1", "d2").agg(F.min(order).alias("first"), F.min_by("row", order).alias("row0"), F.min_by("doc_id", order).alias("doc0"), F.min_by("place", order).alias("place0"))
    firsts = written(firsts.join(label, ["d1", "d2"], "left"), "line-firsts")
    names = ["first", "row0", "doc0", "place0"]
    best = firsts.where("component is not null").groupBy("component").agg(F.min("first").alias("first"), *[F.min_by(c, "first").alias(c) for c in names[1:]])
    linked = firsts.where("component is not null").select("d1", "d2", "component").join(best, "component").drop("component")
    stays = firsts.where("component is null").drop("component").unionByName(linked).drop("first")
    out = at.where("place >= 0").join(stays, ["d1", "d2"])
    out = out.select("row", "doc_id", "place", F.col("doc0").alias("first_doc"), F.col("place0").alias("first_place"), ((F.col("row") != F.col("row0")) | (F.col("place") != F.col("place0"))).alias("dropped"))
    none = at.where("place < 0").select("row", "doc_id", "place", F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("int").alias("first_place"), F.lit(False).alias("dropped"))
    return out.unionByName(none)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_sha256, classes_sha256 for each row.

    The digests are of the comma-joined places of dropped lines, and of the class (doc_id:place of its first line) of each line.
    """
    marks = line_classes(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    name = F.concat_ws(":", F.coalesce(F.col("first_doc").cast("string"), F.lit("")), "first_place")
    each = F.sort_array(F.collect_list(F.struct("place", F.col("dropped"), name.alias("name"))))
    lines = F.filter(F.col("each"), lambda x: x["place"] >= 0)
    joined = lambda parts, f: F.sha2(F.array_join(F.transform(parts, f), ","), 256)
    dropped = F.filter(lines, lambda x: x["dropped"])
    out = marks.groupBy("row", "doc_id").agg(each.alias("each"))
    return out.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"),
        joined(dropped, lambda x: x["place"].cast("string")).alias("dropped_sha256"), joined(lines, lambda x: x["name"]).alias("classes_sha256"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their dropped lines removed."""
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row")), "line-rows")
    marks = line_classes(rows.select("row", F.col("own.doc_id").cast("long").alias("doc_id"), F.col("own.text").alias("text")))
    places = marks.where("dropped").groupBy("row").agg(F.collect_set("place").alias("places"))
    kept = F.filter(F.split("own.text", "\n", -1), lambda _, i: ~F.array_contains("places", i))
    text = F.when(F.col("places").isNull(), F.col("own.text")).otherwise(F.array_join(kept, "\n"))
    return rows.join(places, "row", "left").select(*[text.alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])
