"""Benchmark decontamination: a broadcast set of normalised 13-word windows of the items, probed by every window of a text.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z lower-cased. An item of one to twelve words
is one window. Windows of a text are hashed on its bytes; a bitmap of the items' hashes lets few windows through, a
binary search finds their items, and the words themselves are compared. Only a checked size of items is broadcast.
Beyond it only the bitmaps are, of 2 ** WIDE bits for each length of windows: they are summed up on the executors, the
windows of texts that pass them meet the items' windows in a join on their hash and words, and nothing else is collected.

Defined results: a null or empty text, or one without words, has n_words 0, n_hit 0 and is clean; an item
of null or wordless text never occurs; the windows of an item with a null item_id count in n_hit, but it is no item of
n_items and items_sha256; repeated rows each return a row; equal items all count; with an empty benchmark all is clean; an
empty table gives no rows. contamination() replaces columns of docs called as those of JUDGED; decontaminate() and
without_spans() leave all columns but the text as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.bytewise import ALPHANUMERIC, U, runs, texts_bounds, texts_words
from recurra.llm.storage import aside, written

WINDOW = 13
#: Bytes of items that are broadcast at most: their windows, hashes and words take about 20 times that.
BLOCK_BYTES = 8 << 20
SIEVE = 22
#: 2 ** WIDE bits of a bitmap are broadcast for each length of windows if the items are not: 8 MB, so 104 MB at most.
WIDE = 26


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: int, k: int) -> bytes:
    """k words, a space between them."""
    return b" ".join(data[starts[q] : stops[q]].tobytes() for q in range(first, first + k))


class Windows:
    """Windows of items by length: sorted hashes with the window each stands for."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        self.by_length: dict[int, list[tuple[int, bytes, str]]] = {}
        column = pa.array([t for _, t in items], pa.string())
        for first, data, starts, stops, hashes, rows in texts_words(column, ALPHANUMERIC):
            for i, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
                k = min(WINDOW, int(b - a))
                for j, h in enumerate(runs(hashes[a:b], k) if k else ()):
                    words = _joined(data, starts, stops, a + j, k)
                    self.by_length.setdefault(k, []).append((int(h), words, items[first + i][0]))
        self.tables = {}
        for k, rows in self.by_length.items():
            found: dict[int, dict[bytes, list[str]]] = {}
            for h, words, item in rows:
                found.setdefault(h, {}).setdefault(words, []).append(item)
            sieve = np.zeros(1 << SIEVE, bool)
            keys = np.array(sorted(found), U)
            sieve[keys >> U(64 - SIEVE)] = True
            self.tables[k] = (sieve, keys, found)
        del self.by_length

    def find(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
        """(number of words, [(first word, word after the last, item)]) of each text."""
        for _, data, starts, stops, hashes, rows in texts_words(column, ALPHANUMERIC):
            spans: dict[int, list[tuple[int, int, str]]] = {}
            for k, (sieve, keys, found) in self.tables.items():
                window = runs(hashes, k)
                at = np.flatnonzero(sieve[window >> U(64 - SIEVE)])
                if len(at):
                    place = np.minimum(np.searchsorted(keys, window[at]), len(keys) - 1)
                    at = at[keys[place] == window[at]]
                row = np.searchsorted(rows, at, side="right") - 1
                for w, r in zip(at.tolist(), row.tolist()):
                    if w + k <= rows[r + 1]:  # not over the end of the text
                        words = _joined(data, starts, stops, w, k)
                        spans.setdefault(r, []).extend((w - int(rows[r]), w - int(rows[r]) + k, item) for item in found[int(window[w])].get(words, ()))
            for r in range(len(rows) - 1):
                yield int(rows[r + 1] - rows[r]), spans.get(r, [])


def _verdict(n_words: int, spans: list[tuple[int, int, str]]) -> tuple[int, int, str, bool]:
    """n_hit, n_items, items_sha256, contaminated."""
    hit = np.zeros(n_words + 1, np.int32)
    for a, b, _ in spans:
        hit[a] += 1
        hit[b] -= 1
    n_hit = int((np.cumsum(hit) > 0).sum())
    items = sorted({x for _, _, x in spans if x is not None})
    return n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


JUDGED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(column: Iterator[tuple[int, list]]) -> list[pa.Array]:
    rows = [(n, *_verdict(n, spans)) for n, spans in column]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]


def _judge(windows) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *_judged(w.find(batch.column("text")))], [*names, *[x.split()[0] for x in JUDGED.split(", ")]])

    return scan


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, hash, words, item of each window of items."""
    for batch in batches:
        ids, out = batch.column("item_id").to_pylist(), []
        for first, data, starts, stops, hashes, rows in texts_words(batch.column("text"), ALPHANUMERIC):
            for i, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
                k = min(WINDOW, int(b - a))
                for j, h in enumerate(runs(hashes[a:b], k).view(np.int64).tolist() if k else ()):
                    out.append((k, h, _joined(data, starts, stops, a + j, k), ids[first + i]))
        types = (pa.int32(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["k", "hash", "words", "item"])


def _passing(sieves) -> Callable:
    """row, k, hash, words, start of the windows of texts that pass the sieves; a row of k = 0 with the number of words for each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(bits, np.uint8) for k, bits in sieves.value.items()}
        for batch in batches:
            ids = batch.column("__row").to_pylist()
            for first, data, starts, stops, hashes, rows in texts_words(batch.column("text"), ALPHANUMERIC):
                out = [(ids[first + r], 0, 0, b"", int(rows[r + 1] - rows[r])) for r in range(len(rows) - 1)]
                for k, sieve in tables.items():
                    window = runs(hashes, k)
                    slot = window >> U(64 - WIDE)
                    at = np.flatnonzero(sieve[slot >> U(3)] >> (slot & U(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(rows, at, side="right") - 1
                    for w, r, h in zip(at.tolist(), row.tolist(), window[at].view(np.int64).tolist()):
                        if w + k <= rows[r + 1]:  # not over the end of the text
                            out.append((ids[first + r], k, h, _joined(data, starts, stops, w, k), w - int(rows[r])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["__row", "k", "hash", "words", "start"])

    return scan


def _sieves(windows: DataFrame) -> dict[int, bytes]:
    """For each length of windows a bitmap of 2 ** WIDE bits, by the first bits of the hash; put together on the executors."""
    slot = F.shiftrightunsigned("hash", 64 - WIDE)
    parts = windows.groupBy("k", F.bitmap_bucket_number(slot + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    out: dict[int, bytearray] = {}
    for r in parts.collect():  # at most WINDOW bitmaps of 2 ** (WIDE - 3) bytes
        at = (r["part"] - 1) * len(r["bits"])
        out.setdefault(r["k"], bytearray(1 << WIDE - 3))[at : at + len(r["bits"])] = r["bits"]
    return {k: bytes(b) for k, b in out.items()}


def _judged_by_join(rows: DataFrame, items: DataFrame) -> DataFrame:
    """__row, the columns of JUDGED and the spans (start, stop) of hit words for each row of rows (__row, text)."""
    windows = written(items.mapInArrow(_windows_of, "k int, hash long, words binary, item string").distinct(), "contamination-windows")
    sent = rows.sparkSession.sparkContext.broadcast(_sieves(windows))
    found = written(rows.mapInArrow(_passing(sent), "__row long, k int, hash long, words binary, start int"), "contamination-found")
    hits = written(found.where("k > 0").join(windows, ["k", "hash", "words"]).select("__row", "start", (F.col("start") + F.col("k")).alias("stop"), "item"), "contamination-hits")
    spans = hits.select("__row", F.struct("start", "stop").alias("span")).distinct().groupBy("__row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    step = lambda x, s: F.struct(F.greatest(x["upto"], s["stop"]).alias("upto"), (x["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(x["upto"], s["start"]))).cast("long").alias("n"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), step)["n"]
    names = hits.where("item is not null").select("__row", "item").distinct().groupBy("__row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = found.where("k = 0").select("__row", F.col("start").cast("long").alias("n_words")).join(spans, "__row", "left").join(names, "__row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({"n_hit": zero(n_hit), "n_items": zero(F.size("items")), "items_sha256": F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)})
    out = out.withColumn("n_items", F.greatest(F.lit(0), "n_items")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return out.select("__row", *[x.split()[0] for x in JUDGED.split(", ")], "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns but text, with the columns of JUDGED (columns of docs so named are left out), for each row."""
    spark = docs.sparkSession
    judged = [x.split()[0] for x in JUDGED.split(", ")]
    keep = [c for c in docs.columns if c not in (*judged, "text")]
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= block_bytes:
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()]))
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema], JUDGED])
        return docs.select(*[F.col(f"`{c}`") for c in [*keep, "text"]]).mapInArrow(_judge(windows), schema)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "contamination-rows")
    found = _judged_by_join(rows.select("__row", "text"), items).drop("spans")
    return rows.select("__row", *[F.col(f"`{c}`") for c in keep]).join(found, "__row").drop("__row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that contamination() marks, their columns as they were."""
    rows, back = aside(docs, "text")
    marked = contamination(rows.withColumn("_text", F.col("text")), benchmark, block_bytes).withColumnRenamed("_text", "text")
    return marked.where("not contaminated").select(*back)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first word of each span to the last."""
    raw = text.encode()
    for _, _, starts, stops, _ in texts_bounds(pa.array([text]), ALPHANUMERIC, most=None):
        dead = np.zeros(len(raw), bool)
        for a, b in spans:
            dead[starts[a] : stops[b - 1]] = True
        return np.frombuffer(raw, np.uint8)[~dead].tobytes().decode()
    return text


def without_spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit words of contaminated texts removed, from the first hit byte to the last of each span."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows, back = aside(docs, "text")
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= block_bytes:
        windows = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()]))

        def spans_of(batch: pa.RecordBatch) -> list:
            found = windows.value.find(batch.column("text"))
            return [[(a, b) for a, b, _ in spans] if _verdict(n, spans)[3] else None for n, spans in found]
    else:
        rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "contamination-rows")
        found = _judged_by_join(rows.select("__row", "text"), items).where("contaminated").select("__row", F.col("spans").alias("__spans"))
        rows = rows.join(found, "__row", "left").drop("__row")

        def spans_of(batch: pa.RecordBatch) -> list:
            return [x and [(s["start"], s["stop"]) for s in x] for x in batch.column("__spans").to_pylist()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for i, spans in enumerate(spans_of(batch)):
                if spans:
                    texts[i] = _without(texts[i], spans)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return rows.mapInArrow(cut, rows.schema).select(*back)
