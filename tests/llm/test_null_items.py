"""Benchmark items without an id."""

from __future__ import annotations

import hashlib
from collections import Counter

from recurra.llm import decontamination


def test_items_with_null_ids_count_in_hits_only(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(15)) for c in "ab")
    docs = spark.createDataFrame([(1, "x " + first), (2, f"{first} y {second}"), (3, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, first), (4, second), (None, None)], "item_id long, text string")
    for size in (decontamination.BLOCK_BYTES, 60):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(docs, bench, block_bytes=size).collect()}
        none, four = (hashlib.sha256(x).hexdigest() for x in (b"", b"4"))
        assert got == {1: (16, 15, 0, none, True), 2: (31, 30, 1, four, True), 3: (3, 0, 0, none, False)}
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [3]
    assert Counter(r["text"] for r in decontamination.without_spans(docs, bench).collect()) == {"x ": 1, " y ": 1, "x y z": 1}
