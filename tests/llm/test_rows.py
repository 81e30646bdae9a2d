"""Rows with null or clashing ids are decided one by one."""

from __future__ import annotations

import random
from collections import Counter

from recurra.llm import exact_dedup, mixing, near_dedup


def test_null_and_clashing_ids_lose_no_text(spark):
    draw = random.Random(5)
    text = lambda i: " ".join(f"w{i}x{draw.randrange(10**6)}" for _ in range(40))
    t = [text(i) for i in range(8)]
    near = t[0] + " tail"
    rows = [(None, t[1], "a"), (None, t[2], "a"), (None, t[2], "a"), (None, t[2] + " end", "a"), (7, t[3], "b"), (7, t[4], "b"), (7, near, "b"), (3, t[0], "a"), (None, t[0], "a"), (9, t[5], "b"), (9, t[5], "b"), (None, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in near_dedup.near_dedup(docs).collect())
    of_two = [(None, t[2]), (None, t[2] + " end")]
    assert sum(got.pop(x, 0) for x in of_two) == 1
    assert got == Counter([(None, t[1]), (7, t[3]), (7, t[4]), (3, t[0]), (9, t[5]), (None, None), (None, "")])
    classes = near_dedup.near_classes(docs).collect()
    assert len(classes) == len(rows) and sum(r["kept"] for r in classes) == 8 and Counter(r["component_id"] for r in classes if r["doc_id"] == 7) == {7: 2, 3: 1}

    exact = Counter((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(docs).collect())
    empty = [(None, None), (None, "")]
    assert sum(exact.pop(x, 0) for x in empty) == 1
    assert exact == Counter([(None, t[1]), (None, t[2]), (None, t[2] + " end"), (7, t[3]), (7, t[4]), (7, near), (3, t[0]), (9, t[5])])

    mixed = mixing.mixed(docs).collect()
    size = lambda r: len((r["text"] or "").split())
    for target in {(r["source"], r["target"]) for r in mixing.mix(docs).collect()}:
        assert abs(sum(size(r) for r in mixed if r["source"] == target[0]) - target[1]) <= 21
    assert any(r["doc_id"] is None and r["text"] for r in mixed)
