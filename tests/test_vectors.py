"""Exact nearest vectors among many copies."""

from __future__ import annotations

import numpy as np

from recurra.operators.search import nearest_vectors


def test_of_many_copies_the_smallest_ids_are_nearest(spark):
    draw = np.random.default_rng(2)
    base, other = draw.normal(size=16) * 100, draw.normal(size=16)
    ids = draw.permutation(300)
    rows = [(int(i), [float(v) for v in (base + (1e-9 * other if i % 3 else 0) if i < 200 else base + draw.normal(size=16))]) for i in ids]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = vectors.where("vec_id in (5, 150, 299)")
    got = {}
    for r in nearest_vectors(vectors, asked, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    known = {i: np.array(v) for i, v in rows}
    for i in (5, 150, 299):
        plain = sorted((round(float(np.sqrt(((known[i] - v) ** 2).sum())), 6), j) for j, v in known.items() if j != i)[:10]
        assert [got[i][k] for k in range(1, 11)] == [j for _, j in plain]
