"""Signatures, component search, gates, comparisons and examples against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recurra.functions import signature
from recurra.operators import audits, comparison, scoring
from recurra.operators import search as S
from recurra.sources import stores, synthetic
from recurra.sources.bars import positions


def plain_signature(o, h, l, c, v, m) -> np.ndarray:  # noqa: E741
    """One window, value by value."""
    o, h, l, c, v = (np.log(x) for x in (o, h, l, c, v))  # noqa: E741
    n = len(c)
    sample = lambda x, k: [float(np.interp(p, range(n), x)) for p in np.linspace(0, n - 1, k)]

    def robust(x):
        scale = np.percentile(x, 75) - np.percentile(x, 25)
        return [(a - np.median(x)) / max(scale if scale > 1e-8 else np.std(x), 1e-6) for a in x]

    seen = [i for i in range(n) if np.isfinite(m[i])]
    known = len(seen) >= max(3, n // 5)
    m = np.log(np.interp(range(n), seen, [m[i] for i in seen])) if known else np.zeros(n)
    shock = [0.0] + [abs(c[i] - c[i - 1]) for i in range(1, n)]
    out = sample(c - c[0], 64) + [x / 0.02 for x in sample(h - l, 16)] + [x / 0.02 for x in sample(c - o, 16)] + robust(sample(v, 16)) + robust(sample(shock, 16))
    out += sample(m - m[0], 16) + (sample(c - c[0] - m + m[0], 16) if known else [0.0] * 16)
    heavy, cuts = robust(v), [int(x) for x in np.linspace(0, n, 13)]
    move = [0.0] + [c[i] - c[i - 1] for i in range(1, n)]
    excess = [0.0] + [c[i] - c[i - 1] - m[i] + m[i - 1] for i in range(1, n)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        mean = sum(move[a:b]) / (b - a)
        out += [(c[b - 1] - c[a]) / 0.08, math.sqrt(sum((x - mean) ** 2 for x in move[a:b]) / (b - a - 1)) / 0.02, sum(heavy[a:b]) / (b - a), sum(excess[a:b]) / 0.08]
    path = sample(c - c[0], 16)
    return np.array(out + [p - max(path[: i + 1]) for i, p in enumerate(path)] + [float(np.sign(b - a)) for a, b in zip(path[:-1], path[1:])] + [float(known)])


def windows(n: int = 5, sessions: int = 63) -> dict[str, np.ndarray]:
    bars = [synthetic.latent(name, 3, 300) for name in sorted(synthetic.LATENT)[:n]]
    out = {("bench" if k == "bench_close" else k): np.stack([b[k].to_numpy(float)[-sessions:] for b in bars]) for k in S.BARS}
    out["bench"][1, 10:20] = np.nan
    out["bench"][2] = np.nan
    return out


def test_signatures():
    w = windows()
    got = signature.signed(w)
    for i, row in enumerate(got):
        want = plain_signature(*[w[k][i] for k in ("open", "high", "low", "close", "volume", "bench")])
        assert np.allclose(row, want, atol=1e-9), [k for k, at in signature.AT.items() if not np.allclose(row[at], want[at], atol=1e-9)]


def test_signature_distances():
    x = signature.signed(windows())
    got, at = signature.distances(x, x[0]), signature.AT
    rms = lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)) / len(a))
    cut = lambda r, *names: [v for n in names for v in r[at[n]]]

    def shape(a, b):
        r = np.corrcoef(a, b)[0, 1] if np.std(a) > 0 and np.std(b) > 0 else -1.0
        return 0.65 * (1 - r) + 0.35 * rms(a, b)

    for i, row in enumerate(x):
        both = bool(row[-1] and x[0][-1])
        names = ("close_path", "range", "volume", "relative_path", "market_path")
        want = {
            "coarse": rms(cut(row, *names), cut(x[0], *names)) / max(np.std(cut(row, *names) + cut(x[0], *names)), 1e-6), "price_shape": shape(cut(row, "close_path"), cut(x[0], "close_path")),
            "stage": rms(cut(row, "stage"), cut(x[0], "stage")), "candle_volatility": rms(cut(row, "range", "body"), cut(x[0], "range", "body")), "volume_shock": rms(cut(row, "volume", "shock"), cut(x[0], "volume", "shock")),
            "market_context": 0.5 * shape(cut(row, "market_path"), cut(x[0], "market_path")) + 0.5 * shape(cut(row, "relative_path"), cut(x[0], "relative_path")) if both else 1.0,
            "structural": 0.6 * rms(cut(row, "drawdown"), cut(x[0], "drawdown")) + 0.4 * sum(a != b for a, b in zip(cut(row, "direction"), cut(x[0], "direction"))) / 15,
        }
        for k, v in want.items():
            assert got[k][i] == pytest.approx(v, abs=1e-9), (i, k)


@pytest.fixture(scope="module")
def latent_rows(spark):
    return positions(synthetic.latent_corpus(spark, 1)).persist()


def test_stored_search(spark, latent_rows, tmp_path):
    """What a store answers is what its windows' signatures say, each symbol's nearest in any view, fused."""
    request = S.Request("latent-00-0", lookback=63, stride=7, local=2)
    stores.write_partitions(S.signatures(latent_rows, request), str(tmp_path / "store"), ["lookback"])
    store, asked = spark.read.parquet(str(tmp_path / "store")), S.query_signature(latent_rows, request)
    got = S.store_search(store, asked, request, F.col("symbol") != request.symbol, 10**6).toPandas()
    rows = store.where("symbol != 'latent-00-0'").toPandas()
    d = pd.DataFrame(signature.distances(np.stack(rows["signature"]), asked)).assign(symbol=rows["symbol"], cutoff=rows["cutoff"], episode_id=rows["episode_id"])
    kept = {e for v in signature.VIEWS for _, g in d.sort_values([v, "cutoff"]).groupby("symbol") for e in g["episode_id"].head(2)}
    assert set(got["episode_id"]) == kept and sorted(got["pool_rank"]) == list(range(1, len(kept) + 1))
    pool = d[d["episode_id"].isin(kept)]
    score = sum(1 / (60 + pool.sort_values([v, "episode_id"]).reset_index()["episode_id"].reset_index().set_index("episode_id")["index"] + 1) for v in signature.VIEWS)
    assert np.allclose(got.set_index("episode_id")["fusion_score"].sort_index(), score.sort_index(), atol=1e-9)


@pytest.mark.parametrize("per_symbol,k", [(1, 5), (2, 6)])
def test_component_search(latent_rows, per_symbol, k):
    request = S.Request("latent-01-0", lookback=63, stride=9, top_k=k, per_symbol=per_symbol)
    store, q = S.representations(latent_rows, request).persist(), S.query_representation(latent_rows, request)
    ok = F.col("symbol") != request.symbol
    brute = S.scored(store.where(ok), q, exact=True).select("d_price", "episode_id", "symbol", "pos").collect()
    want = S.greedy([tuple(r) for r in brute], k, per_symbol, 63)
    got, proof = S.exact_search(store, q, request, ok, seed=10, weights=S.PRICE)
    assert [r[1] for r in got] == [r[1] for r in want] and [r[0] for r in got] == pytest.approx([r[0] for r in want])
    assert proof.complete and proof.candidates == len(brute) and proof.measured <= len(brute)
    alone = {r["episode_id"]: r["distance"] for r in S.scored(store.where(ok), q, True, S.PRICE).collect()}
    assert all(alone[r["episode_id"]] == pytest.approx(r["d_price"]) for r in brute)


def test_calibration_gate():
    """One draw after another, as a plain program would take them."""
    random = np.random.default_rng(1)
    months = {"a": random.normal(0, 0.1, 31), "b": random.normal(0.2, 0.1, 31), "c": np.zeros(31)}
    got = {r["class"]: r for r in audits.calibration_gate(months, 6, 300, 5)}
    raw = {}
    for i, (c, x) in enumerate(months.items()):
        rng, hits, means = np.random.Generator(np.random.PCG64(5 + i)), 0, []
        for _ in range(300):
            at = np.concatenate([np.arange(s, s + 6) for s in rng.choice(np.arange(26), size=6, replace=True)])[:31]
            means.append(x[at].mean())
            hits += abs((x - x.mean())[at].mean()) >= abs(x.mean()) - 1e-15
        raw[c] = (hits + 1) / 301
        assert got[c]["mean"] == pytest.approx(x.mean()) and got[c]["p"] == pytest.approx(raw[c])
        assert (got[c]["low"], got[c]["high"]) == pytest.approx(tuple(np.quantile(means, [0.05 / 6, 1 - 0.05 / 6])))
    order, worst = sorted(raw, key=lambda c: (raw[c], c)), 0.0
    for i, c in enumerate(order):
        worst = max(worst, min(1.0, raw[c] * (3 - i)))
        assert got[c]["adjusted"] == pytest.approx(worst) and got[c]["rejected"] == (worst < 0.05)
    assert got["b"]["rejected"] and not got["a"]["rejected"] and not got["c"]["rejected"]
    with pytest.raises(ValueError):
        audits.calibration_gate({"a": np.zeros(5)}, 6, 10)


def test_block_bootstrap_is_centred_on_the_mean():
    x = np.random.default_rng(2).normal(-0.1, 1, 40)
    got, rng, means = scoring.block_bootstrap(x, 6, 200, 9), np.random.default_rng(9), []
    for _ in range(200):
        means.append(x[np.concatenate([np.arange(s, s + 6) for s in rng.choice(np.arange(35), size=7)])[:40]].mean())
    assert got["lower_p"] == pytest.approx((1 + sum(m - x.mean() <= x.mean() for m in means)) / 201)
    assert got["upper"] == pytest.approx(np.quantile(means, 0.975))


def test_improvement_gates():
    good = {"base": 0.1, "locked": 0.2}
    skills = {s: dict(good) for s in ("all", "1", "2", "3", "4")}
    judged = dict.fromkeys(audits.JUDGED, True)
    call = lambda **x: audits.improvement_gates(**{**dict(skills=skills, logs={"base": -0.1, "locked": 0.0}, inference={"base": {"upper": -0.01}, "locked": {"upper": -0.2}}, adjusted={"base": 0.01, "locked": 0.049}, judged=judged), **x})
    assert all(call().values())
    assert [k for k, v in call(skills=skills | {"3": {"base": 0.0, "locked": 0.2}}).items() if not v] == ["no_negative_fold"]
    assert [k for k, v in call(adjusted={"base": 0.05, "locked": 0.01}).items() if not v] == ["holm_below_5_percent"]
    assert [k for k, v in call(judged=judged | {"leakage": False}).items() if not v] == ["leakage"]
    with pytest.raises(ValueError):
        call(skills={"all": good, "1": good})


def test_halved(latent_rows):
    request = S.Request("", lookback=63, stride=90)
    store = S.representations(latent_rows, request).persist()
    one, two = (x.toPandas().set_index("episode_id").sort_index() for x in (store, S.halved(store)))
    for p in S.PARTS:
        for a, b in zip(one[p], two[p]):
            assert np.array_equal(np.asarray(a, np.float16).astype(float), np.asarray(b, float), equal_nan=True)


def test_examples(spark):
    ok = "2020-01-02,x,ABC,long, EP ,m,6,7,8,9,10,11,12,13,14, n ,"
    lines = [ok, "Entry Date,x,ABC,long,EP,m,6,7,8,9,10,11,12,13,14,n,o", ok[:-1], "2020-02-30" + ok[10:], ok.replace("ABC", "1BC"), ok.replace("ABC", "A B"), ok.replace("ABC", "B.F-/1"), ok.replace(" EP ", '"New, Low"'), "", None]
    got = audits.examples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["symbol"], r["setup"], r["note"]) for r in got] == [("ABC", "episodic_pivot", "n"), ("B.F-/1", "episodic_pivot", "n"), ("ABC", "new,_low", "n")]


def test_trailing_filter(spark):
    random = np.random.default_rng(4)
    rows = pd.DataFrame([(f"s{i}", pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(d)), None if random.random() < 0.1 else float(random.integers(0, 5)) / 4) for i in range(5) for d in range(0, 60, 3)], columns=["symbol", "ts", "score"])
    got = audits.trailing_filter(spark.createDataFrame(rows.astype({"score": object}).where(rows.notna(), None), "symbol string, ts timestamp, score double"), days=20, least=12).toPandas().set_index(["symbol", "ts"])
    for r in rows.itertuples():
        past = [x.score for x in rows.itertuples() if r.ts - pd.Timedelta(days=20) <= x.ts < r.ts and not math.isnan(x.score if x.score is not None else math.nan)]
        limit = np.quantile(past, 1 / 3) if len(past) >= 12 else -np.inf
        assert got.loc[(r.symbol, r.ts), "kept"] == (pd.isna(r.score) or r.score >= limit - 1e-12)


def test_midranks():
    among = np.array([[1.0, 5.0], [2.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    got = comparison.midranks(np.array([[0.0, 4.0], [1.0, 5.0], [2.0, 6.0], [3.0, 5.0], [9.0, 5.0]]), among)
    assert np.allclose(got[:, 0], [-1, -1, 0, 2 / 3, 1]) and got[:, 1].tolist() == [-1, 0, 1, 0, 0]


def test_latent_structures():
    a, b = synthetic.latent("latent-03", 1), synthetic.latent("latent-03", 1)
    assert a.equals(b) and (a["high"] >= a[["open", "close"]].max(axis=1)).all() and (a["low"] <= a[["open", "close"]].min(axis=1)).all() and (a["volume"] >= 1).all()
    still = synthetic.latent("latent-03", 1, noise=0.0)
    assert np.allclose(np.log(still["close"] / 100), np.interp(np.linspace(0, 1, 300), *np.transpose(synthetic.LATENT["latent-03"][0])), atol=1e-12)
    turned = synthetic.latent("latent-03", 1, negative=True)
    assert np.allclose(turned["close"][:234], a["close"][:234]) and turned["close"].iloc[-1] < a["close"].iloc[-1] and turned["bench_close"].iloc[-1] < a["bench_close"].iloc[-1]


def test_method_comparison(spark):
    """Metrics from distances written down by hand: the copy is first for one of two queries, its reverse nearer for the other."""
    rows = [("m", "a-0", "a-0", "", 0.1), ("m", "a-0", "a-0", "reverse", 0.9), ("m", "a-0", "a-1", "", 0.2), ("m", "a-0", "b-0", "", 0.3), ("m", "b-0", "b-0", "", 0.5), ("m", "b-0", "b-0", "reverse", 0.5), ("m", "b-0", "a-1", "", 0.2), ("m", "b-0", "a-0", "", 0.1)]
    d = spark.createDataFrame(rows, "method string, query_id string, case string, kind string, distance double").withColumns({"own": F.col("case") == F.col("query_id"), "same": F.substring("case", 1, 1) == F.substring("query_id", 1, 1)})
    got = comparison.method_metrics(d, 2).collect()[0].asDict()
    ideal = 1 + 1 / math.log2(3)
    assert got == pytest.approx({"method": "m", "queries": 2, "clone_first": 0.5, "pair_ordering": 0.5, "negative_rate": 0.5, "family_recall": (1 + 0.5) / 2, "ndcg": (1 + 0.5 / ideal) / 2})
