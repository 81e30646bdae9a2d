"""Kernels against scalar versions, exact search against brute force, causality and invariance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recurra.functions import features as X
from recurra.functions import kernels as K
from recurra.functions import states
from recurra.operators import clustering, outcomes, scoring
from recurra.operators import search as S
from recurra.plans.features import episode_rows
from recurra.sources import synthetic
from recurra.sources.bars import canonical, positions, prefix_digest

N = 260


@pytest.fixture(scope="module")
def frame() -> pd.DataFrame:
    return pd.concat([synthetic.case(f, s, N) for f in synthetic.FAMILIES for s in range(2)], ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame).withColumn("volume", F.col("volume").cast("double")).persist()


@pytest.fixture(scope="module")
def market(spark):
    return spark.createDataFrame(synthetic.case("vee", 99, N)).withColumn("symbol", F.lit("M"))


def scalar_dtw(x: np.ndarray, y: np.ndarray, band: int) -> float:
    n = len(x)
    table = {(0, 0): (0.0, 0)}
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            options = [table.get(k, (np.inf, 0)) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
            best = min(range(3), key=lambda k: options[k][0])
            table[i, j] = options[best][0] + float(np.sqrt(((x[i - 1] - y[j - 1]) ** 2).mean())), options[best][1] + 1
    cost, steps = table[n, n]
    return cost / steps


def test_warping_and_its_bound():
    random = np.random.default_rng(2)
    x, y = random.normal(size=(12, 30, 2)), random.normal(size=(12, 30, 2))
    x[3] = y[3]
    got = K.dtw_pairs(x, y, 4)
    assert got == pytest.approx([scalar_dtw(a, b, 4) for a, b in zip(x, y)]) and got[3] == 0
    assert (K.lb_keogh(x, y, 4) <= got + 1e-12).all()


def test_resample_is_interpolation():
    x = np.random.default_rng(0).normal(size=(6, 41))
    x[0, :5], x[1, 7:20], x[2, -3:] = np.nan, np.nan, np.nan
    got, known = K.resample(x, 16)
    for row, out in zip(x, got):
        ok = np.flatnonzero(np.isfinite(row))
        assert out == pytest.approx(np.interp(np.linspace(0, 40, 16), np.arange(41), np.interp(np.arange(41), ok, row[ok])))
    assert known.tolist() == np.isfinite(x).sum(axis=1).tolist()


def test_swings_are_the_turns():
    path = np.cumsum(np.random.default_rng(4).normal(0, 0.03, (5, 120)), axis=1)
    for row, got in zip(path, K.swings(path)):
        for k, t in enumerate(K.THRESHOLDS):
            own = states.turns(np.exp(row), np.ones(120), t)
            assert got[3 * k] == pytest.approx(len(own) / 120) and got[3 * k + 1] == pytest.approx(np.mean([abs(e[5]) for e in own]) if own else 0)
            assert got[3 * k + 2] == pytest.approx(np.mean([e[6] for e in own]) / 120 if own else 0)


def test_channel_kernel_is_the_sql(bars, market):
    rows = episode_rows(bars, market, 63, 63)
    sql = X.dense_channels(rows).toPandas().sort_values(["episode", "step"])
    raw = rows.toPandas().sort_values(["episode", "step"])
    a = {c: raw[c].to_numpy(float).reshape(-1, 63) for c in ("open", "high", "low", "close", "volume", "bench_close")}
    got = K.channels(a["open"], a["high"], a["low"], a["close"], a["volume"], a["bench_close"])
    for name in X.CHANNELS:
        assert got[name] == pytest.approx(sql[name].to_numpy(float).reshape(-1, 63), nan_ok=True, abs=1e-7), name


def test_exact_search_is_brute_force(bars, market):
    rows = positions(X.benchmark_on(bars, market))
    request = S.Request("vee-0", lookback=63, stride=5, gap=20, top_k=6, per_symbol=2)
    store, query = S.representations(rows, request).persist(), S.query_representation(rows, request)
    ok = (F.col("pos") < 190) & (F.col("symbol") != "vee-0")
    brute = [tuple(r) for r in S.scored(store.where(ok), query, exact=True).select("distance", "episode_id", "symbol", "pos").collect()]
    want = S.greedy(brute, 6, 2, 63)
    got, proof = S.exact_search(store, query, request, ok, seed=20)
    assert [g[1] for g in got] == [w[1] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want])
    assert proof.complete and proof.candidates == len(brute) and proof.next_bound > proof.threshold
    bounds = {r["episode_id"]: r["distance"] for r in S.scored(store.where(ok), query, exact=False).collect()}
    assert all(bounds[b[1]] <= b[0] + 1e-12 for b in brute)


def test_selection_keeps_apart():
    rows = [(0.1, "a", "s", 100), (0.2, "b", "s", 120), (0.3, "c", "s", 170), (0.4, "d", "s", 300), (0.5, "e", "t", 100), (0.1, "0", "u", 5)]
    assert [r[1] for r in S.greedy(rows, 4, 2, 63)] == ["0", "a", "c", "e"]


def test_later_bars_change_nothing(spark, bars, market):
    """Features and digests up to a cutoff are the same whatever comes after."""
    cutoff = "2015-11-02"
    later = bars.withColumn("close", F.when(F.col("ts") > cutoff, F.col("close") * 3).otherwise(F.col("close"))).withColumn("high", F.when(F.col("ts") > cutoff, F.col("high") * 3).otherwise(F.col("high")))
    for f in (lambda b: X.baseline_features(b), lambda b: X.event_features(positions(b), market), lambda b: states.legs(b)):
        a, b = (f(x).where(F.col("ts") <= cutoff).orderBy("symbol", "ts").toPandas() for x in (bars, later.repartition(5)))
        pd.testing.assert_frame_equal(a, b)
    assert prefix_digest(bars, cutoff).collect().sort() == prefix_digest(later.repartition(3), cutoff).collect().sort()


def test_outcomes_by_hand(spark):
    rows = [("A", f"2020-01-{d:02d}", 10.0, 10.0 + d, 10.0 - d / 10, 10.0 + d / 2, 5.0) for d in range(1, 13)]
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["cutoff"].day, r["horizon"]): r for r in outcomes.forward(bars, (5,)).collect()}
    assert got[1, 5]["close_return"] == pytest.approx(13 / 10.5 - 1) and got[1, 5]["mfe"] == pytest.approx(16 / 10.5 - 1) and got[1, 5]["mae"] == pytest.approx(9.4 / 10.5 - 1)
    assert got[8, 5]["censored"] and not got[7, 5]["censored"]


def test_canonical_refuses_and_coerces(spark):
    with pytest.raises(ValueError):
        canonical(spark.createDataFrame([("A", 1.0)], "symbol string, close double"))
    row = canonical(spark.createDataFrame([("A", "2020-01-01", "1", "x", "NaN", "inf", "2")], "symbol string, date string, open string, high string, low string, close string, volume string")).first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (1.0, None, None, None, 2.0)


def test_medoids_and_indexes():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(0, 0.1, (6, 5)), random.normal(3, 0.1, (6, 5))])
    k, labels, sil, stable = clustering.modes(clustering.distances(x), np.ones(12))
    assert k == 2 and len(set(labels[:6])) == 1 and len(set(labels[6:])) == 1 and sil > 0.8 and stable > 0.9
    assert clustering.rand_index(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1
    cells = np.bincount(clustering.balanced_partition(random.normal(size=(64, 3)), 8))
    assert cells.min() == cells.max() == 8
    assert clustering.support_count([(20, 10), (5, 5)]) == 184756 and clustering.support_count([(100, 50)], 10**6) == 10**6


def test_statistics():
    assert scoring.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0) and scoring.binomial_two_sided(0, 10, 0.5) == pytest.approx(2 / 1024)
    assert scoring.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-3) and scoring.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-3)
    assert len(scoring.simplex(3)) == 66 and scoring.months_needed(0.1, 0.5) == 155
    b = scoring.block_bootstrap(np.random.default_rng(3).normal(-1, 1, 60), 3)
    assert b["low"] < b["mean"] < b["high"] < 0 and b["lower_p"] < 0.01


def test_acceptance(spark):
    from recurra.plans import QUERIES

    rows = QUERIES["syn_4_acceptance"](spark, "").toPandas()
    assert len(rows) == 25 and (rows["clone_rank"] == 1).all() and rows["invariance"].max() < 1e-8
    assert rows["ordered"].mean() >= 0.95 and rows["ndcg"].mean() >= 0.9 and rows["recall"].mean() >= 0.8


def test_batched_scan_is_one_query_at_a_time(bars, market):
    rows = positions(X.benchmark_on(bars, market))
    store = S.representations(rows, S.Request("vee-0", lookback=63, stride=40)).persist()
    asked = store.orderBy("episode_id").limit(3).toPandas()
    queries = {r["episode_id"]: {p: np.array([r[p]], float) for p in S.PARTS} for r in asked.to_dict("records")}
    for exact in (True, False):
        many = S.scored_many(store, queries, exact).toPandas()
        for name, q in queries.items():
            one = S.scored(store, q, exact).toPandas().set_index("episode_id")["distance"]
            got = many[many["query_id"] == name].set_index("episode_id")["distance"]
            assert got.sort_index().to_numpy() == pytest.approx(one.sort_index().to_numpy())
    store.unpersist()


# --- states: a plain version, a value at a time ---


def plain_sample(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, ok = np.linspace(0, len(x) - 1, states.POINTS), np.flatnonzero(np.isfinite(x))
    seen = np.isfinite(x)[np.rint(at).astype(int)]
    return (np.where(seen, np.interp(at, ok, x[ok]).astype(np.float32), 0) if len(ok) else np.zeros(states.POINTS)), seen


def plain_state_distance(a: dict, b: dict, horizons: dict) -> float:
    """a, b: by horizon ({channel: (values, seen)}, {summary: value or None})."""
    total = 0.0
    for h, weight in horizons.items():
        parts = []
        for name, (scale, w) in states.CHANNEL.items():
            (x, ox), (y, oy) = a[h][0][name], b[h][0][name]
            if not (ox | oy).any() or not w:
                continue
            common, apart = ox & oy, np.mean(ox != oy)
            if not common.any():
                parts.append((w, 2 + apart))
                continue
            x, y = x[common], y[common]
            if name in states.REBASED:
                x, y = x - x[0], y - y[0]
            parts.append((w, min(4.0, float(np.sqrt(np.mean(((x - y) / scale) ** 2)))) + apart))
        sums = []
        for name, (scale, w) in states.SUMMARY.items():
            x, y = a[h][1][name], b[h][1][name]
            if np.isfinite(x) or np.isfinite(y):
                sums.append((w, min(abs(x - y) / scale, 4.0) if np.isfinite(x) and np.isfinite(y) else 2.0))
        mean = lambda p: sum(w * d for w, d in p) / sum(w for w, _ in p) if p else 0.0
        total += weight * (0.68 * mean(parts) + 0.32 * mean(sums))
    return total


def plain_topology(x: np.ndarray, y: np.ndarray) -> float:
    marks, slopes = [], []
    for v in (x - x[0], y - y[0]):
        fall = [v[i] - max(v[: i + 1]) for i in range(len(v))]
        n = len(v) - 1
        marks.append(np.array([min(v) / 0.12, max(v) / 0.12, v[-1] / 0.12, np.argmin(v) / n / 0.15, np.argmin(fall) / n / 0.15, min(fall) / 0.12, (v[-1] - min(v)) / 0.12]))
        smooth = lambda k: np.array([np.mean([v[min(max(j, 0), n)] for j in range(i - k // 2, i + k // 2 + 1)]) for i in range(n + 1)])  # noqa: E731,B023
        slopes.append([np.gradient(smooth(k)) / 0.025 for k in (1, 3, 5)])
    rms = lambda p, q: min(4.0, float(np.sqrt(np.mean((p - q) ** 2))))
    return 0.25 * rms(*marks) + 0.75 * np.mean([rms(p, q) for p, q in zip(*slopes)])


def test_state_distance_by_hand(spark):
    random = np.random.default_rng(7)
    n, names = 320, ["open", "high", "low", "close", "volume", "bench_close"]
    rows = []
    for s in range(4):
        close = 50 * np.exp(np.cumsum(random.normal(0, 0.02, n)))
        open_ = close * np.exp(random.normal(0, 0.005, n))
        high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
        bench = 100 * np.exp(np.cumsum(random.normal(0, 0.01, n)))
        bench[random.random(n) < (0, 0.3, 1, 0.9)[s]] = np.nan
        rows.append(pd.DataFrame({"symbol": f"s{s}", "ts": pd.bdate_range("2015-01-01", periods=n), "pos": range(n), "open": open_, "high": high, "low": low, "close": close, "volume": np.round(1e5 * random.random(n)) + 1, "bench_close": bench}))
    frame = pd.concat(rows, ignore_index=True)
    store = states.multiresolution(spark.createDataFrame(frame), stride=68).persist()
    got = store.toPandas()
    assert len(got) == 4 * 2 * 6
    plain = {}
    for r in rows:
        for end in (251, 319):
            w = r.iloc[end - 251 : end + 1]
            a = {c: w[c].to_numpy(float)[None] for c in names}
            ch = {k: x[0] for k, x in K.channels(*[a[c] for c in names]).items()}
            own = {}
            for h in states.HORIZONS:
                close = w["close"].to_numpy()[-h:]
                tail = {k: x[-h:] for k, x in ch.items()}
                third, ret, vz = max(h // 3, 1), tail["return"], pd.Series(tail["volume_robust_z"])
                med = lambda x: pd.Series(x).median()
                early = med(tail["range_pct"][:third])
                some = lambda x: x.sum() if np.isfinite(x).any() else np.nan
                own[h] = {k: plain_sample(tail[k]) for k in states.CHANNEL}, dict(zip(states.SUMMARY, [
                    np.log(close[-1] / close[0]), min(close / np.maximum.accumulate(close) - 1), close[-1] / max(close) - 1, pd.Series(close).pipe(np.log).diff().std(), med(tail["range_pct"]), med(tail["range_pct"][-third:]) / early,
                    tail["overnight"][-1], tail["close_location"][-1], tail["atr_pct"][-1], tail["compression_ratio"][-1], vz.mean(), vz.iloc[-1], vz[ret > 0].mean() - vz[ret < 0].mean(),
                    some(pd.Series(tail["relative_return"]).dropna().to_numpy()), some(pd.Series(tail["benchmark_return"]).dropna().to_numpy()), np.isfinite(tail["benchmark_close"]).mean(), *[len(states.turns(close, np.ones(h), t)) for t in K.THRESHOLDS],
                ]))
            plain[f"{r['symbol'].iloc[0]}@{end}"] = own
    for r in got.to_dict("records"):
        channels, summary = plain[r["episode"]][r["horizon"]]
        assert np.array(r["summary"], float) == pytest.approx(np.array(list(summary.values()), float), nan_ok=True, abs=1e-9)
        for i, (values, seen) in enumerate(channels.values()):
            own = np.array(r["samples"][32 * i : 32 * i + 32], float)
            assert (np.isfinite(own) == seen).all() and own[seen] == pytest.approx(values[seen], rel=1e-5, abs=1e-6)
    asked = [tuple(r) for r in store.select("episode", "horizon", "samples", "summary").where("pos = 251").collect()]
    out = {(r["a"], r["b"]): r for r in states.state_distances(store, asked).collect()}
    assert len(out) == 4 * 8
    for (a, b), r in out.items():
        base = plain_state_distance(plain[a], plain[b], states.HORIZONS)
        path = sum(w * plain_topology(plain[a][h][0]["close_path"][0].astype(float), plain[b][h][0]["close_path"][0].astype(float)) for h, w in states.TOPOLOGY.items())
        assert r["distance"] == pytest.approx(base, rel=1e-4, abs=1e-5) and r["distance_v2"] == pytest.approx(0.8 * base + 0.2 * path, rel=1e-4, abs=1e-4)
    store.unpersist()


def test_null_selections_by_hand(spark):
    import hashlib

    windows = [(f"s{i % 4}", i // 4 * 30, f"s{i % 4}@{i // 4 * 30}") for i in range(40)]
    frame = spark.createDataFrame(windows, "symbol string, pos int, episode_id string").withColumn("cutoff", F.lit("2020-01-01").cast("timestamp"))
    got = {(r["replicate"], r["rank"]): r["episode_id"] for r in S.null_selections(frame, 3, "x", 8, 3, 63).collect()}
    for replicate in "012":
        draw = lambda e: int(hashlib.sha256(f"x|{replicate}|{e}".encode()).hexdigest()[:12], 16)  # noqa: E731,B023
        chosen: list = []
        for symbol, pos, episode in sorted(windows, key=lambda w: draw(w[2])):
            if len(chosen) < 8 and sum(c[0] == symbol for c in chosen) < 3 and all(c[0] != symbol or abs(c[1] - pos) >= 63 for c in chosen):
                chosen.append((symbol, pos, episode))
        assert [got[replicate, i + 1] for i in range(len(chosen))] == [c[2] for c in chosen]


def test_flat_vectors_go_back(bars, market):
    store = S.representations(positions(X.benchmark_on(bars, market)), S.Request("vee-0", lookback=63, stride=100))
    store = store.withColumn("s48_relative_path", F.transform("s48_relative_path", lambda _: F.lit(float("nan"))))
    flat = S.flattened(store)
    assert {len(r["vector"]) for r in flat.collect()} == {1353}
    one, two = (x.select("episode_id", *S.PARTS).toPandas().set_index("episode_id").sort_index() for x in (store, S.unflattened(flat)))
    for p in S.PARTS:
        np.testing.assert_array_equal(np.stack(one[p].to_numpy()), np.stack(two[p].to_numpy()))


def test_directory_and_long_layouts_agree(spark, tmp_path):
    from recurra.sources import stores
    from recurra.sources.bars import DatasetSpec, read

    rows = [(s, f"2020-01-{d:02d}", 1.0 + d, 2.0 + d, 0.5, 1.5 + d, 9.0) for s in ("A#1", "B C", "D%2B+") for d in range(1, 5)]
    frame = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, volume double")
    frame.write.parquet(f"{tmp_path}/long")
    stores.write_directory(frame, f"{tmp_path}/dir", "symbol")
    long, own = (sorted(map(tuple, read(spark, DatasetSpec("x", f"{tmp_path}/{k}", layout)).select("symbol", "ts", "close").collect())) for k, layout in (("long", "long_table"), ("dir", "directory")))
    assert long == own and len({r[0] for r in own}) == 3
    assert {r["symbol"] for r in read(spark, DatasetSpec("x", f"{tmp_path}/dir", "directory", benchmark="B C")).collect()} == {"A#1", "D%2B+"}


def test_generations_switch_whole(spark, tmp_path):
    from recurra.sources import stores

    root = f"{tmp_path}/gen"
    for n in (3, 5):
        stores.write_generation(spark.range(n).withColumnRenamed("id", "k"), root, "k")
        assert stores.read_active(spark, root).count() == n


def test_ranks_over_ranges(spark):
    """The order over several ranges is the order of one, with ties and running sums."""
    random = np.random.default_rng(1)
    rows = [(float(random.integers(0, 5)), f"k{i:04d}", float(random.integers(0, 9))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "p double, key string, loss double").repartition(7)
    got = sorted(tuple(r) for r in scoring.ranked(frame, [F.col("p").desc(), F.col("key")], {"total": "loss"}).select("k", "n", "total", "key").collect())
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == [(i + 1, 3000, t, r[1]) for i, (r, t) in enumerate(zip(order, np.cumsum([r[2] for r in order])))]
    bins = {r["bin"]: r["n"] for r in scoring.calibration(frame.limit(23).withColumn("hit", F.lit(1)), "p", "hit", 10, "key").collect()}
    assert bins == {i: 3 if i <= 3 else 2 for i in range(1, 11)}


def test_monthly_models_forecast_all_rows(spark):
    from recurra.operators import models

    random = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=300, freq="D")
    rows = [(f"s{i}", d.to_pydatetime(), "up" if x > 0 else "down", (d + pd.Timedelta(days=5)).to_pydatetime(), None if i == 1 and k % 3 == 0 else float(x)) for k, d in enumerate(days) for i, x in enumerate(random.normal(0, 1, 3))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, label string, completion timestamp, x double")
    months = sorted({d.to_pydatetime().replace(day=1) for d in days})
    out = models.monthly_probabilities(frame, ["x"], ("down", "up"), months).toPandas()
    assert len(out) == sum(3 for d in days if d >= pd.Timestamp("2020-02-01")) and np.allclose(out["p_up"] + out["p_down"], 1)
    known = out.merge(frame.toPandas()[["symbol", "ts", "x"]], on=["symbol", "ts"]).dropna()
    assert ((known["p_up"] > 0.5) == (known["label"] == "up")).mean() > 0.95
