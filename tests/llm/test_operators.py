"""Each operator on awkward rows, and against a plain version of itself."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from recurra.llm import (
    bytewise, components, decontamination, exact_dedup, language_id, line_dedup, mixing, near_dedup, sharding, token_counts, toxicity, url_filter,
)

random.seed(3)
WORDS = [a + b for a in "ba ke lo mi nu".split() for b in "s t r n l".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size int, row int, bucket int, verdict string"


def text(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = text(60_000)
BASE = text(80)
DOCS = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "one two", "en", "b"), (4, "One\x0bTWO", "de", None), (5, BASE, "en", "a"), (6, BASE + "  ", "fr", "b"),
    (7, BASE + " zz yy", "en", "a"), (8, BASE.replace(" ", "\n"), "en", "c"), (9, text(90), "de", "a"), (9, text(0), "de", "a"), (10, LONG, "en", "a"), (10, LONG, "en", "a"), (None, BASE, None, "a"),
    (11, "日本語 été ñandú 🙂", "fr", "c"), (12, BASE, "en", "a"), (-5, "\x00 a\x00b", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 0, 0.5, True, 1, 2, 3, "x") for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (9, 0, 0), (9, 1, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def split(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def test_words_and_shingles_by_hand():
    for table, cut in ((bytewise.NOT_SPACE, split), (bytewise.ALPHANUMERIC, lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).encode().split())):
        column = pa.array([d[1] for d in DOCS[:9]] + ["ab", "cd"])
        got = []
        for _, data, starts, stops, hashes, rows in bytewise.texts_words(column, table):
            got += [[data[s:e].tobytes() for s, e in zip(starts[a:b], stops[a:b])] for a, b in zip(rows[:-1], rows[1:])]
            assert len({h: None for h in hashes.tolist()}) == len({data[s:e].tobytes() for s, e in zip(starts, stops)})
        assert got == [[w.lower() for w in cut(t)] for t in column.to_pylist()]


def drift(n: int) -> str:
    """The Thue-Morse word: it and its mirror have one hash under any polynomial modulo a power of two."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


MIRROR = str.maketrans("ab", "ba")
TWINS = [(drift(n), drift(n).translate(MIRROR)) for n in (1024, 2048, 8192)]


def test_words_that_fool_polynomial_hashes():
    for x, y in TWINS:
        for _, _, _, _, hashes, _ in bytewise.texts_words(pa.array([f"{x} {y}"])):
            assert hashes[0] != hashes[1]


def test_word_classes_go_by_bytes(monkeypatch):
    """Also when different words have one hash."""
    import numpy as np

    monkeypatch.setattr(bytewise, "word_hashes", lambda data, starts, stops: (stops - starts).astype(np.uint64) % 2)
    words = ["a", "b", "ccc", "a", "b", "z" * 70, "y" * 70, "z" * 70, "ccc", "z" * 69 + "q", "ab" * 8, "ab" * 7 + "ac"]
    data, ends = np.frombuffer(" ".join(words).encode(), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    first, which = bytewise.word_classes(data, starts, ends)
    assert [words[first[k]] for k in which] == words and len(set(which.tolist())) == len(set(words))


def test_exact_sets_are_sets_of_word_sequences():
    texts = [d[1] for d in DOCS[:9]] + [f"{a} {b} x y z" for a, b in TWINS] + [f"{b} {a} x y z" for a, b in TWINS]
    sets = near_dedup.exact_sets(pa.array(texts[:4]), pa.array(texts[4:]))
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            plain = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ([q.lower() for q in split(t)] for t in (a, b))]
            assert len(set(x.tolist()) & set(y.tolist())) == len(plain[0] & plain[1])


def test_near_dedup_compares_words(spark):
    rows = [(10 * i + j, t) for i, (x, y) in enumerate(TWINS) for j, t in enumerate((f"{x} p q r s", f"{y} p q r s", x, y))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows}


def test_mixing(docs, labels, empty):
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(DOCS) and sorted(r["size"] for r in rows) == sorted(len(split(d[1])) for d in DOCS)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    for own in by.values():
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty, labels).columns == empty.columns
    assert Counter(r["doc_id"] for r in mixing.mixed(docs, labels).collect()) == Counter(r["doc_id"] for r in mixing.mixed(docs, labels).collect())
    ties = docs.sparkSession.createDataFrame([(None if i % 2 else 7, text(1 + i % 9), "ab"[i % 7 > 1]) for i in range(200)], "doc_id long, text string, source string")
    once, again = (Counter((r["source"], r["text"], r["doc_id"]) for r in mixing.mixed(ties.repartition(n, "text")).collect()) for n in (3, 5))
    assert once == again and len({t for _, t, _ in once}) > 60


def test_targets_by_resharing(spark):
    sizes = {"a": 5, "b": 1000, "c": 7, "d": 0, None: 300}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names, total = sorted((s for s in sizes if s), key=str) + [None], sum(sizes.values())
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(target)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(DOCS)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in DOCS)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert sharding.shard(empty, 40).count() == 0 and {r["shard"] for r in sharding.shard(docs.limit(1), 40).collect()} <= set(range(40))


def plain_tree(points: list, shards: int, first: int, out: dict) -> None:
    """All points of a node in one list: the widest axis, sorted by (step, hash), cut at the group border nearest to the weighted median."""
    if shards == 1 or not points:
        return out.update({p["group"]: first for p in points})
    width = {a: max(p[a] for p in points) - min(p[a] for p in points) for a in sharding.AXES}
    axis = max(sharding.AXES, key=lambda a: (width[a], -sharding.AXES.index(a)))
    points.sort(key=lambda p: (p[axis], p["fine"]))
    want = sum(p["bytes"] for p in points) * (shards // 2) / shards
    at, before = 0, 0
    while at < len(points) - 1 and before + points[at]["bytes"] <= want:
        before += points[at]["bytes"]
        at += 1
    at += want - before > points[at]["bytes"] / 2
    plain_tree(points[:at], shards // 2, first, out)
    plain_tree(points[at:], shards - shards // 2, first + shards // 2, out)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_kd_tree_against_plain_recursion(spark, shards):
    rows = [(i, text(random.randrange(4, 60)), random.choice(["en", "fr", None]), random.choice("abcde")) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1], "de", "f") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    points = sharding.points_of(docs.select("doc_id", "lang", "source", sharding.size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("group"))).collect()
    assert len({p["fine"] for p in points}) == len(points) == 300
    want: dict = {}
    plain_tree(points, shards, 0, want)
    texts = {r["text"]: r["g"] for r in docs.select("text", F.xxhash64("text").alias("g")).collect()}
    by_id = {r[0]: want[texts[r[1]]] for r in rows}
    got = sharding.shard(docs, shards).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == by_id
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    heaviest = max(p["bytes"] for p in points)
    assert all(abs(sizes[k] - sum(sizes.values()) / shards) <= 4 * heaviest for k in range(shards))


def test_exact_dedup(spark, docs, empty):
    norm = lambda t: "".join(c for c in (t or "") if c not in "\x20\t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for d in DOCS:
        groups[norm(d[1])].append(d)
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_classes(docs).collect()}
    edge = [((1 << 63) - 1, "a b"), (None, "ab"), (-(1 << 63), "c"), (None, "c d "), (None, "cd"), ((1 << 63) - 1, "c")]
    got_edge = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_classes(spark.createDataFrame(edge, "doc_id long, text string")).collect()}
    top = (1 << 63) - 1
    assert got_edge == {(top, top, 2), (None, top, 2), (-top - 1, -top - 1, 2), (top, -top - 1, 2), (None, None, 2)}
    for content, own in groups.items():
        best = min(own, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))[0]
        for d in own:
            assert got[d[0], hashlib.sha256(content.encode()).hexdigest()] == (best, len(own))
    assert exact_dedup.exact_classes(empty).count() == 0 and exact_dedup.exact_dedup(docs).columns == docs.columns


def near_by_hand(rows: list[tuple]) -> dict:
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in split(t)]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top, changed = {d: d for d in sets}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    return {d: (len(sets[d]), top[d]) for d in sets}


def test_near_dedup(spark, docs, empty):
    rows = near_dedup.near_classes(docs).collect()
    assert len(rows) == len(DOCS)
    plain = near_by_hand([(d[0], d[1]) for d in DOCS if d[0] is not None and d[0] != 9 and d[0] != 10])
    for r in rows:
        if r["doc_id"] in plain:
            assert (r["n_shingles"], r["component_id"]) == plain[r["doc_id"]], r
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.near_dedup(docs).columns == docs.columns
    # rows that share an id, or have none: each text is in its own class
    by_text = near_by_hand([(i, t) for i, t in enumerate(sorted({d[1] or "" for d in DOCS}))])
    ids = defaultdict(list)
    for i, t in enumerate(sorted({d[1] or "" for d in DOCS})):
        ids[by_text[i][1] if by_text[i][0] else -1 - i] += [d[0] for d in DOCS if (d[1] or "") == t]
    want = Counter((d, min((x for x in own if x is not None), default=None) if k >= 0 else d) for k, own in ids.items() for d in own)
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == sum(len(own) if k < 0 else 1 for k, own in ids.items())


def test_near_dedup_finds_chains_of_edits(spark):
    """Copies that drift: neighbours are linked, ends are not, so pivots alone don't join them."""
    rows, words = [], text(150).split()
    for i in range(120):
        rows.append((i, " ".join(words)))
        words[random.randrange(150)] = f"w{i}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_hand(rows)


def test_superminhash_estimates():
    import numpy as np

    a, b = np.arange(0, 400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    x = near_dedup.superminhash([bytewise.mix(a), bytewise.mix(b), a[:0], bytewise.mix(a[:3])])
    assert abs((x[0] == x[1]).mean() - 0.6) < 0.15 and np.isinf(x[2]).all() and np.isfinite(x[3]).all()
    alone = near_dedup.superminhash([bytewise.mix(a[:3])])
    assert (alone[0] == x[3]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_decontamination(spark, docs, empty):
    passage = text(20)
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "!!"), (4, "one two"), (5, passage)], "item_id long, text string")
    some = docs.unionByName(spark.createDataFrame([(50, "a " + passage + " b", None, None, 0, 0.0, True, 1, 1, 1, "")], SCHEMA))
    got = {r["doc_id"]: r for r in decontamination.contamination(some, bench).collect()}
    assert (got[50]["n_words"], got[50]["n_hit"], got[50]["n_items"], got[50]["contaminated"]) == (22, 20, 2, True)
    assert got[50]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest() and got[3]["contaminated"] and got[4]["contaminated"]
    assert got[0]["n_words"] == 0 and not got[0]["contaminated"] and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert Counter(decontamination.contamination(some, bench, block_bytes=80).collect()) == Counter(decontamination.contamination(some, bench).collect())
    nobody = some.where("doc_id = 50").select("doc_id", "text").unionAll(spark.createDataFrame([(51, passage[:60])], "doc_id long, text string"))
    many = spark.createDataFrame([(i, passage) for i in range(30)] + [(None, passage[3:])], "item_id long, text string")
    both = [sorted(map(tuple, decontamination.contamination(nobody, many, block_bytes=n).collect())) for n in (1 << 20, 0)]
    assert both[0] == both[1] and both[0][0][2:4] == (20, 30)
    assert {r["doc_id"] for r in decontamination.decontaminate(some, bench).collect()} == {k for k, r in got.items() if not r["contaminated"]}
    for size in (decontamination.BLOCK_BYTES, 80):
        cut = {r["doc_id"]: r["text"] for r in decontamination.without_spans(some, bench, size).collect()}
        assert cut[50] == "a  b" and cut[3] == "" and cut[5] == BASE
    assert decontamination.contamination(empty, bench).count() == 0 and not any(r["contaminated"] for r in decontamination.contamination(some, bench.where("false")).collect())


def test_toxicity_edges(spark, docs, labels, empty):
    rows = toxicity.score(docs.select("doc_id", "text"), labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert toxicity.score(empty, labels.where("false")).count() == 0 and toxicity.reject(docs, labels).columns == docs.columns


def test_toxicity_learns_misspellings_and_quotation(spark):
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = text(60).split()
        for _ in range(3 if bad else 0):
            words.insert(random.randrange(60), random.choice(["scoundrel", "wretch"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    plain = text(40)
    rows += [(9000, plain + " skoundrel wretsh scoundral " + plain), (9001, plain), (9002, f'{plain} he said the word "scoundrel" was used {plain}'), (9003, f"{plain} you scoundrel you wretch {plain}"), (9004, f"{plain} he used you scoundrel then {plain}")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(900))
    assert got[9000]["predicted"] == 1 and got[9001]["predicted"] == 0 and got[9002]["predicted"] == 0 and got[9003]["predicted"] == 1
    assert got[9004]["score"] > got[9002]["score"]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_machines_are_exact(monkeypatch):
    """Of all terms within reach, the one of fewest edits, then the first; edits are of characters."""
    import numpy as np

    monkeypatch.setattr(toxicity, "TERMS", 2)
    terms = [("abca", True), ("bcb", True), ("cabcabca", False), ("éaßé", True), ("日本語日", False)]
    machines = toxicity.Machines(terms)
    words = ["".join(random.choice(random.choice(("abcd", "éßaa", "日本語b"))) for _ in range(random.randint(1, 11))) for _ in range(6000)]
    words += ["éaßx", "eaßé", "日本語", "日本x日b", "éaaé"]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    hit, fate = machines.run(points, stops - [len(w) for w in words], stops)
    found = dict(zip(hit.tolist(), zip((fate % 3).tolist(), (fate // 3).tolist())))
    for i, w in enumerate(words):
        assert found.get(i) == plain_hit(w, terms), w
    assert len(machines.parts) == 3 and len(found) > 60


def plain_hit(word: str, terms: list[tuple[str, bool]]) -> tuple[int, int] | None:
    """(edits, term)"""
    best = []
    for i, (t, whole) in enumerate(terms):
        d = distance(word, t) if whole else min(distance(word[:k], t) for k in range(len(word) + 1))
        best += [(d, i)] if d <= toxicity.edits_of(t) else []
    return min(best, default=None)


def plain_score(t: str, terms: list[tuple[str, bool]], weights) -> float:
    """By regular expressions and a distance table; the windows one by one."""
    t = t or ""
    fold = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(toxicity.LEET), "abcdefghijklmnopqrstuvwxyz" + "".join(toxicity.LEET.values())))
    spans = [m.span() for m in re.finditer("[0-9a-z$@\u00c0-\u1fff\u3000-\U0010ffff]+", fold)]
    found = []
    for w, (a, b) in enumerate(spans):
        if hit := plain_hit(fold[a:b], terms):
            first, last = max(0, w - toxicity.CONTEXT), min(len(spans) - 1, w + toxicity.CONTEXT)
            before, after = t[max(0, spans[first][0] - 1) : a], t[b : spans[last][1] + 2]
            factor = 1.0
            if any(q in before for q in toxicity.QUOTES) and any(q in after for q in toxicity.QUOTES):
                factor = toxicity.QUOTED
            elif any(t[c:d].lower() in toxicity.REPORTING for c, d in spans[first:w]):
                factor = toxicity.REPORTED
            found.append((w, weights.hit[hit[1], min(hit[0], 1)] * factor))
    n = len(spans)
    best = sum(x for _, x in found) - weights.word * n
    for last in range(n if found else 0):
        inside = sum(x for p, x in found if last - toxicity.SCORED < p <= last)
        if any(p == last for p, _ in found):
            best = max(best, inside - weights.word * min(toxicity.SCORED, n) - math.log(max(1.0, n / toxicity.SCORED)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights.prior + best))))


def test_scores_against_a_plain_version():
    import numpy as np

    terms = [("clown", True), ("scoundrel", False), ("wretch", True), ("éhonté", True)]
    weights = toxicity.Weights(np.array([[5.0, 2.0], [4.0, 1.0], [3.0, 1.5], [6.0, 2.5]]), 0.05, -2.0)
    texts = [d[1] for d in DOCS[:10]] + ["", "clown", 'He said: you cl0wn, "wretch" and', "«scoundrels» « clown »", "ehonté ÉHONTÉ éhonté éhontà", "the word, clown!", "sc0undr3ly $coundrel wreth"]
    for _ in range(60):
        words = text(random.choice((5, 40, 200))).split()
        for _ in range(random.randrange(6)):
            words.insert(random.randrange(len(words)), random.choice(["clown", "clwn", "scoundrelly", "skoundrel", "wretch,", '"wretch"', "said:", "éhonte", '"', "zitat", "“", "”"]))
        texts.append(" ".join(words))
    got = [toxicity.score_of(hits, n, weights) for n, hits in toxicity._hits(toxicity.Machines(terms), pa.array(texts))]
    assert got == pytest.approx([plain_score(t, terms, weights) for t in texts])


def test_long_words_have_nodes_at_all_lengths():
    w = "x" * 1000
    own = toxicity.heads(w)
    assert own[:16] == [w[:k] for k in range(1, 17)] and own[-1] == w and all(len(b) <= 1.5 * len(a) + 1 for a, b in zip(own[16:], own[17:]))
    assert toxicity.heads("ab") == ["a", "ab"]


CLASH = ["__row", "row", "score", "predicted", "held_out", "n_words", "contaminated", "__copies", "__time", "copies", "own", "places", "kept", "quality", "size", "key", "Score"]


def test_columns_with_clashing_names_keep_their_values(spark):
    """Every operator that returns documents returns their columns as they were: names, types, values."""
    kinds = ["string", "int", "double", "boolean"]
    names = [c for c in CLASH if c != "Score"]
    value = lambda i, j: (f"v{i}.{j}", 100 * i + j, i + j / 8, bool(i % 2))[j % 4]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "a", *[value(i, j) for j in range(len(names))]) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id int", "text string", "source string", *[f"`{c}` {kinds[j % 4]}" for j, c in enumerate(names)]]))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "not there at all")], "item_id long, text string")
    outs = [toxicity.reject(docs, labels), exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), line_dedup.dedup_lines(docs), mixing.mixed(docs, labels)]
    for size in (decontamination.BLOCK_BYTES, 0):
        outs += [decontamination.decontaminate(docs, bench, size), decontamination.without_spans(docs, bench, size)]
    for out in outs:
        assert out.schema == docs.schema and sorted(tuple(r) for r in out.collect()) == sorted(rows)


def test_language_id(spark, docs, empty):
    make = lambda kind: " ".join(random.choice(kind) + random.choice(kind) for _ in range(40))
    kinds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["ße", "ung", "sch", "ei"], "zz": ["que", "oi", "aux", "tre"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * 150)]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i]["lang_pred"] == k for i, _, k in rows if out[i]["held_out"]) >= 0.97 * sum(r["held_out"] for r in out.values())
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    odd = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[11]["lang_pred"] != "und"
    assert language_id.identify(empty).count() == 0


def test_scoring_runs_the_trained_network():
    """positions() on frozen weights, chunks of unequal length, against the network that is trained."""
    import numpy as np

    draw = np.random.default_rng(3)
    net = language_id.BiGRU(4, hidden=5, seed=2)
    lengths = [7, 1, 4, 7, 3]
    chunks = [draw.integers(0, 256, n) for n in lengths]
    data, valid = np.full((7, 5), 32), np.zeros((7, 5), np.float32)
    for i, c in enumerate(chunks):
        data[: len(c), i], valid[: len(c), i] = c, 1
    got = language_id.positions(net.frozen(), data, valid)
    for i, c in enumerate(chunks):
        both = np.concatenate([net._run(c[:, None], d)[0] for d in "fb"], axis=2)[:, 0]
        logits = both @ net.w["out"] + net.w["bias"]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        assert got[i] == pytest.approx(p.sum(axis=0), rel=1e-4)


def test_predictions_pool_all_positions():
    """A text's probabilities are means over its bytes, however it is cut into chunks."""
    import numpy as np

    net = language_id.BiGRU(3, hidden=4, seed=5)
    texts = ["x" * 200, "été à la plage " * 30, "", None, "12 34", "ab"]
    labels, scores = language_id.predict(net.frozen(), pa.array(texts), ["a", "b", "c"])
    for t, label, score in zip(texts, labels, scores):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        total = np.zeros(3)
        for at in range(0, len(raw), language_id.CHUNK):
            both = np.concatenate([net._run(raw[at : at + language_id.CHUNK, None], d)[0] for d in "fb"], axis=2)[:, 0]
            e = np.exp(both @ net.w["out"] + net.w["bias"])
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        if any(c.isalpha() for c in t or ""):
            assert label == "abc"[total.argmax()] and score == pytest.approx(total.max() / len(raw), rel=1e-4)
        else:
            assert (label, score) == ("und", 0.0)


def test_gradients_by_differences():
    import numpy as np

    net = language_id.BiGRU(3, hidden=3, seed=1)
    data, label = np.random.default_rng(0).integers(0, 256, (5, 4)), np.random.default_rng(1).integers(0, 3, (5, 4))
    _, grad = net.gradients(data, label)
    for k, w in net.w.items():
        at = tuple(np.argwhere(np.abs(grad[k]) > 0)[0])
        old = w[at]
        w[at] = old + 1e-6
        up = net.gradients(data, label)[0]
        w[at] = old - 1e-6
        down = net.gradients(data, label)[0]
        w[at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7), k


def test_token_counts(docs, empty):
    scores = token_counts.pieces()

    def best(w: bytes) -> int:
        w, rows = b" " + w, [(0, 0)]
        for e in range(1, len(w) + 1):
            rows.append(max([(rows[e - 1][0] + token_counts.BYTE, rows[e - 1][1] - 1), *[(rows[s][0] + scores[w[s:e]], rows[s][1] - 1) for s in range(max(0, e - token_counts.LONGEST), e) if w[s:e] in scores]]))
        return -rows[-1][1]

    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect())
    known: dict[bytes, int] = {}
    count = lambda t: sum(known.setdefault(w, best(w)) if w not in known else known[w] for w in split(t))
    assert got == Counter((d[0], len(split(d[1])), count(d[1])) for d in DOCS)
    assert token_counts.token_counts(empty).count() == 0


def mutant(line: str, edits: int, letters: str = "abc") -> str:
    t = list(line)
    for _ in range(edits):
        at, kind = random.randrange(len(t) + 1), random.randrange(3)
        t[at : at + (kind > 0)] = [random.choice(letters)] * (kind < 2)
    return "".join(t)


def test_edit_distance_and_keys(monkeypatch):
    """Pairs are linked as a plain distance says, and every linked pair has a key in common."""
    import numpy as np

    monkeypatch.setattr(line_dedup, "EDITS", ((2, 1), (5, 2), (8, 3), (11, 4)))
    pairs = [(a, mutant(a, random.randrange(6))) for a in ("".join(random.choices("abc", k=random.randrange(19))) for _ in range(3000))]
    most = line_dedup.allowed(np.array([min(len(a), len(b)) for a, b in pairs]))
    want = [distance(a, b) <= m for (a, b), m in zip(pairs, most)]
    at = np.arange(len(pairs))
    assert line_dedup.within(*line_dedup._points([x for p in pairs for x in p]), 2 * at, 2 * at + 1).tolist() == want and 500 < sum(want) < 2900
    for (a, b), linked in zip(pairs, want):
        if linked and a != b:
            own = [[set(), set()], [set(), set()]]
            for keys, who, indexed in line_dedup.keys_of([a, b]):
                for k, w in zip(keys.tolist(), who.tolist()):
                    own[w][indexed].add(k)
            assert own[0][1] & (own[1][0] | own[1][1]) or own[1][1] & own[0][0], (a, b)


def test_meeting_reads_buckets_over_batches(monkeypatch):
    """Whatever the batches are cut into: rows of keys with an indexed line and another line, and salted rows."""
    import numpy as np

    monkeypatch.setattr(line_dedup, "PACKED", 3)
    salted = lambda k, r: int(line_dedup._salted(np.array([k]), np.array([r]))[0])
    runs, alone, want = [], defaultdict(set), set()
    for _ in range(12):
        rows: tuple[list, list] = ([], [])
        for key in range(0, 120, 2):
            for _ in range(random.randrange(3)):
                probe, ref = random.randrange(2), random.randrange(2, 5)
                if key % 10 == 0 and random.random() < 0.5:
                    rows[probe].append((salted(key, ref), ref | line_dedup.SALTED))
                    for side in (0, 1):
                        rows[side].append((key, line_dedup.NOBODY + side))
                        alone[key].add((side, line_dedup.NOBODY + side))
                    want.add((key, ref, not probe))
                elif random.random() < 0.2:
                    rows[probe].append((key, ref))
                    alone[key].add((probe, ref))
        for side in (0, 1):
            k, r = (np.array([x[i] for x in rows[side]], np.int64) for i in (0, 1))
            runs += line_dedup._packed((k.view(np.uint64) >> np.uint64(2)).astype(np.int64) % 5, k, r, bool(side)).to_pylist()
    for key, own in alone.items():
        if min(own)[0] == 0 and len({r for _, r in own}) > 1:
            want |= {(key, r, not p) for p, r in own if r > 1}
    needed = lambda found: {x for x in found if x[2] or (x[0], x[1], True) not in found}  # noqa: E731  an indexed line's probe adds no pair
    runs.sort(key=lambda r: (r["bucket"], r["probe"]))
    schema = pa.schema([("bucket", pa.int32()), ("probe", pa.bool_()), ("pairs", pa.binary())])
    for n in (1, 2, 3, 7, len(runs)):
        batches = [pa.RecordBatch.from_pylist(runs[i : i + n], schema) for i in range(0, len(runs), n)]
        assert {tuple(r.values()) for b in line_dedup._meeting(iter(batches)) for r in b.to_pylist()} <= want, n
        assert needed({tuple(r.values()) for b in line_dedup._meeting(iter(batches)) for r in b.to_pylist()}) == needed(want), n


@pytest.mark.parametrize("crowd", [1000, 4])
def test_line_dedup(spark, docs, empty, crowd, monkeypatch):
    """Against all pairs of lines. With small cells, large keys are dealt over several; the classes are the same."""
    for name in ("PER_BLOCK", "LOCAL", "PER_BUCKET"):
        monkeypatch.setattr(line_dedup, name, crowd)
    line, rows = text(30), []
    for i in range(40):
        t = [text(8), mutant(line, random.randrange(3), "xyz"), "short", text(9)[:-1] if i % 2 else line, mutant("a short line", 1), mutant(text(16) if i % 7 else BASE, i % 5), *[w[i % 2] for w in TWINS]]
        rows.append((i if i > 3 else None, "\n".join(t)))
    rows += [rows[9], rows[0]]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    lines = sorted({x.strip() for _, t in rows for x in t.split("\n")})
    top = {x: x for x in lines}
    limit = lambda n: max([e for least, e in line_dedup.EDITS if n >= least], default=0)
    links = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= (m := limit(min(len(a), len(b)))) and max(len(a), len(b)) < 999 and distance(a, b) <= m]
    for _ in range(len(lines)):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert len(links) > 100 and len(set(top.values())) < len(lines) - 20
    # rows with one doc_id are in no given order: of those only the numbers are compared
    seen, dropped = set(), Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        places = [p for p, x in enumerate(t.split("\n")) if top[x.strip()] in seen or seen.add(top[x.strip()])]
        dropped[d] += len(places)
        if d is not None and d != 9:
            own = [r for r in got if r["doc_id"] == d]
            assert len(own) == 1 and own[0]["dropped_sha256"] == hashlib.sha256(",".join(map(str, places)).encode()).hexdigest() and own[0]["n_lines"] == 9
    assert Counter({d: sum(r["n_dropped"] for r in got if r["doc_id"] == d) for d in dropped}) == dropped and len(got) == len(rows)
    awkward = line_dedup.line_report(docs).collect()
    assert Counter(r["doc_id"] for r in awkward) == Counter(d[0] for d in DOCS) and line_dedup.line_report(empty).count() == 0
    assert {r["n_lines"] for r in awkward if r["doc_id"] in (0, 1, 2)} == {0}
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(DOCS) and out[0].__fields__ == docs.columns and all((r["score"], r["kept"], r["size"], r["row"], r["bucket"], r["verdict"]) == (0.5, True, 1, 2, 3, "x") for r in out)
    left = Counter((r["doc_id"], r["text"]) for r in out)
    assert left[0, None] == 1 and left[11, DOCS[14][1]] == 1 and sum(n for (_, t), n in left.items() if t and BASE in t) == 2 and sum(n for (_, t), n in left.items() if t == LONG) == 1


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "https://b.example.org/en/1299?q#f", "x://example.org/en/2", "x://notexample.org", "x://casino-win.example.net/p", "x://casino-win.example.org/p", "x://a.com/fr/", "x://a.com/de/1", "x://a.com?x=/de/", "http://a://b/c", "x://www.Best-Poker.net", "x://best-pokers.net"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    for size in (url_filter.FILE_BYTES, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, file_bytes=size).collect()}
        assert [got[i] for i in range(4)] == [("", "", None, "allow")] * 4
        assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[5] == ("b.example.org", "/en/1299", "example.org/en/1", "block")
        assert got[6][2:] == ("org/", "allow") and got[7] == ("notexample.org", "", None, "allow") and got[8][2:] == (None, "block") and got[9][2:] == ("org/", "allow")
        assert got[10][2:] == ("com/fr/", "allow") and got[11][2:] == ("com/de/", "block") and got[12] == ("a.com", "", None, "allow") and got[13] == ("a:", "//b/c", None, "allow")
        assert got[14][3] == "block" and got[15][3] == "allow"
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_url_filter_with_lists_from_tables(spark):
    """Against a plain loop over all entries, sent and joined; an empty list blocks nothing."""
    parts = ["a", "b", "org", "net", "x-y"]
    hosts = [".".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(60)]
    paths = ["", *["/" + "/".join(random.choices(["p", "q", "pq"], k=random.randint(1, 3))) for _ in range(30)]]
    urls = [(i, f"http://{random.choice(hosts)}{random.choice(paths)}") for i in range(400)]
    rules = list({(h, p): (h, p, random.choice(("allow", "block"))) for h, p in ((random.choice(hosts[:20]), random.choice(paths)) for _ in range(25))}.values())
    entries = [random.choice(hosts[20:]) + random.choice(paths) for _ in range(15)] + ["x-y.*"]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    fits = lambda e, h, p: e[:-2] in h.split(".") if e.endswith(".*") else (h == e.split("/")[0] or h.endswith("." + e.split("/")[0])) and p.startswith(e[len(e.split("/")[0]) :])
    want = {}
    for i, u in urls:
        rest = u.split("://")[1]
        host, path = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        rule = max(((len(h + p), h + p, v) for h, p, v in rules if fits(h + p, host, path)), default=None)
        want[i] = (rule and rule[1], rule[2] if rule else "block" if any(fits(e, host, path) for e in entries) else "allow")
    lists = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(e,) for e in entries], "entry string")
    for own, block, size in ((rules, entries, 1 << 20), (*lists, 1 << 20), (*lists, 0)):
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, own, block, size).collect()} == want
    assert {v for _, v in want.values()} == {"allow", "block"} and {r["verdict"] for r in url_filter.filter_urls(pages, (), ()).collect()} == {"allow"}


def contaminated_by_hand(rows: list[tuple], items: list[str]) -> set[int]:
    cut = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split(" ")
    words = lambda t: [w for w in cut(t) if w]
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = set()
    for d, t in rows:
        w = words(t)
        hit = {p for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for p in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_pipeline_against_plain_stages(spark):
    """Every stage on what the one before kept, each against a plain version; toxicity against its own scores."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, outs = frame.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in frame.collect()]
        frame = near_dedup.written(stage(spark, frame, folder), "test-stage")
        outs.append((name, before, frame))
        assert name == "sharding" or frame.columns == columns
    kept = [{r["doc_id"] for r in f.collect()} for _, _, f in outs]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), labels).collect()
    assert kept[0] == {r["doc_id"] for r in scores if r["predicted"] == 0}
    classes = near_by_hand(outs[1][1])
    assert kept[1] == {d for d, (_, top) in classes.items() if d == top}
    bench = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert kept[2] == {d for d, _ in outs[2][1]} - contaminated_by_hand(outs[2][1], bench)
    mixed = Counter(r["doc_id"] for r in outs[3][2].collect())
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(outs[2][2], labels).collect() if r["copies"]})
    assert mixed == want
    final = outs[4][2].collect()
    assert Counter(r["doc_id"] for r in final) == mixed and {r["shard"] for r in final} <= set(range(40))
