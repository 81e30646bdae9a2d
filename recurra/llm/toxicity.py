"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

Learning, from the distinct lines of a bounded sample of the labelled rows outside the held-out fold: in the trie of the words' prefixes,
a node is worth c * ln(rate in toxic texts / rate in others), for its c words in toxic texts, less a fixed price for each
term that also pays for the number of nodes looked at. The lexicon is the best cut: a node is a term if it is worth
more than the best terms below it. It is a whole word if words mostly end there, else a stem that any ending may
follow. A misspelling's rate in toxic texts is taken as a share of the right spelling's, its rate elsewhere is counted.

Scoring: the trie of each TERMS terms of the lexicon is intersected with their Levenshtein automata (one edit from 4
characters, two from 8) and the product made deterministic, once, on the driver. All words of a batch then run through
its table together, a character at a time, until they fall out. A hit adds the logarithm of its rates' ratio, less with
quotation marks on both sides or a word of reporting near it; words without a hit speak against. The score is the higher
of the whole text's and its best window's, the latter after a deduction for the number of windows.

Defined results: a null, empty or wordless text has the base score or less and is not toxic; without toxic labels the lexicon is
empty and all texts have the base score; a doc_id with several labels is toxic if one says so; repeated rows each
return a row; rows with a null doc_id are scored, not learned from; an empty table gives no rows. score() replaces columns
of docs called held_out, score or predicted; reject() leaves all columns as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.bytewise import LOWER, batches as byte_batches, word_bounds
from recurra.llm.storage import aside, written

#: The bound of the training sample: about so many labelled documents of each class, chosen by hash.
SAMPLE = {1: 4000, 0: 8000}
THRESHOLD, MISSPELT = 0.7, 0.05
#: Characters up to which each prefix of a word is a node of the trie; from there on, nodes are half as far apart as long.
DENSE = 16
#: Words that each term is taken to have in other texts besides those seen; toxic lines that a term is in at least.
FLOOR, LEAST = 4.0, 3
#: Terms whose automata are multiplied; more terms run through several machines.
TERMS = 24
#: Words in a window that is scored by itself.
SCORED = 60
#: Words on each side that make the context window, and what a hit's weight is multiplied by.
CONTEXT, QUOTED, REPORTED = 8, 0.25, 0.6
QUOTES = ('"', "«", "»", "“", "”", "„")
#: Words of reporting, in four languages.
REPORTING = ("said", "says", "called", "quote", "quoted", "word", "term", "sagte", "nannte", "zitat", "wort", "dit", "appelait", "citation", "mot", "dijo", "cita", "palabra")
#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}
#: Code points from here on are all letters; of those below, ASCII letters, digits and two signs, and all but two blocks of signs.
HIGH = 0x3000
WORD = np.ones(HIGH + 1, bool)
WORD[:0xC0] = WORD[0x2000:HIGH] = False
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x24, 0x40]] = True
FOLD = LOWER.copy()
for _a, _b in LEET.items():
    FOLD[ord(_a)] = ord(_b)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def edits_of(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """The deterministic product of the terms' Levenshtein automata with their trie. terms: (characters, whole word)."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        reach = [0]  # edits that some term below a node allows
        for i, (term, _) in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], edits_of(term))
            for c in map(ord, term):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], edits_of(term))
            ends[node].append(i)
        self.letters = sorted({ord(c) for term, _ in terms for c in term})
        codes = [*self.letters, -1]

        def closed(pairs: dict[int, int]) -> tuple[frozenset, dict[int, int]]:
            """With skipped letters of terms; and the stems that are complete, with their edits."""
            stack = list(pairs)
            while stack:
                node = stack.pop()
                for child in children[node].values():
                    e = pairs[node] + 1
                    if e <= reach[child] and e < pairs.get(child, 9):
                        pairs[child] = e
                        stack.append(child)
            return frozenset(pairs.items()), {}

        def fitting(state: frozenset, whole: bool) -> tuple[int, int] | None:
            """(edits, term) of the best complete term."""
            return min(((e, i) for node, e in state for i in ends[node] if terms[i][1] == whole and e <= edits_of(terms[i][0])), default=None)

        start = (closed({0: 0})[0], None)
        number, rows, self.accept = {start: 1}, [np.zeros(len(codes), np.int32)], [None]
        todo = [start]
        self.accept.append(None)
        while todo:
            state, best = todo.pop(0)
            row = np.zeros(len(codes), np.int32)
            for k, c in enumerate(codes):
                new: dict[int, int] = {}
                for node, e in state:
                    if e < reach[node] and e + 1 < new.get(node, 9):
                        new[node] = e + 1  # a letter too many
                    for letter, child in children[node].items():
                        cost = e + (letter != c)
                        if cost <= reach[child] and cost < new.get(child, 9):
                            new[child] = cost
                after = closed(new)[0]
                stem = min((x for x in (best, fitting(after, False)) if x is not None), default=None)
                nxt = (after, stem)
                if not after and stem is None:
                    continue
                if nxt not in number:
                    number[nxt] = len(number) + 1
                    todo.append(nxt)
                    self.accept.append(min((x for x in (stem, fitting(after, True)) if x is not None), default=None))
                row[k] = number[nxt]
            rows.append(row)
        self.table = np.array(rows)
        self.fate = np.array([-1 if a is None else a[1] * 3 + a[0] for a in self.accept])
        self.settled = np.array([True, *[not s for s, _ in number]])  # nothing can change any more

    def run(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that fit a term, and term * 3 + edits of each."""
        if not self.terms or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.array([*self.letters, 1 << 32], np.uint64)
        kind = np.arange(HIGH + 1)
        kind = np.where(known[np.searchsorted(known, kind)] == kind, np.searchsorted(known, kind), len(self.letters)).astype(np.int32)[np.minimum(points, HIGH)]
        if (high := np.flatnonzero(points >= HIGH)).size:
            place = np.searchsorted(known, points[high])
            kind[high] = np.where(known[place] == points[high], place, len(self.letters))
        state = np.ones(len(starts), np.int32)
        live = np.arange(len(starts))
        at = 0
        while len(live):
            now = self.table[state[live], kind[starts[live] + at]]
            state[live] = now
            at += 1
            live = live[~self.settled[now] & (starts[live] + at < stops[live])]
        fate = self.fate[state]
        hit = np.flatnonzero(fate >= 0)
        return hit, fate[hit]


class Machines:
    """Automata of TERMS terms each: a product of few is small. Of several terms that a word fits, the one of fewest edits, then the first."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.parts = [Automaton(terms[i : i + TERMS]) for i in range(0, len(terms), TERMS)]

    def run(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(starts), 1 << 40)
        for i, part in enumerate(self.parts):
            hit, fate = part.run(points, starts, stops)
            best[hit] = np.minimum(best[hit], (fate % 3 << 32) + i * TERMS + fate // 3)
        hit = np.flatnonzero(best < 1 << 40)
        return hit, (best[hit] & (1 << 32) - 1) * 3 + (best[hit] >> 32)


def _words(column: pa.Array) -> Iterator[tuple[str, *tuple[np.ndarray, ...]]]:
    """Characters, folded code points, starts, stops, index of each text's first word and the end, ends of texts, for runs of rows."""
    for _, data, ends in byte_batches(column):
        raw = data.tobytes()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:])]
        text = "".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        folded = np.where(points < 256, FOLD[np.minimum(points, 255)], points)
        starts, stops = word_bounds(np.minimum(folded, HIGH), ends, WORD)
        yield text, folded, starts, stops, np.searchsorted(starts, ends), ends


def _hits(machines: Machines, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """For each text its number of words, and its hits: place, term, edits, factor of the context."""
    for text, folded, starts, stops, rows, ends in _words(column):
        hit, fate = machines.run(folded, starts, stops)
        where = np.searchsorted(hit, rows)
        for r in range(len(rows) - 1):
            found = []
            for j in range(where[r], where[r + 1]):
                w = int(hit[j])
                a, b = max(int(rows[r]), w - CONTEXT), min(int(rows[r + 1]) - 1, w + CONTEXT)
                before, after = text[max(ends[r], starts[a] - 1) : starts[w]], text[stops[w] : min(ends[r + 1], stops[b] + 2)]
                factor = QUOTED if any(q in before for q in QUOTES) and any(q in after for q in QUOTES) else 1.0
                if factor == 1.0 and any(text[starts[k] : stops[k]].lower() in REPORTING for k in range(a, w)):
                    factor = REPORTED
                found.append((w - int(rows[r]), int(fate[j]) // 3, int(fate[j]) % 3, factor))
            yield int(rows[r + 1] - rows[r]), found


class Weights:
    """Of each term, spelt right and misspelt: what a hit adds; what each word takes away; and the logit before any word."""

    def __init__(self, hit: np.ndarray, word: float, prior: float) -> None:
        self.hit, self.word, self.prior = hit, word, prior


def score_of(hits: list[tuple[int, int, int, float]], words: int, weights: Weights) -> float:
    """hits: (place, term, edits, factor of the context), in order."""
    found = [(place, weights.hit[term, min(edits, 1)] * factor) for place, term, edits, factor in hits]
    best = sum(x for _, x in found) - weights.word * words
    first, inside = 0, 0.0
    for place, x in found:
        inside += x
        while found[first][0] <= place - SCORED:
            inside -= found[first][1]
            first += 1
        best = max(best, inside - weights.word * min(SCORED, words) - math.log(max(1.0, words / SCORED)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights.prior + best))))


def heads(word: str) -> list[str]:
    """The prefixes of a word that are nodes, itself included."""
    n, out = len(word), list(range(1, min(DENSE, len(word)) + 1))
    while out[-1] * 3 // 2 < n:
        out.append(out[-1] * 3 // 2)
    return [word[:k] for k in (out if out[-1] == n else [*out, n])]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words in toxic and other texts with each prefix, of words in toxic ones that are it, and of toxic texts.

    Of k equal words in one text the first counts 1, as do each two, four, eight more: lines may be repeated without end.
    """
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        at = 0
        for _, folded, starts, stops, rows, _ in _words(batch.column("text")):
            counts, total, first = [Counter() for _ in range(4)], [0, 0], at
            text = folded.tobytes().decode("utf-32-le", "replace")
            for r in range(len(rows) - 1):
                words = Counter(text[starts[w] : stops[w]] for w in range(rows[r], rows[r + 1]))
                words = Counter({w: k.bit_length() for w, k in words.items()})
                total[toxic[at]] += sum(words.values())
                nodes = Counter()
                for w, k in words.items():
                    for head in heads(w):
                        nodes[head] += k
                counts[0 if toxic[at] else 1].update(nodes)
                if toxic[at]:
                    counts[2].update(words)
                    counts[3].update(nodes.keys())
                at += 1
            counts[0][""], counts[1][""], counts[3][""] = total[1], total[0], sum(map(bool, toxic[first:at]))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]], ["prefix", "toxic", "other", "whole", "texts"])


def lexicon(rows: list[tuple[str, int, int, int]], toxic: int, other: int, price: float) -> list[tuple[str, bool]]:
    """(term, whole word) from (prefix, words in toxic texts, in others, whole words in toxic texts) and the words of all."""
    nodes = {p: (a, w, a * math.log((a + 0.5) / (toxic + 1) / ((b + FLOOR) / (other + 1))) - price) for p, a, b, w in rows if a}
    below: dict[str, tuple[float, list[str]]] = {}
    for p in sorted(nodes, key=lambda p: (-len(p), p)):
        worth, terms = below.pop(p, (0.0, []))
        if nodes[p][2] > worth + 0.01 * abs(worth):  # of prefixes of the same words, the longest
            worth, terms = nodes[p][2], [p]
        up = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in nodes), "")
        of = below.get(up, (0.0, []))
        below[up] = of[0] + worth, of[1] + terms
    return [(t, nodes[t][1] >= 0.9 * nodes[t][0]) for t in sorted(below.get("", (0.0, []))[1]) if nodes[t][2] > 0]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The distinct lines (text, toxic) of the bounded training sample, and the share of toxic rows before sampling."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = written(marks, "toxicity-labels")
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, SAMPLE[1] / max(1, n.get(1, 0))).otherwise(SAMPLE[0] / max(1, n.get(0, 0)))
    chosen = F.broadcast(marks.where(draw < share))  # about 12,000 ids at most
    rows = docs.join(chosen, "doc_id").select("text", "toxic").where("text is not null")
    rows = written(rows, "toxicity-sample")
    # lines are learned from once: copies and shared passages would make all their words look toxic
    rows = written(rows.select(F.explode(F.split("text", "\n")).alias("text"), "toxic").distinct(), "toxicity-lines")
    return rows, n.get(1, 0) / max(1, sum(n.values()))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Machines, Weights]:
    rows, base = sample(docs, labels)
    names = ("toxic", "other", "whole", "texts")
    counts = rows.mapInArrow(_prefixes, "prefix string, toxic long, other long, whole long, texts long").groupBy("prefix").agg(*[F.sum(c).alias(c) for c in names])
    counts = written(counts.where("toxic > 0 or prefix = ''"), "toxicity-prefixes")
    price = math.log(100.0 * max(1, counts.count()))
    whole = counts.where("prefix = ''").first()
    toxic, other = (int(whole["toxic"]), int(whole["other"])) if whole else (0, 0)
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + FLOOR) / (other + 1))
    likely = counts.where((F.col("texts") >= LEAST) & (F.col("prefix") != "") & (ratio > 8) & (F.col("toxic") * F.log(ratio) > price))
    terms = lexicon([(r["prefix"], r["toxic"], r["other"], r["whole"]) for r in likely.collect()], toxic, other, price)
    machines = Machines(terms)
    sent = docs.sparkSession.sparkContext.broadcast(machines)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("toxic").to_pylist()
            c = Counter((t, min(e, 1), marks[i]) for i, (_, hits) in enumerate(_hits(sent.value, batch.column("text"))) for _, t, e, _ in hits)
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in c], pa.int32()) for i in range(3)], pa.array(list(c.values()), pa.int64())], ["term", "edited", "toxic", "n"])

    found = {(r["term"], r["edited"], r["toxic"]): r["n"] for r in rows.mapInArrow(seen, "term int, edited int, toxic int, n long").groupBy("term", "edited", "toxic").agg(F.sum("n").alias("n")).collect()}
    rate = lambda i, e, k: (found.get((i, e, k), 0) + (0.5 if k else FLOOR)) / ((toxic if k else other) + 1)
    right = [math.log(rate(i, 0, 1) / rate(i, 0, 0)) for i in range(len(terms))]
    wrong = [math.log(MISSPELT * rate(i, 0, 1) / rate(i, 1, 0)) for i in range(len(terms))]
    hit = np.maximum(0.0, np.array([right, wrong]).T.reshape(-1, 2))
    word = sum(max(0.0, rate(i, 0, 1) - rate(i, 0, 0)) for i in range(len(terms)))
    return machines, Weights(hit, word, math.log(max(base, 1e-3) / max(1 - base, 1e-3)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' columns (but held_out, score, predicted) with those, for each row."""
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    sent = docs.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text"), labels))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, weights = sent.value
        for batch in batches:
            scores = np.array([score_of(hits, n, weights) for n, hits in _hits(machines, batch.column("text"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judge, f"{schema}, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, their columns as they were."""
    rows, back = aside(docs, "doc_id", "text")
    return score(rows, labels).where("predicted = 0").select(*back)
