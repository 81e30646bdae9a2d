"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time.

Texts are cut into chunks of CHUNK bytes; a forward and a backward GRU run over each chunk, a linear layer and softmax
label every position, and a text's probabilities are the mean over all its positions. Every byte of every text is read.

Training uses windows of at most DOCS_EACH documents a language (chosen by hash) from rows with a language outside the
held-out fold. Language, source and doc_id are never inputs of a prediction. Runs agree: seeds are fixed, and the sample
is put in order before training.

Defined results: a null text, an empty one or one without letters is `und` with score 0; so are all texts if there is
nothing to learn from; rows with a null language are predicted, not learned from; repeated rows each return a row; an
empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.bytewise import batches as byte_batches

HIDDEN, CHUNK, TRAIN_STEPS, BATCH, RATE, SEED = 8, 64, 360, 384, 0.02, 20
#: The bound of the training sample, for each language: about so many documents, WINDOWS_EACH windows of WINDOW characters.
DOCS_EACH, WINDOWS_EACH, WINDOW = 600, 3, 96
#: Chunks run through the network together.
TOGETHER = 4096
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


class BiGRU:
    """Weights: per direction x (256, 3H) for bytes, u (H, 3H), gates in the order update, reset, candidate; out, bias."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.hidden, self.w = hidden, {}
        for d in "fb":
            self.w[f"x{d}"] = draw.normal(0, 0.3, (256, 3 * hidden))
            self.w[f"u{d}"] = draw.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        self.w["out"] = draw.normal(0, hidden**-0.5, (2 * hidden, classes))
        self.w["bias"] = np.zeros(classes)

    def _run(self, data: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (T, B, H) of one direction over bytes (T, B), and what the way back needs."""
        x, u, n = self.w[f"x{d}"], self.w[f"u{d}"], self.hidden
        h, states, kept = np.zeros((data.shape[1], n)), np.zeros((*data.shape, n)), []
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            a, g = x[data[t]], h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * n] + g[:, : 2 * n])))
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            kept.append((t, h, z, r, c, g[:, 2 * n :]))
            h = c + z * (h - c)
            states[t] = h
        return states, kept

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient by backpropagation through time."""
        n, grad = self.hidden, {k: np.zeros_like(v) for k, v in self.w.items()}
        runs = {d: self._run(data, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        hot = np.eye(p.shape[2])[label]
        loss = -np.log((p * hot).sum(axis=2) + 1e-12).mean()
        delta = (p - hot) / (data.shape[0] * data.shape[1])
        grad["out"] = np.einsum("tbh,tbc->hc", both, delta)
        grad["bias"] = delta.sum(axis=(0, 1))
        above = delta @ self.w["out"].T
        for d, part in (("f", above[:, :, :n]), ("b", above[:, :, n:])):
            u, back = self.w[f"u{d}"], 0.0
            for t, h, z, r, c, g in reversed(runs[d][1]):
                dh = part[t] + back
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * g * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(grad[f"x{d}"], data[t], da)
                grad[f"u{d}"] += h.T @ dg
                back = dh * z + dg @ u.T
        return float(loss), grad

    def fit(self, windows: list[np.ndarray], label: np.ndarray, steps: int = TRAIN_STEPS, seed: int = SEED) -> None:
        """Adam over windows of 32 bytes at random places, languages drawn evenly."""
        draw, span = np.random.default_rng(seed), 32
        by_class = [np.flatnonzero(label == k) for k in range(label.max() + 1)]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            kind = draw.integers(0, len(by_class), BATCH)
            pick = [by_class[k][int(draw.random() * len(by_class[k]))] for k in kind]
            data = np.full((span, BATCH), 32, np.uint8)
            for i, w in enumerate(pick):
                at = int(draw.random() * max(1, len(windows[w]) - span))
                piece = windows[w][at : at + span]
                data[: len(piece), i] = piece
            _, grad = self.gradients(data, np.broadcast_to(kind, data.shape))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def frozen(self) -> dict[str, np.ndarray]:
        """float32 weights with the halving of the logistic gates folded in: logistic(v) = (1 + tanh(v / 2)) / 2."""
        half = np.concatenate([np.full(2 * self.hidden, 0.5), np.ones(self.hidden)])
        out = {k: (v * half if k[0] in "xu" else v).astype(np.float32) for k, v in self.w.items()}
        for d in "fb":
            out[f"u{d}"] = np.ascontiguousarray(out[f"u{d}"].T)  # (3H, H)
            out[f"x{d}"] = np.ascontiguousarray(out[f"x{d}"].T)  # (3H, 256)
        return out | {"out": np.ascontiguousarray(out["out"].T)}


def positions(w: dict[str, np.ndarray], data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sums over the valid positions of each chunk (T, B) of the label probabilities: (B, classes)."""
    n, (t_all, b) = w["uf"].shape[1], data.shape
    states, data = np.empty((t_all, 2 * n, b), np.float32), data.astype(np.intp)
    for d, side in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
        x, u, h = w[f"x{d}"], w[f"u{d}"], np.zeros((n, b), np.float32)
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            a, g = np.take(x, data[t], axis=1, mode="clip"), u @ h
            zr = np.tanh(a[: 2 * n] + g[: 2 * n])
            zr += 1
            zr *= 0.5
            g = g[2 * n :]
            g *= zr[n:]
            g += a[2 * n :]
            c = np.tanh(g, out=g)
            h = h - c
            h *= zr[:n]
            h += c
            if d == "b":  # padding stands at the end of a chunk: the way back starts at its last valid byte
                h *= valid[t]
            states[t, side] = h
    total = np.zeros((w["bias"].shape[0], b), np.float32)
    for t in range(t_all):
        e = np.exp(w["out"] @ states[t] + w["bias"][:, None])
        total += e * (valid[t] / e.sum(axis=0))
    return total.T


def predict(w: dict[str, np.ndarray], column: pa.Array, classes: list[str]) -> tuple[list[str], list[float]]:
    """The label and its pooled probability for each text."""
    out_label, out_score = [], []
    for first, data, ends in byte_batches(column, 4 << 20):
        sizes = np.diff(ends)
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = ends[owner] + place * CHUNK
        length = np.minimum(CHUNK, ends[owner + 1] - begin)
        pooled = np.zeros((len(sizes), len(classes)))
        for a in range(0, len(owner), TOGETHER):
            s, n = begin[a : a + TOGETHER], length[a : a + TOGETHER]
            at = s[None, :] + np.arange(CHUNK)[:, None]
            valid = np.arange(CHUNK)[:, None] < n[None, :]
            piece = np.where(valid, data[np.minimum(at, len(data) - 1)], 32)
            np.add.at(pooled, owner[a : a + TOGETHER], positions(w, piece, valid.astype(np.float32)))
        pooled /= np.maximum(1, sizes)[:, None]
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        for i in range(len(sizes)):
            known = letters[ends[i + 1]] > letters[ends[i]] or any(c.isalpha() for c in data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace"))
            best = int(pooled[i].argmax())
            out_label.append(classes[best] if known else "und")
            out_score.append(min(1.0, float(pooled[i, best])) if known else 0.0)
    return out_label, out_score


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, window of text): the bounded training sample, in order."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count()
    share = counts.select("lang", (F.lit(float(DOCS_EACH)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.join(F.broadcast(share), "lang").where(draw < F.col("share"))  # a row for each language
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    windows = F.explode(F.array(*[F.substring(F.col("text"), place(k), F.lit(WINDOW)) for k in range(WINDOWS_EACH)]))
    return sorted(tuple(r) for r in chosen.select("lang", windows.alias("w")).collect())


def train(windows: list[tuple[str, str]]) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    classes = sorted({lang for lang, _ in windows})
    if not classes:
        return None, []
    net = BiGRU(len(classes))
    if len(classes) > 1:
        net.fit([np.frombuffer(w.encode(), np.uint8) for _, w in windows], np.array([classes.index(lang) for lang, _ in windows]))
    return net.frozen(), classes


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    rows = docs.select("doc_id", "text", "lang")
    weights, classes = train(sample(rows))
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # a few hundred kB at most

    def label(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            lang, score = predict(sent.value, part.column("text"), classes) if classes else (["und"] * n, [0.0] * n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
