"""Token counts by trie-shared dynamic programming over the unigram forward scores of a public vocabulary.

A pre-token is a space sign and a run of other characters than white space. The distinct pre-tokens of a block of texts
go into a trie of bytes; the best segmentation's score is computed once for each node, so once for each shared prefix,
as the best over the pieces that end there; a word's count is what stands at its last node. A text's count is the sum
over its pre-tokens. The vocabulary is a file that is read, never trained and never copied: piece i of n scores
-1000 * ln(i + 10), rounded, so that sums are whole numbers and ties are exact; of equal scores the fewer tokens win.
A byte that no piece covers is a token of its own, at the price of BYTE.

Defined results: a null, empty or white-space text has no tokens; repeated rows each return a row; an empty table gives
no rows; other columns are left alone.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recurra.llm.bytewise import NOT_SPACE, U, batches as byte_batches, mix, word_bounds, word_classes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of the longest piece of VOCABULARY, and those after which only ends of still longer pieces are followed.
LONGEST, DEEP = 128, 16
BYTE = -16000
SPACE = b" "
#: Bytes of text whose distinct pre-tokens share a trie.
BLOCK = 8 << 20


def piece_score(rank: int) -> int:
    return -round(1000 * math.log(rank + 10))


def pieces(path: str = VOCABULARY) -> dict[bytes, int]:
    """Scores of all pieces in a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return {p: piece_score(r) for p, r in ranks.items()}


class Vocabulary:
    """Piece scores by hash, one table for each length; hashes are of (bytes from the last to the first)."""

    STEP = U(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[bytes, int]) -> None:
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.longest = max(map(len, scores), default=0)
        self.tails = np.zeros(1 << 18, bool)  # hashes of the last DEEP bytes of longer pieces
        by_length: dict[int, list[tuple[int, int]]] = {}
        for p, s in scores.items():
            h = np.zeros(1, U)
            for n, c in enumerate(reversed(p), 1):
                h = mix(h * self.STEP + U(c + 1))
                if n == DEEP < len(p):
                    self.tails[h >> U(46)] = True
            by_length.setdefault(len(p), []).append((int(h[0]), s))
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = np.array([h for h, _ in rows], U), np.array([s for _, s in rows], np.int64)
        self.sieve = {n: np.zeros(1 << 18, bool) for n in self.tables}
        for n, (keys, _) in self.tables.items():
            self.sieve[n][keys >> U(46)] = True

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, by one pass over the trie of all, level by level."""
        words = [SPACE + w for w in words]
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        lengths = np.array([len(words[i]) for i in order])
        starts = np.cumsum(lengths) - lengths
        # the trie's nodes at depth d are the runs of sorted words with equal first d bytes
        node = np.zeros(len(words), np.int64)
        letters, parents = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)]
        score, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        out = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for d in range(1, int(lengths.max(initial=0)) + 1):
            live = live[lengths[live] >= d]
            here, up = data[starts[live] + d - 1], node[live]
            new = np.ones(len(live), bool)
            new[1:] = (here[1:] != here[:-1]) | (up[1:] != up[:-1])
            number = np.cumsum(new) - 1
            letters.append(here[new])
            parents.append(up[new])
            best, fewest = score[d - 1][up[new]] + BYTE, count[d - 1][up[new]] + 1
            h, at, level = np.zeros(int(new.sum()), U), np.arange(int(new.sum())), d
            who = at
            for n in range(1, min(d, self.longest) + 1):
                if n == DEEP + 1:
                    on = np.flatnonzero(self.tails[h >> U(46)])
                    h, at, who = h[on], at[on], who[on]
                    if not len(on):
                        break
                h = mix(h * self.STEP + letters[level][at].astype(U) + U(1))
                at, level = parents[level][at], level - 1
                if n in self.tables:
                    maybe = np.flatnonzero(self.sieve[n][h >> U(46)])
                    keys, values = self.tables[n]
                    place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                    ok = keys[place] == h[maybe]
                    maybe, place = maybe[ok], place[ok]
                    s, c = score[level][at[maybe]] + values[place], count[level][at[maybe]] + 1
                    maybe = who[maybe]
                    better = (s > best[maybe]) | ((s == best[maybe]) & (c < fewest[maybe]))
                    best[maybe[better]], fewest[maybe[better]] = s[better], c[better]
            score.append(best)
            count.append(fewest)
            node[live] = number
            done = lengths[live] == d
            out[order[live[done]]] = fewest[number[done]]
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pre-tokens and tokens of the texts of each run of rows."""
        for _, data, ends in byte_batches(column, BLOCK):
            starts, stops = word_bounds(data, ends, NOT_SPACE)
            rows = np.searchsorted(starts, ends)
            first, which = word_classes(data, starts, stops)
            tokens = self.counts([data[starts[i] : stops[i]].tobytes() for i in first]) if len(first) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(tokens[which])]) if len(which) else np.zeros(1, np.int64)
            yield np.diff(rows), np.diff(upto[rows])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(pieces(vocabulary)))  # as large as the vocabulary: some MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(sent.value.texts(batch.column("text")))
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *[b[i] for b in both]])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
