"""Counts by the whole vocabulary file, without a bound on the length of a piece."""

from __future__ import annotations

import base64

from recurra.llm import token_counts


def test_counts_by_all_pieces_of_the_file():
    with open(token_counts.VOCABULARY, "rb") as f:
        scores = {base64.b64decode(a): token_counts.piece_score(int(b)) for a, b in map(bytes.split, f)}
    assert token_counts.pieces() == scores
    longest = max(map(len, scores))

    def best(w: bytes) -> int:
        w, rows = b" " + w, [(0, 0)]
        for e in range(1, len(w) + 1):
            rows.append(max([(rows[e - 1][0] + token_counts.BYTE, rows[e - 1][1] - 1), *[(rows[s][0] + scores[w[s:e]], rows[s][1] - 1) for s in range(max(0, e - longest), e) if w[s:e] in scores]]))
        return -rows[-1][1]

    deep = [p.strip() for p in scores if len(p) > 16 and len(p.split()) == 1]
    words = sorted({b"responsibilities", b"telecommunications", b"disproportionately", b"characterization", b"-" * 64, b"-" * 300, *deep, *[b"x" + p + b"y" + p for p in deep]})
    assert len(deep) > 40 and token_counts.Vocabulary(scores).counts(words).tolist() == [best(w) for w in words]
    assert best(b"responsibilities") == 1
