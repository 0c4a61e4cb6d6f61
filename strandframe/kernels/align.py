"""Global alignment with two-piece affine gaps, a row of the table at a time."""

from __future__ import annotations

import numpy as np

LOW = -(1 << 40)
# Scores of the caller's realignment; a gap of k costs min(16 + 2 k, 41 + k).
MATCH, MISMATCH, GAPS = 1, -9, ((16, 2), (41, 1))


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)


def gap_costs(n: int, gaps: tuple = GAPS) -> np.ndarray:
    """Of lengths 0 to n; of 0 none."""
    k = np.arange(n + 1)
    out = np.min([o + e * k for o, e in gaps], axis=0)
    out[0] = 0
    return out


def global_align(ref: str, query: str, match: int = MATCH, mismatch: int = MISMATCH, gaps: tuple = GAPS) -> tuple[int, list[tuple[int, str]]]:
    """Score and operations (M, I: in the query only, D: in the reference only). Of equal alignments the one whose gaps
    lie furthest to the left. N matches anything for 0."""
    t, q = _codes(ref), _codes(query)
    n, m = len(t), len(q)
    j = np.arange(m + 1)
    costs = gap_costs(max(n, m), gaps)
    h = np.empty((n + 1, m + 1), np.int32)
    h[0] = -costs[: m + 1]
    down = [np.full(m + 1, LOW, np.int64) for _ in gaps]
    unknown = q == ord("N")
    for i in range(1, n + 1):
        up = h[i - 1].astype(np.int64)
        score = np.where(unknown | (t[i - 1] == ord("N")), 0, np.where(q == t[i - 1], match, mismatch))
        best = np.append(LOW, up[:-1] + score)
        for k, (o, e) in enumerate(gaps):
            down[k] = np.maximum(up - o - e, down[k] - e)
            best = np.maximum(best, down[k])
        # gaps along the row start from what ends without one: starting from another gap never pays
        row = best
        for o, e in gaps:
            across = np.append(LOW, np.maximum.accumulate(best + e * j)[:-1]) - o - e * j
            row = np.maximum(row, across)
        h[i] = row
    ops: list[list] = []

    def push(k: int, op: str) -> None:
        if ops and ops[-1][1] == op:
            ops[-1][0] += k
        else:
            ops.append([k, op])

    i, k = n, m
    while i or k:
        here = int(h[i, k])
        if i and k:
            a, b = t[i - 1], q[k - 1]
            s = 0 if ord("N") in (a, b) else match if a == b else mismatch
            if here == int(h[i - 1, k - 1]) + s:
                push(1, "M")
                i, k = i - 1, k - 1
                continue
        fits = np.flatnonzero(h[:i, k][::-1].astype(np.int64) - costs[1 : i + 1] == here) if i else []
        if len(fits):
            push(int(fits[0]) + 1, "D")
            i -= int(fits[0]) + 1
            continue
        fits = np.flatnonzero(h[i, :k][::-1].astype(np.int64) - costs[1 : k + 1] == here)
        push(int(fits[0]) + 1, "I")
        k -= int(fits[0]) + 1
    return int(h[n, m]), [(a, b) for a, b in reversed(ops)]
