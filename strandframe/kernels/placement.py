"""Placing specific strings of one alignment on the reference."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable

import numpy as np

from . import cigars

Pair = tuple[int | None, int | None]


def pairs_of(ops: list[tuple[int, str]], start: int) -> list[Pair]:
    """Read and reference positions of each base of an alignment, None where it has none."""
    if not ops:
        return []
    lens, kinds = zip(*ops)
    _, q, r = cigars.aligned(np.array(lens), np.array([cigars.OPS.index(k) for k in kinds]), np.zeros(len(ops), np.int64), np.array([start]))
    return [(None if a < 0 else a, None if b < 0 else b) for a, b in zip(q.tolist(), r.tolist())]


def unique_anchor(pairs: list[Pair], k: int, nearest_last: bool, ref: str, ref_start: int, compat: bool = False) -> Pair | None:
    """Where the k-mer begins that is placed without gaps, occurs once among such, and lies nearest to the string: the
    last of the pairs for those before it, the first for those after. Without one that occurs once, the farthest."""
    run = 0
    windows = []
    for i, (q, r) in enumerate(pairs):
        run = run + 1 if q is not None and r is not None else 0
        if run >= k:
            windows.append(i - k + 1)
    if not windows:
        return None

    def kmer(i: int) -> str:
        at = pairs[i][1] - ref_start
        return ref[at : at + k]

    counts = Counter(map(kmer, windows))
    visited = windows[::-1] if nearest_last else windows
    if compat and nearest_last:
        # the scan from the end jumps as far to the left of a gap as the gap lies within the window
        visited, i, last = [], len(pairs) - k, None
        while i >= 0:
            gap = next((j for j in range(i, i + k) if None in pairs[j]), None)
            if gap is None:
                visited.append(i)
                i -= 1
            else:
                i -= (gap - i) + 1
        if not visited:
            return None
    for i in visited:
        if counts[kmer(i)] == 1:
            return pairs[i]
    return pairs[visited[-1]]


def place(
    ops: list[tuple[int, str]], pos: int, strings: list[tuple[int, int]], ref: str, flank: int = 100, k: int = 7, compat: bool = False
) -> tuple[list[tuple[int, int, int, int]], tuple[int, int] | None, tuple[int, int] | None]:
    """Extended strings (rs, re, qs, qe), then the clip at the start and at the end of the read (position, length).

    strings: start and length in the read, ascending. ref begins at pos.
    """
    pairs = pairs_of(ops, pos)
    placed = [i for i, (q, r) in enumerate(pairs) if q is not None and r is not None]
    reads = [pairs[i][0] for i in placed]
    out, left, right = [], None, None
    end_pos = pos + sum(n for n, op in ops if op in "MDN=X")
    for s, n in sorted(strings):
        e = s + n - 1
        a, b = bisect_left(reads, s) - 1, bisect_right(reads, e)
        if a < 0 and b >= len(placed):
            continue
        if a < 0:
            if ops[0][1] == "S":
                left = (pos, ops[0][0])
            continue
        if b >= len(placed):
            if ops[-1][1] == "S":
                right = (end_pos, ops[-1][0])
            continue
        first, last = placed[a], placed[b]
        before = unique_anchor(pairs[max(0, first - flank) : first], k, True, ref, pos, compat) or pairs[first]
        after = unique_anchor(pairs[last + 1 : last + 1 + flank], k, False, ref, pos, compat) or pairs[last]
        if before[1] <= after[1] + k:
            out.append((before[1], after[1] + k, before[0], after[0] + k))
    return out, left, right


def first_groups(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Each span (closed) goes to the first merged one so far that it overlaps, in one pass: start, end and members."""
    out: list[list] = []
    for i, (s, e) in enumerate(spans):
        found = next((g for g in out if s <= g[1] and g[0] <= e), None)
        if found is None:
            out.append([s, e, [i]])
        else:
            found[:] = [min(s, found[0]), max(e, found[1]), [*found[2], i]]
    return [(s, e, members) for s, e, members in out]


def merge_first(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (rs, re, qs, qe) merged by what they cover of the reference."""
    return [(s, e, min(spans[i][2] for i in m), max(spans[i][3] for i in m)) for s, e, m in first_groups((x[0], x[1]) for x in spans)]


def subread(ops: list[tuple[int, str]], pos: int, seq: str, s: int, e: int) -> str | None:
    """The read from its last base placed at or before s to its first at or after e; None if it doesn't span both."""
    placed = [(q, r) for q, r in pairs_of(ops, pos) if q is not None and r is not None]
    refs = [r for _, r in placed]
    a, b = bisect_right(refs, s) - 1, bisect_left(refs, e)
    return seq[placed[a][0] : placed[b][0] + 1] if a >= 0 and b < len(placed) else None
