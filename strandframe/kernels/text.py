"""Longest common subsequence by bit-parallel rows."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Rows of the LCS table as differences, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hits = row & where.get(c, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0
