"""Smoothing of one alignment against its slice of the reference."""

from __future__ import annotations

import numpy as np

Ops = list[tuple[int, str]]
DIRTY, PLAIN, BROKEN, SMOOTHED = 1, 2, 3, 0


def mismatch_counts(ops: Ops, seq: str, ref: str) -> tuple[int, int]:
    """Matches and mismatches on M, = and X, up to the first operation that is neither of these nor I, D or S.
    ref begins at the alignment's position."""
    q = r = same = other = 0
    for n, op in ops:
        if op in "M=X":
            a, b = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (seq[q : q + n], ref[r : r + n]))
            k = min(len(a), len(b))
            equal = int((a[:k] == b[:k]).sum())
            same, other, q, r = same + equal, other + n - equal, q + n, r + n
        elif op in "IS":
            q += n
        elif op == "D":
            r += n
        else:
            break
    return same, other


def too_dirty(same: int, other: int, threshold: float | None) -> bool:
    if threshold is None or not (same or other):
        return False
    return same == 0 or other / same > threshold


def smooth(ops: Ops, seq: str, qual: bytes, ref: str, threshold: float | None, short: int = 20, compat: bool = False) -> tuple[int, str, bytes, Ops]:
    """The read's class, sequence, qualities and operations: reference bases on matches, short indels undone, long ones
    and soft clips kept. Reads that are dirty or without anything long stay as they are.

    A short deletion's length joins the match it fills up: the one before it, or else one of its own. compat adds it to
    the next match in the list, however far, and loses it where none comes.
    """
    same, other = mismatch_counts(ops, seq, ref)
    new_seq: list[str] = []
    new_qual: list[bytes] = []
    new_ops: list[list] = []
    q = r = pending = 0
    plain = True

    def push(n: int, op: str) -> None:
        if new_ops and new_ops[-1][1] == op == "M":
            new_ops[-1][0] += n
        else:
            new_ops.append([n, op])

    for n, op in ops:
        if op in "M=X":
            new_seq.append(ref[r : r + n])
            new_qual.append(qual[q : q + n])
            push(n + pending, "M")
            q, r, pending = q + n, r + n, 0
        elif op == "I":
            if n > short:
                plain = False
                new_seq.append(seq[q : q + n])
                new_qual.append(qual[q : q + n])
                push(n, op)
            q += n
        elif op == "D":
            if n > short:
                plain = False
                push(n, op)
            else:
                new_seq.append(ref[r : r + n])
                new_qual.append((qual[q : q + n] + b"!" * n)[:n])
                if compat:
                    pending += n
                else:
                    push(n, "M")
            r += n
        elif op == "S":
            plain = False
            new_seq.append(seq[q : q + n])
            new_qual.append(qual[q : q + n])
            push(n, op)
            q += n
        else:
            break
    if too_dirty(same, other, threshold):
        return DIRTY, seq, qual, ops
    if plain:
        return PLAIN, seq, qual, ops
    out = "".join(new_seq)
    if not compat and sum(n for n, op in new_ops if op in "MIS") != len(out):
        return BROKEN, seq, qual, ops
    return SMOOTHED, out, b"".join(new_qual), [(n, op) for n, op in new_ops]
