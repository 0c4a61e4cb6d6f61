"""Operations of many alignments at once, as arrays."""

from __future__ import annotations

import numpy as np

# Operation letters by BAM code; those that advance the read and the reference.
OPS = "MIDNSHP=X"
READ_OPS, REF_OPS = "MIS=X", "MDN=X"
MOVES_READ = np.array([c in READ_OPS for c in OPS])
MOVES_REF = np.array([c in REF_OPS for c in OPS])


def offsets(lens: np.ndarray, codes: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each operation begins in its read and on the reference. row: the alignment of each, ascending; starts: the
    reference position at which each alignment begins."""

    def before(moves: np.ndarray) -> np.ndarray:
        steps = np.where(moves[codes], lens, 0)
        total = np.cumsum(steps) - steps
        first = np.searchsorted(row, np.arange(len(starts)))
        return total - total[np.minimum(first, max(len(total) - 1, 0))][row] if len(total) else total

    return before(MOVES_READ), before(MOVES_REF) + starts[row]


def aligned(lens: np.ndarray, codes: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each base that moves on either: its alignment and its read and reference positions, -1 where it has none."""
    q, r = offsets(lens, codes, row, starts)
    kept = MOVES_READ[codes] | MOVES_REF[codes]
    lens, codes, row, q, r = lens[kept], codes[kept], row[kept], q[kept], r[kept]
    op = np.repeat(np.arange(len(lens)), lens)
    step = np.arange(len(op)) - np.repeat(np.cumsum(lens) - lens, lens)
    return row[op], np.where(MOVES_READ[codes[op]], q[op] + step, -1), np.where(MOVES_REF[codes[op]], r[op] + step, -1)
