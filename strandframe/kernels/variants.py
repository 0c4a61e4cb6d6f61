"""Variants of a consensus that is aligned with its stretch of the reference."""

from __future__ import annotations


def variants_of(ops: list[tuple[int, str]], s: int, ref: str, pos: int, consensus: str, least: int) -> list[tuple[str, int, str, str, int]]:
    """Kind, place, reference and other allele, and length of each insertion and deletion of at least so many bases. The
    alignment begins at s, ref at pos; alleles begin with the base before, if ref holds it."""
    out = []
    r, c = s, 0
    for n, op in ops:
        anchor = ref[r - pos - 1] if r > pos else ""
        if op == "I":
            if n >= least:
                out.append(("INS", r, anchor, anchor + consensus[c : c + n], n))
            c += n
        elif op == "D":
            if n >= least:
                out.append(("DEL", r, anchor + ref[r - pos : r - pos + n], anchor, n))
            r += n
        else:
            r, c = r + n, c + n
    return out
