"""Splitting a cluster's reads into one or two sub-clusters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Group:
    reads: list[int] = field(default_factory=list)  # indices
    total: int = 0

    def mean(self) -> int:
        return self.total // len(self.reads)

    def add(self, i: int, n: int) -> None:
        self.reads.append(i)
        self.total += n


def ratio(a: int, b: int) -> float:
    """Of the smaller to the larger; equal ones, also two empty ones, are alike."""
    return 1.0 if a == b else min(a, b) / max(a, b)


def by_length(indices: list[int], lengths: list[int], least: float) -> list[Group]:
    groups: list[Group] = []
    for i in indices:
        found = next((g for g in groups if ratio(g.mean(), lengths[i]) >= least), None)
        if found is None:
            groups.append(found := Group())
        found.add(i, lengths[i])
    return groups


def largest(groups: list[Group]) -> Group | None:
    return max(groups, key=lambda g: len(g.reads), default=None)  # the first of equals


def best_match(groups: list[Group], n: int, least: float) -> tuple[Group | None, bool]:
    """The last group within reach until one of exactly this length, and whether it is exact: a stored ratio counts only
    as a whole number, so that any later match replaces an inexact one."""
    found, exact = None, False
    for g in groups:
        r = ratio(g.mean(), n)
        if r >= least and r > (1 if exact else 0):
            found, exact = g, r == 1.0
    return found, exact


def split(lengths: list[int], tags: list[int], least: float = 0.97, use_tags: bool = True) -> list[tuple[list[int], dict[str, int]]]:
    """Reads of each sub-cluster, by index, and changes to the coverages cov0, cov1, cov2.

    Without haplotype tags: the two largest groups of like length. With tags: untagged reads join the group of a
    haplotype that their length matches; with both haplotypes one that matches neither or both alike is left out, with
    one it goes to a group of its own. Then the largest group of each haplotype, or of one and of what was left over.
    """
    tags = tags if use_tags else [0] * len(tags)
    members = {t: [i for i, x in enumerate(tags) if x == t] for t in (1, 2)}
    untagged = [i for i, x in enumerate(tags) if x not in (1, 2)]
    if not members[1] and not members[2]:
        groups = sorted(by_length(untagged, lengths, least), key=lambda g: -len(g.reads))  # stable: the first of equals
        return [(g.reads, {}) for g in groups[:2]]
    change = {"cov0": 0, "cov1": 0, "cov2": 0}
    groups_of = {t: by_length(members[t], lengths, least) for t in (1, 2)}
    if members[1] and members[2]:
        for i in untagged:
            (one, exact1), (two, exact2) = (best_match(groups_of[t], lengths[i], least) for t in (1, 2))
            if one is not None and (two is None or exact1 and not exact2):
                one.add(i, lengths[i])
                change["cov1"] += 1
            elif two is not None and (one is None or exact2 and not exact1):
                two.add(i, lengths[i])
                change["cov2"] += 1
        return [(largest(groups_of[t]).reads, change) for t in (1, 2)]
    tag = 1 if members[1] else 2
    rest: list[int] = []
    for i in untagged:
        found, _ = best_match(groups_of[tag], lengths[i], least)
        if found is None:
            rest.append(i)
        else:
            found.add(i, lengths[i])
            change[f"cov{tag}"] += 1
            change["cov0"] -= 1
    out = [(largest(groups_of[tag]).reads, change)]
    over = largest(by_length(rest, lengths, least))
    return out + ([(over.reads, change)] if over else [])
