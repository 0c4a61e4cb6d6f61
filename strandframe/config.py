"""Options of the stages, with the defaults of the command line."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    min_mapq: int = 20
    #: quantile of mismatch ratios above which a read is left as it is
    accuracy_quantile: float = 0.98
    accuracy_reads: int = 10_000
    #: indels up to this length are smoothed away
    min_indel_length: int = 20
    min_cluster_weight: int = 2
    min_sv_length: int = 25
    length_ratio: float = 0.97
    flank: int = 100
    ksize: int = 7
    assemble: bool = True
    putative: bool = True
    use_haplotypes: bool = True
    clipped: bool = False
    #: strings of a read taken from the right without overlap, in place of all shortest ones
    relaxed: bool = False
    #: genotypes and allele frequencies by the reads at each call
    genotype: bool = False
    #: mimic known quirks of greedy steps instead of their intended meaning
    compat: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "min_sv_length", max(25, self.min_sv_length))
