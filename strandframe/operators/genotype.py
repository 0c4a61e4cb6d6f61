"""The Bayesian genotype model: posteriors of 00, 01, 10, 11 from supporting reads and their haplotypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENOTYPES = ("00", "01", "10", "11")
# Fixed values of the model.
READ_GIVEN_ALLELE = {(1, 1): 0.8, (0, 0): 0.95, (0, 1): 0.2, (1, 0): 0.05}
PRIOR = {"00": 0.5, "01": 0.22, "10": 0.22, "11": 0.06}
UNTAGGED, SAME, OTHER = 0.5, 0.95, 0.05
NO_TAG = 3


def read_given_allele(support: Column, allele: int) -> Column:
    return F.when(support == 1, F.lit(READ_GIVEN_ALLELE[1, allele])).otherwise(F.lit(READ_GIVEN_ALLELE[0, allele]))


def haplotype_prior(tag: Column, haplotype: int) -> Column:
    return F.when(tag == NO_TAG, F.lit(UNTAGGED)).when(tag == haplotype, F.lit(SAME)).otherwise(F.lit(OTHER))


def read_likelihood(support: Column, tag: Column, genotype: str) -> Column:
    return sum(read_given_allele(support, int(a)) * haplotype_prior(tag, h) for h, a in enumerate(genotype, 1))


def posteriors(reads: DataFrame, keys: Sequence[str], support: str = "support", tag: str = "hap", sum_of_logs: bool = True) -> DataFrame:
    """A row for each key: p00, p01, p10 and p11. sum_of_logs False sums plain likelihoods in place of their logs, as
    the model was once written down."""
    terms = {}
    for g in GENOTYPES:
        likelihood = read_likelihood(F.col(support), F.col(tag), g)
        terms[g] = F.sum(F.log(likelihood) if sum_of_logs else likelihood) + F.log(F.lit(PRIOR[g]))
    scores = reads.groupBy(*keys).agg(*(v.alias(f"s{g}") for g, v in terms.items()))
    top = F.greatest(*(F.col(f"s{g}") for g in GENOTYPES))
    weights = {g: F.exp(F.col(f"s{g}") - top) for g in GENOTYPES}
    total = sum(weights.values())
    return scores.select(*keys, *((weights[g] / total).alias(f"p{g}") for g in GENOTYPES))


def genotype_calls(svs: DataFrame) -> DataFrame:
    """Calls with posteriors, the likeliest genotype (gt, gq) and the share of the reads at the locus that support the call
    (vaf), from their vectors of reads, 'support:haplotype' joined by '-'. Each call is genotyped by itself, in its row:
    nothing is shuffled. A call without reads has no genotype."""
    reads = F.transform(F.filter(F.split(F.coalesce("rvec", F.lit("")), "-"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("support"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("hap")))
    out = svs.withColumn("genotype_reads", reads)

    def score(g: str) -> Column:
        return F.aggregate("genotype_reads", F.lit(0.0), lambda t, r: t + F.log(read_likelihood(r["support"], r["hap"], g))) + F.log(F.lit(PRIOR[g]))

    out = out.select("*", *(score(g).alias(f"genotype_{g}") for g in GENOTYPES))
    top = F.greatest(*(F.col(f"genotype_{g}") for g in GENOTYPES))
    weights = {g: F.exp(F.col(f"genotype_{g}") - top) for g in GENOTYPES}
    total = sum(weights.values())
    best = F.array_max(F.array(*(F.struct((weights[g] / total).alias("p"), F.lit("0/0" if g == "00" else "1/1" if g == "11" else "0/1").alias("gt")) for g in GENOTYPES)))
    quality = F.least(F.lit(100), F.floor(-10 * F.log10(F.greatest(1 - best["p"], F.lit(1e-10))))).cast("int")
    some = F.size("genotype_reads") > 0
    share = F.round(F.least(F.col("w") / F.nullif(F.col("cov"), F.lit(0)), F.lit(1.0)), 4) if {"w", "cov"} <= set(svs.columns) else F.lit(None).cast("double")
    return out.select(
        *svs.columns, *((weights[g] / total).alias(f"p{g}") for g in GENOTYPES), F.when(some, best["gt"]).otherwise("./.").alias("gt"), F.when(some, quality).alias("gq"), share.alias("vaf")
    )
