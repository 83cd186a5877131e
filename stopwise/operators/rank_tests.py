"""Rank tests and rank correlation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.tails import chi2_tail, normal_tail
from stopwise.operators.quality import beside
from stopwise.operators.ranks import mid_ranks, ranked_values
from stopwise.workspace import staged


def _tie_term(n: Column) -> Column:
    """t^3 - t of each block of equal values, in doubles so large blocks do not overflow."""
    t = n.cast("double")
    return t * t * t - t


def mann_whitney(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Rows with ``flag`` = 1 against 0: U, tie- and continuity-corrected z, p, and Cohen's d."""
    both = df.filter(F.col(flag).isin(0, 1) & F.col(value).isNotNull()).select(value, flag)
    ranks = ranked_values(both, value, carry=[flag])
    one, zero = F.col(flag) == 1, F.col(flag) == 0
    v, n = F.col(value), F.col("n")
    # Rows per (value, flag): spreads and sums weight each by its count.
    sums = ranks.agg(
        F.sum(F.when(one, n).otherwise(0)).alias("n1"),
        F.sum(F.when(zero, n).otherwise(0)).alias("n0"),
        F.sum(F.when(one, n * F.col("avg_rank"))).alias("r1"),
        F.sum(_tie_term(F.col("ties")) * n / F.col("ties")).alias("tie"),
    )
    spread = both.agg(
        F.avg(F.when(one, v)).alias("m1"),
        F.avg(F.when(zero, v)).alias("m0"),
        F.var_samp(F.when(one, v)).alias("v1"),
        F.var_samp(F.when(zero, v)).alias("v0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    shared = F.when(total > 1, F.col("tie") / (total * (total - 1))).otherwise(0.0)
    sd = F.sqrt(n1 * n0 / 12 * ((total + 1) - shared))
    excess = F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5
    z = F.when(sd > 0, excess / sd)
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    d = F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled)
    out = beside(sums, spread).select("n1", "n0", u.alias("u"), z.alias("z"), d.alias("cohen_d"))
    return out.withColumn("p_value", normal_tail(F.col("z"))).withColumn(
        "effect", F.when(F.abs("cohen_d") < 0.2, "negligible").otherwise("noticeable")
    )


def kruskal_wallis(df: DataFrame, value: str, group: str, min_n: int = 1) -> DataFrame:
    """H over the groups with ``min_n`` rows or more."""
    known = df.filter(F.col(value).isNotNull()).select(value, group)
    large = known.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_n)
    rows = known.join(large.select(group), group, "left_semi")
    ranks = ranked_values(rows, value, carry=[group])
    n = F.col("n")
    per_group = ranks.groupBy(group).agg(
        F.sum(n).cast("double").alias("n"),
        F.sum(n * F.col("avg_rank")).alias("r"),
        F.sum(_tie_term(F.col("ties")) * n / F.col("ties")).alias("tie"),
    )
    total = F.sum("n")
    h = 12 / (total * (total + 1)) * F.sum(F.col("r") * F.col("r") / n) - 3 * (total + 1)
    corrected = h / (1 - F.sum("tie") / (total * total * total - total))
    out = per_group.agg(corrected.alias("h"), F.count("*").alias("groups"))
    return out.withColumn("p_value", chi2_tail(F.col("h"), F.col("groups") - 1))


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, rho) of each column with the target over the rows where both are known.

    Ranks are taken from tables with one row per distinct value. Every row moves once, to the ranks of
    its target; behind that, each value of a column only adds up what it meets, however frequent it is.
    Ranks are counted from their mean, so a constant side has a spread of exactly 0.
    """
    value = {c: f"_{i}" for i, c in enumerate(columns)}
    wide = df.select(
        F.col(target).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(v) for c, v in value.items()],
    ).filter("y IS NOT NULL")
    counts = wide.groupBy("y").agg(
        F.count("*").alias("_all"), *[F.count(v).alias(v) for v in value.values()]
    )
    counts = staged(counts, "target-counts")
    known = counts.agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).first().asDict()
    # columns known in every row share the ranks of the target
    weight = {v: "_all" if known[v] == known["_all"] else v for v in value.values()}
    weights = sorted({*weight.values()})
    centred = {
        f"{w}_r": F.col(f"{w}_rank") - F.lit(((known[w] or 0) + 1) / 2) for w in weights
    }
    ranks = mid_ranks(counts, "y", weights).select("y", *[r.alias(k) for k, r in centred.items()])
    met = wide.join(ranks, "y").select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.col(v).alias("x"), F.col(f"{weight[v]}_r").alias("b"))
                    for i, v in enumerate(value.values())
                ]
            )
        )
    )
    b = F.col("b")
    sums = (
        met.filter("x IS NOT NULL")
        .groupBy("i", "x")
        .agg(F.count("*").alias("n"), F.sum(b).alias("sb"), F.sum(b * b).alias("sbb"))
    )
    sums = mid_ranks(staged(sums, "value-sums"), "x", ["n"], ["i"])
    middle = F.get(F.array(*[F.lit(((known[v] or 0) + 1) / 2) for v in value.values()]), F.col("i"))
    a = F.col("n_rank") - middle
    out = sums.groupBy("i").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * a * a).alias("va"),
        F.sum("sbb").alias("vb"),
        F.sum(a * F.col("sb")).alias("vab"),
    )
    va, vb = F.col("va"), F.col("vb")
    rho = F.when((va > 0) & (vb > 0), F.col("vab") / F.sqrt(va) / F.sqrt(vb))
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(F.get(names, F.col("i")).alias("column"), "n", rho.alias("rho"))
