"""Statistical column expressions (JVM-side, no UDF).

* :func:`pearson` – Pearson r over pairwise-complete rows, NULL (not an
  error, not NaN) when either side is constant.
* :func:`t_two_sided_p` – two-sided p-value of a correlation/slope with
  ``nu`` degrees of freedom, by the finite trigonometric series of the
  Student-t distribution for integer ``nu`` (Abramowitz & Stegun 26.7.3/4),
  evaluated with ``aggregate(sequence(...))``.
* :func:`skew_corrected` – bias-corrected sample skewness (pandas ``skew``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over rows where both ``a`` and ``b`` are present."""
    both = a.isNotNull() & b.isNotNull()
    am = F.when(both, a)
    bm = F.when(both, b)
    den = F.stddev_pop(am) * F.stddev_pop(bm)
    return F.when(den > 0, F.covar_pop(am, bm) / den)


def t_stat(r: Column, nu: Column) -> Column:
    """t of a correlation ``r`` with ``nu`` degrees of freedom (±inf at |r| = 1)."""
    return r * F.sqrt(nu / (F.lit(1.0) - r * r))


def t_two_sided_p(r: Column, nu: Column) -> Column:
    """Two-sided p of correlation ``r`` with integer ``nu`` ≥ 1 degrees of freedom.

    θ = atan(|t|/√ν) = atan(|r|/√(1−r²)) (independent of ν).
    ν = 1: p = 1 − 2θ/π;  ν even: p = 1 − sinθ·Σ_{k<ν/2} a_k cos^{2k}θ,
    a_0 = 1, a_k = a_{k−1}(2k−1)/(2k);  ν odd: p = 1 − (2/π)(θ + sinθ·
    Σ_{k≤(ν−3)/2} b_k cos^{2k+1}θ), b_0 = 1, b_k = b_{k−1}·2k/(2k+1).
    |r| = 1 gives p = 0; NULL r gives NULL.
    """
    th = F.atan2(F.abs(r), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - r * r)))
    c2 = F.pow(F.cos(th), 2)
    nu_i = nu.cast("int")

    def series(upper: Column, first: Column, ratio) -> Column:
        # Σ of term_k for k = 0..upper with term_0 = first, term_k = term_{k-1}·ratio(k)·cos²θ
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
        return F.aggregate(
            F.sequence(F.lit(0), upper), start,
            lambda acc, k: F.struct(
                (acc["s"] + F.when(k == 0, first).otherwise(acc["t"] * ratio(k) * c2)).alias("s"),
                F.when(k == 0, first).otherwise(acc["t"] * ratio(k) * c2).alias("t")),
        )["s"]

    even = F.lit(1.0) - F.sin(th) * series(
        F.floor(nu_i / 2).cast("int") - 1, F.lit(1.0),
        lambda k: (2 * k - 1).cast("double") / (2 * k).cast("double"))
    odd = F.lit(1.0) - (F.lit(2.0) / F.lit(3.141592653589793)) * (
        th + F.sin(th) * series(
            F.floor((nu_i - 3) / 2).cast("int"), F.cos(th),
            lambda k: (2 * k).cast("double") / (2 * k + 1).cast("double")))
    one = F.lit(1.0) - F.lit(2.0) * th / F.lit(3.141592653589793)
    p = (F.when(nu_i == 1, one)
         .when(nu_i % 2 == 0, even)
         .otherwise(odd))
    return F.when(r.isNull() | (nu_i < 1), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def skew_corrected(x: Column) -> Column:
    """Aggregate: adjusted Fisher–Pearson skewness √(n(n−1))/(n−2)·g1 (pandas
    ``skew``; DuckDB ``skewness``); NULL below 3 values or for a constant."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def skew_class(s: Column) -> Column:
    """Shape words of the source tool, by thresholds −1, −0.5, 0.5, 1."""
    return (F.when(s < -1, F.lit("negatively skewed (left-tailed)"))
            .when(s < -0.5, F.lit("slightly negatively skewed"))
            .when(s > 1, F.lit("positively skewed (right-tailed)"))
            .when(s > 0.5, F.lit("slightly positively skewed"))
            .otherwise(F.lit("normally distributed")))


# DuckDB forms of the same expressions, for the oracle SQL.
def sql_pearson(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / "
            f"(stddev_pop({a}) * stddev_pop({b})) END")


def sql_t_two_sided_p(r: str, nu: str) -> str:
    th = f"atan2(abs({r}), sqrt(greatest(0.0, 1.0 - ({r}) * ({r}))))"
    even = (f"1.0 - sin({th}) * list_sum(list_transform(range(0, CAST(({nu}) // 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({th}), 2 * k)))")
    odd = (f"1.0 - (2.0 / pi()) * ({th} + sin({th}) * coalesce(list_sum(list_transform("
           f"range(0, CAST((({nu}) - 3) // 2 + 1 AS BIGINT)), "
           f"lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2.0 * pow(cos({th}), 2 * k + 1))), 0.0))")
    one = f"1.0 - 2.0 * {th} / pi()"
    return (f"CASE WHEN ({r}) IS NULL OR ({nu}) < 1 THEN NULL ELSE greatest(0.0, least(1.0, "
            f"CASE WHEN ({nu}) = 1 THEN {one} WHEN ({nu}) % 2 = 0 THEN {even} ELSE {odd} END)) END")
