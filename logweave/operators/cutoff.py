"""Exact score cutoffs without a global sort.

``nth_largest`` finds the exact n-th largest value of a column by narrowing:
approximate quantiles (a bounded sketch) give two values around the answer, one
counting pass tells whether the answer is below, at, between, or above them,
and the next round looks at the open interval that holds it.  Rows equal to a
probe leave with it, so ties shrink the band like other rows, however many they
are; a round keeps about 4/10000 of its rows.  Only a band of at most
``ORDERED_ROWS`` rows is put in order.  The scalar cutoff is then compared with
every row as a literal (J5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10000
ORDERED_ROWS = 10_000   # a band this small is ordered in one task


def _kth_smallest(df: DataFrame, col: str, k: int, n_total: int):
    """Exact k-th smallest (1-based) of non-null ``col``; ``n_total`` rows.  The
    values must be exact as doubles, so that a probe equals the value it stands for."""
    c = F.col(col)
    band, r, nb = df, k, n_total
    while nb > ORDERED_ROWS:
        m = 2.0 * nb / ACCURACY + 1
        probes = [min(1.0, max(0.0, p)) for p in ((r - m) / nb, (r + m) / nb)]
        lo, hi = band.agg(F.percentile_approx(c, probes, ACCURACY).alias("q")).first()["q"]
        below, upto_lo, under_hi, upto_hi = band.agg(
            F.count_if(c < lo), F.count_if(c <= lo), F.count_if(c < hi), F.count_if(c <= hi)).first()
        if r <= below:
            band, nb = band.filter(c < lo), below
        elif r <= upto_lo:
            return lo
        elif r <= under_hi:
            band, r, nb = band.filter((c > lo) & (c < hi)), r - upto_lo, under_hi - upto_lo
        elif r <= upto_hi:
            return hi
        else:
            band, r, nb = band.filter(c > hi), r - upto_hi, nb - upto_hi
    return band.select(c).orderBy(c.asc()).limit(r).agg(F.max(c)).first()[0]


def nth_largest(df: DataFrame, col: str, n: int, n_total: int | None = None) -> float:
    """Exact n-th largest (1-based) non-null value of ``col``."""
    base = df.select(col).filter(F.col(col).isNotNull())
    N = n_total if n_total is not None else base.count()
    if not 1 <= n <= N:
        raise ValueError(f"n={n} outside 1..{N}")
    if n <= N // 2:
        # Nearer the top: select among the negated values (smaller band).
        neg = base.select((-F.col(col)).alias(col))
        return -float(_kth_smallest(neg, col, n, N))
    return float(_kth_smallest(base, col, N - n + 1, N))


def nth_largest_weighted(df: DataFrame, col: str, weight: str, n: int, parts: int = 32) -> float:
    """Exact n-th largest (1-based) value of ``col``, each row counting ``weight``
    times.  Quantiles of the rows split their values into ``parts``; one pass adds up
    the weights above each split, and the part that holds the answer is split
    again, until it is small enough to be put in order."""
    c, w = F.col(col), F.col(weight)
    band, r = df.select(c, w).where(c.isNotNull() & (w > 0)), n
    while True:
        rows, q = band.agg(F.count(F.lit(1)), F.percentile_approx(c, [i / parts for i in range(1, parts)], ACCURACY)).first()
        if rows <= ORDERED_ROWS:
            for row in band.groupBy(c).agg(F.sum(w).alias("w")).orderBy(c.desc()).collect():
                r -= row["w"]
                if r <= 0:
                    return float(row[0])
            raise ValueError(f"n={n} outside the weights")
        splits = sorted(set(q), reverse=True)
        sums = band.agg(*[F.coalesce(F.sum(F.when(c > s, w)), F.lit(0)) for s in splits],
                        *[F.coalesce(F.sum(F.when(c >= s, w)), F.lit(0)) for s in splits]).first()
        above, reached = sums[:len(splits)], sums[len(splits):]
        upper = None
        for s, a, b in zip(splits, above, reached):
            if r <= a:
                break
            if r <= b:
                return float(s)
            upper, passed = s, b
        else:
            band, r = band.where(c < splits[-1]), r - reached[-1]
            continue
        band = band.where(c > s) if upper is None else band.where((c > s) & (c < upper))
        r = r if upper is None else r - passed


def budget(contamination: float, n_total: int, clamp_below_total: bool = True) -> int:
    """T6/T7 budget: ``max(1, round(c * N))`` (half-even, like Python);
    ``clamp_below_total`` keeps it <= N - 1 (the batch detector's rule)."""
    n = max(1, int(round(contamination * n_total)))
    if clamp_below_total:
        n = min(n, max(1, n_total - 1))
    return min(n, n_total)


def materialize(scores: DataFrame) -> DataFrame:
    """Cut the lineage of a score table that several passes read: a reliable
    checkpoint in the cluster's checkpoint folder (survives executor loss)."""
    return scores.checkpoint(eager=True)


def flag_ge_cutoff(scores: DataFrame, col: str, n: int | None = None,
                   contamination: float | None = None, out: str = "is_anomaly",
                   clamp_below_total: bool = True, checkpoint: bool = True) -> DataFrame:
    """T6 + J5: cutoff = n-th largest score; flag ``score >= cutoff`` (ties
    at the cutoff are all flagged, so more than n rows can be flagged).
    The score table is checkpointed first (``checkpoint``) because the count,
    the selection and the flagging each read it."""
    if checkpoint:
        scores = materialize(scores)
    N = scores.filter(F.col(col).isNotNull()).count()
    if N == 0:
        return scores.withColumn(out, F.lit(False))
    if n is None:
        n = budget(contamination, N, clamp_below_total)
    n = max(1, min(n, N))
    cut = nth_largest(scores, col, n, N)
    return scores.withColumn(out, F.coalesce(F.col(col) >= F.lit(cut), F.lit(False)))


def _chunk(key: str, number: int) -> Column:
    """Bytes 6*number .. 6*number+5 of a text, and how many there are, as a number
    that sorts like them and is exact as a double (the quantile sketch holds doubles)."""
    part = F.substring(F.encode(F.col(key), "UTF-8"), 6 * number + 1, 6)
    value = F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("long")
    return value * 8 + F.length(part)


def _kth_smallest_key(df: DataFrame, key: str, k: int, n_total: int) -> str:
    """k-th smallest value of a text key: the same selection on six bytes at a
    time, each round among the keys that share the bytes found so far."""
    band, r, nb, number = df.select(key), k, n_total, 0
    while nb > ORDERED_ROWS:
        ranked = band.select(key, _chunk(key, number).alias("_v"))
        v = _kth_smallest(ranked.select("_v"), "_v", r, nb)
        below, same = ranked.agg(F.count_if(F.col("_v") < v), F.count_if(F.col("_v") == v)).first()
        band, r, nb, number = ranked.filter(F.col("_v") == v).select(key), r - below, same, number + 1
        if v % 8 < 6:       # these keys end here: all are equal
            break
    return band.orderBy(key).limit(min(r, ORDERED_ROWS)).agg(F.max(key)).first()[0]


def flag_exact_n(scores: DataFrame, col: str, key: str, n: int | None = None,
                 contamination: float | None = None, out: str = "is_anomaly",
                 checkpoint: bool = True) -> DataFrame:
    """Flag exactly n rows — the largest scores, ties by ``key`` ascending.

    ``n`` is clamped to 1..N.  Rows above the n-th value are flagged; among
    the rows equal to it, the smallest keys fill the remaining budget.
    """
    if checkpoint:
        scores = materialize(scores)
    N = scores.filter(F.col(col).isNotNull()).count()
    if N == 0:
        return scores.withColumn(out, F.lit(False))
    if n is None:
        n = int(round(contamination * N))
    n = max(1, min(n, N))
    v = nth_largest(scores, col, n, N)
    c = F.col(col)
    cnt = scores.agg(F.count_if(c > F.lit(v)).alias("gt"), F.count_if(c == F.lit(v)).alias("eq")).first()
    need = n - cnt["gt"]
    if need >= cnt["eq"]:
        flag = c >= F.lit(v)
    else:
        kmax = _kth_smallest_key(scores.filter(c == F.lit(v)), key, need, cnt["eq"])
        flag = (c > F.lit(v)) | ((c == F.lit(v)) & (F.col(key) <= F.lit(kmax)))
    return scores.withColumn(out, F.coalesce(flag, F.lit(False)))

