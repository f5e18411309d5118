"""Kaplan-Meier curves and the log-rank test (SRV-1, SRV-2, SRV-3, SCL-13).

Subjects are first reduced to one row per (group, time): events and subjects. Everything after
runs over those rows, never over the subjects themselves. Subjects that take no part are counted.

Formulas (Kaplan and Meier 1958; Greenwood 1926; Mantel 1966):
  n(t) = subjects with time >= t, S(t) = prod over times <= t of (1 - d/n),
  se(log S) = sqrt(sum d / (n (n - d))), limits exp(log S -/+ z se), the upper cut at 1;
  log-rank: E_g = sum d n_g / n, V_gh = sum d (n - d) / (n - 1) (n_g / n)(1[g = h] - n_h / n).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylink.operators.scan import drop_block, ordered_scan
from staylink.sources.stages import StageStore

Z975 = 1.959963984540054  # standard normal quantile for 95% limits


def _usable(time: str, event: str):
    """A time >= 0 and an event flag (negative times are DQ-7's business)."""
    return F.col(time).isNotNull() & (F.col(time) >= 0) & F.col(event).isNotNull()


def excluded_subjects(df: DataFrame, group: str, time: str = "time_to_next", event: str = "event") -> DataFrame:
    """What SRV-1 and SRV-3 leave out, counted: one row a group (null is one) with ``n_subjects,
    n_missing_time, n_negative_time, n_missing_event, n_excluded``. A subject counts under the first
    reason that holds; one without a group is excluded as a whole."""
    t, e, missing = F.col(time), F.col(event), F.col(group).isNull()
    return df.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("n_subjects"),
        F.count_if(t.isNull()).cast("long").alias("n_missing_time"),
        F.count_if(t < 0).cast("long").alias("n_negative_time"),
        F.count_if((t >= 0) & e.isNull()).cast("long").alias("n_missing_event"),
        F.count_if(missing | ~_usable(time, event)).cast("long").alias("n_excluded"),
    )


def km_table(df: DataFrame, group: str, time: str = "time_to_next", event: str = "event", *, continuous: bool = False,
             ranges: int | None = None, store: StageStore | None = None) -> DataFrame:
    """SRV-1: one row per group and distinct time: ``n_risk, n_event, n_censor, surv,
    se_log_surv, lower, upper``, and ``n_excluded``: the group's subjects that have no usable time or
    event and take no part. Once S reaches 0 the error and limits are null.

    Times in days are few: windows per group run over one row a day. ``continuous`` is for times
    of which a group may have very many (seconds): numbers at risk are then suffix sums and the
    curve a running product in ranges, and no task holds a group's times.
    """
    counted = (
        df.filter(F.col(group).isNotNull())
        .groupBy(group, F.when(_usable(time, event), F.col(time)).alias(time))
        .agg(F.sum(F.col(event)).cast("long").alias("n_event"), F.count(F.lit(1)).cast("long").alias("_m"))
    )
    # the one pass counts the excluded too, as a row without a time
    timed = F.col(time).isNotNull()
    d, n = F.col("n_event"), F.col("n_risk")
    step = {
        "surv": ("product", F.lit(1.0) - d / n),
        "_zero": ("max", (d == n).cast("int")),
        "_h": ("sum", F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))),
    }
    if continuous:
        # that row is its group's last: the sums from behind bring it to every time, without a join
        behind = {"n_risk": ("sum_from", F.when(timed, F.col("_m"))), "n_excluded": ("sum_from", F.when(~timed, F.col("_m")))}
        g = ordered_scan(counted, [group], [time], behind, ranges=ranges, store=store).filter(timed)
        g = drop_block(ordered_scan(g.withColumn("n_risk", n.cast("long")), [group], [time], step))
    else:
        left_out = counted.filter(~timed).select(group, F.col("_m").alias("n_excluded"))
        g = counted.filter(timed).join(left_out, group, "left")
        from_top = W.partitionBy(group).orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, W.currentRow)
        g = g.withColumn("n_risk", F.sum("_m").over(from_top).cast("long"))
        upto = W.partitionBy(group).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
        over = {"product": F.product, "max": F.max, "sum": F.sum}
        g = g.withColumns({name: over[kind](value).over(upto) for name, (kind, value) in step.items()})
    se = F.when(F.col("_zero") == 0, F.sqrt("_h"))
    g = g.withColumn("se_log_surv", se)
    log_s = F.log(F.col("surv"))
    return g.select(
        group,
        time,
        "n_risk",
        "n_event",
        (F.col("_m") - d).alias("n_censor"),
        "surv",
        "se_log_surv",
        F.exp(log_s - Z975 * F.col("se_log_surv")).alias("lower"),
        F.when(
            F.col("se_log_surv").isNotNull(), F.least(F.lit(1.0), F.exp(log_s + Z975 * F.col("se_log_surv")))
        ).alias("upper"),
        F.coalesce("n_excluded", F.lit(0)).cast("long").alias("n_excluded"),
    )


def km_median(km: DataFrame, group: str, time: str = "time_to_next") -> DataFrame:
    """Median survival per group: the first time with S <= 0.5 (null if never)."""
    return km.groupBy(group).agg(F.min(F.when(F.col("surv") <= 0.5 + 1e-9, F.col(time))).alias("median_time"))


def km_at_times(km: DataFrame, group: str, times: Sequence[int], time: str = "time_to_next") -> DataFrame:
    """SRV-2: the curve at report times (the plot's ``break.time.by`` marks): S, limits and
    number at risk. S at t is the last step at or before t (1 before the first).

    The report times are added as extra rows per group (an explode, no join) and the
    curve is carried forward to them by a window: an as-of lookup without a range join.
    """
    grid = km.select(group).distinct().select(
        group, F.explode(F.array(*[F.lit(int(t)) for t in times])).alias(time), F.lit(1).alias("_grid")
    )
    steps = km.select(group, time, "surv", "lower", "upper", "n_risk", F.lit(0).alias("_grid"))
    u = steps.unionByName(grid, allowMissingColumns=True)
    back = W.partitionBy(group).orderBy(time, "_grid").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(group).orderBy(time, F.desc("_grid")).rowsBetween(W.currentRow, W.unboundedFollowing)
    u = u.withColumns(
        {
            "_s": F.last("surv", ignorenulls=True).over(back),
            "_lo": F.last("lower", ignorenulls=True).over(back),
            "_hi": F.last("upper", ignorenulls=True).over(back),
            "_zero": F.max(F.when(F.col("surv") == 0, 1).otherwise(0)).over(back),
            "_nr": F.first("n_risk", ignorenulls=True).over(ahead),
        }
    )
    first = F.col("_s").isNull()
    return u.filter(F.col("_grid") == 1).select(
        group,
        F.col(time).cast("int").alias(time),
        F.coalesce(F.col("_s"), F.lit(1.0)).alias("surv"),
        F.when(first, F.lit(1.0)).when(F.col("_zero") == 0, F.col("_lo")).alias("lower"),
        F.when(first, F.lit(1.0)).when(F.col("_zero") == 0, F.col("_hi")).alias("upper"),
        F.coalesce(F.col("_nr"), F.lit(0)).cast("long").alias("n_risk"),
    )


def report_times(start: int = 0, stop: int = 1000, step: int = 200) -> list[int]:
    """SCL-13: ``seq(start, stop, by = step)``."""
    return list(range(start, stop + 1, step))


def logrank_parts(df: DataFrame, group: str, levels: Sequence[str], time: str = "time_to_next",
                  event: str = "event", *, ranges: int | None = None, store: StageStore | None = None) -> DataFrame:
    """SRV-3: per group: ``observed, expected`` and the row of the variance matrix
    (``v_0 .. v_{k-1}`` in the order of ``levels``).

    One row per distinct time with a column pair per group (the levels are given, so the
    conditional sums are one aggregation); numbers at risk are sums over later times, taken in
    ranges of the times (operators/scan.py), so no task holds all of them.

    What takes no part is counted in the same pass: ``n_excluded``, the level's subjects without
    a usable time or event, and ``n_unlisted`` (the same in every row), the subjects whose group is
    none of the levels, or missing.
    """
    k = len(levels)
    g = F.col(group)
    listed = F.coalesce(g.isin(list(levels)), F.lit(False))
    # the excluded are a row without a time
    counted = df.groupBy(F.when(_usable(time, event) & listed, F.col(time)).alias(time)).agg(
        *[F.count_if(g == lv).cast("long").alias(f"_m{i}") for i, lv in enumerate(levels)],
        *[F.sum(F.when(g == lv, F.col(event)).otherwise(0)).cast("long").alias(f"_d{i}") for i, lv in enumerate(levels)],
        F.count_if(~listed).cast("long").alias("_u"),
    )
    out = counted.filter(F.col(time).isNull()).agg(
        *[F.coalesce(F.sum(f"_m{i}"), F.lit(0)).alias(f"X{i}") for i in range(k)], F.coalesce(F.sum("_u"), F.lit(0)).alias("U")
    )
    per_time = counted.filter(F.col(time).isNotNull()).drop("_u")
    per_time = ordered_scan(per_time, [], [time], {f"_n{i}": ("sum_from", F.col(f"_m{i}")) for i in range(k)}, ranges=ranges, store=store)
    d = sum((F.col(f"_d{i}") for i in range(k)), F.lit(0))
    n = sum((F.col(f"_n{i}") for i in range(k)), F.lit(0))
    per_time = per_time.withColumns({"_d": d, "_n": n}).filter(F.col("_d") > 0)
    d, n = F.col("_d"), F.col("_n")
    w = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    sums = [F.sum(f"_d{i}").alias(f"O{i}") for i in range(k)]
    sums += [F.sum(d * F.col(f"_n{i}") / n).alias(f"E{i}") for i in range(k)]
    for i in range(k):
        for j in range(k):
            delta = 1.0 if i == j else 0.0
            sums.append(
                F.sum(w * (F.col(f"_n{i}") / n) * (F.lit(delta) - F.col(f"_n{j}") / n)).alias(f"V{i}_{j}")
            )
    tot = per_time.agg(*sums).crossJoin(F.broadcast(out))  # two rows of one
    rows = [
        F.struct(
            F.lit(lv).alias(group),
            F.col(f"O{i}").cast("double").alias("observed"),
            F.col(f"E{i}").alias("expected"),
            *[F.col(f"V{i}_{j}").alias(f"v_{j}") for j in range(k)],
            F.col(f"X{i}").cast("long").alias("n_excluded"),
            F.col("U").cast("long").alias("n_unlisted"),
        )
        for i, lv in enumerate(levels)
    ]
    return tot.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised upper incomplete gamma)."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1:  # series for the lower part
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for the upper part (modified Lentz)
    tiny = 1e-300
    b = z + 1 - a
    c = 1 / tiny
    dd = 1 / b
    h = dd
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        dd = an * dd + b
        dd = tiny if abs(dd) < tiny else dd
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        dd = 1 / dd
        delta = dd * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def logrank_test(parts: DataFrame) -> dict:
    """Chi-square, degrees of freedom and p-value from :func:`logrank_parts`.

    The k x k matrix is the only thing brought to the driver (k = number of groups);
    u' V^-1 u is solved there with the last group left out.
    """
    import numpy as np

    rows = parts.collect()
    # A group with no subjects at risk at any event time takes no part (as in survdiff).
    keep = [i for i, r in enumerate(rows) if r["expected"] > 0 or r["observed"] > 0]
    k = len(keep)
    if k < 2:
        return {"chi2": float("nan"), "df": 0, "p": float("nan")}
    u = np.array([rows[i]["observed"] - rows[i]["expected"] for i in keep])[: k - 1]
    v = np.array([[rows[i][f"v_{j}"] for j in keep] for i in keep])[: k - 1, : k - 1]
    chi2 = float(u @ np.linalg.solve(v, u))
    return {"chi2": chi2, "df": k - 1, "p": chi2_sf(chi2, k - 1)}
