"""Models with random effects of nested groups, such as centres within
countries. Data and effects stay in Spark; the driver holds matrices of the
number of covariates and the variances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.special import chi2_one, normal_two_sided
from trajspark.operators.regression import COEF
from trajspark.operators.scan import (CHUNKED, HOT_ROWS, PLAIN, remaining_sum,
                                      running_sum)
from trajspark.session import cut_lineage, written


def summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum of the vectors that `run` makes of the batches of each task, added
    up in a tree of tasks."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += run(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    return (rows.mapInArrow(one, "v binary").rdd
            .map(lambda r: np.frombuffer(r[0]).copy())
            .treeReduce(lambda a, b: a + b, 3))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(
        len(column), -1)


def group_sums(df: DataFrame, columns, levels) -> DataFrame:
    """Rows (m) and sums of columns (r) of the innermost groups."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    z = array_to_vector(F.array(*columns))
    return (df.select(*levels, z.alias("z")).groupBy(*levels)
            .agg(F.array(F.count(F.lit(1)).cast("double")).alias("m"),
                 vector_to_array(Summarizer.sum(F.col("z"))).alias("r")))


def eliminated(nodes: DataFrame, ratios: np.ndarray, q: int, up: list[str]):
    """One level of random effects taken out, for each ratio of its variance
    to the residual one.

    A node has the mass m and the sums r of what lies below it (one each, or
    one per ratio). Its effect takes ratio / (1 + ratio m) r r' from the cross
    products and adds log(1 + ratio m) to the determinant; m and r shrink by
    1 + ratio m and are added to the group above, of columns `up`. Returns
    these sums of all nodes, and the nodes above.
    """
    k = len(ratios)

    def spread(b):
        m, r = _matrix(b.column(0)), _matrix(b.column(1))
        return m, r.reshape(len(m), -1, q), 1.0 + m * ratios

    def taken(b):
        m, r, one = spread(b)
        out = np.zeros((k, q * q + 1))
        for i in range(k):
            x = r[:, min(i, r.shape[1] - 1)]
            out[i, :-1] = (x.T @ (x * (ratios[i] / one[:, i])[:, None])) \
                .ravel()
            out[i, -1] = np.log(one[:, i]).sum()
        return out.ravel()

    own = summed(nodes.select("m", "r"), taken, k * (q * q + 1)) \
        .reshape(k, -1)
    if not up:
        return own, None

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, r, one = spread(b)
            m, r = m / one, r / one[:, :, None]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array(list(np.concatenate(
                    [m, r.reshape(len(m), -1)], axis=1)))], [*up, "v"])

    # Parts of a group are added up before they meet, so no group is large.
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in up]
    above = (nodes.select("m", "r", *up)
             .mapInArrow(shrunk, ", ".join([*kinds, "v array<double>"]))
             .select(*up, array_to_vector("v").alias("v")).groupBy(*up)
             .agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
             .select(*up, F.slice("v", 1, k).alias("m"),
                     F.slice("v", k + 1, k * q).alias("r")))
    return own, above


def _lowest(value: dict, axes, size: int) -> np.ndarray:
    """Where the parabola through values at the steps -1, 0 and 1 along some
    axes is lowest; NaN when it has no lowest place."""
    def at(*steps):
        m = [0] * size
        for axis, s in steps:
            m[axis] += s
        return value[tuple(m)]

    slope = np.array([(at((i, 1)) - at((i, -1))) / 2 for i in axes])
    bend = np.zeros((len(axes), len(axes)))
    for a, i in enumerate(axes):
        bend[a, a] = at((i, 1)) - 2 * at() + at((i, -1))
        for b, j in enumerate(axes[:a]):
            bend[a, b] = bend[b, a] = (
                at((i, 1), (j, 1)) - at((i, 1), (j, -1))
                - at((i, -1), (j, 1)) + at((i, -1), (j, -1))) / 4
    out = np.zeros(size)
    if np.linalg.eigvalsh(bend).min() <= 0:
        out[axes] = np.nan
    else:
        out[axes] = -np.linalg.solve(bend, slope)
    return out


def mixed_model(df: DataFrame, y: str, xs, levels, reml: bool = True,
                tol: float = 1e-4, max_rounds: int = 40) -> DataFrame:
    """Linear model with a random intercept for each of nested groups.

    `levels` names the groups from the innermost, such as centre and country;
    a group of the same name in two outer groups counts as two. Estimates are
    by restricted maximum likelihood, or maximum likelihood. The likelihood of
    given variance ratios needs sums per group only: effects are taken out
    level by level, the innermost first, each level in one pass over its
    groups for many ratios at once: first one for each decade and zero, then
    the neighbours of the best, whose parabola gives the next one, until it
    moves by `tol` decades. Rows with anything missing are left
    out. Returns the coefficients with Wald tests and the variances
    (`var_<level>`, `var_residual`).
    """
    xs, levels = list(xs), list(levels)
    outer = [levels[i + 1:] for i in range(len(levels))]
    # Plain columns first: conditions on many derived ones plan for long.
    rows = cut_lineage(df.select(*levels, *xs, y)).select(
        *levels, F.lit(1.0).alias("__one"),
        *[F.col(c).cast("double").alias(c) for c in [*xs, y]]).na.drop()
    columns = ["__one", *xs, y]
    q, p = len(columns), len(columns) - 1

    def cross(b):
        z = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
        return (z.T @ z).ravel()

    total = summed(rows.select(*columns), cross, q * q).reshape(q, q)
    n = total[0, 0]
    if n <= p:
        raise ValueError("there are fewer rows than coefficients")
    leaves = cut_lineage(group_sums(rows, columns, levels))

    def fits(points: np.ndarray) -> list[tuple]:
        """Deviance, coefficients, their inverse information and the residual
        variance at each point (decades of the ratios by level)."""
        ratios = 10.0 ** points
        left, logs, nodes = np.repeat(total[None], len(points), 0), 0.0, leaves
        for i, up in enumerate(outer):
            own, nodes = eliminated(nodes, ratios[:, i], q, up)
            left = left - own[:, :-1].reshape(-1, q, q)
            logs = logs + own[:, -1]
        out = []
        for a, log in zip(left, logs):
            inverse = np.linalg.pinv(a[:p, :p], hermitian=True)
            beta = inverse @ a[:p, p]
            rss = max(a[p, p] - beta @ a[:p, p], 1e-12)
            free = n - p if reml else n
            dev = free * np.log(rss / free) + log
            if reml:
                dev += np.linalg.slogdet(a[:p, :p])[1]
            out.append((dev, beta, inverse, rss / free))
        return out

    def best_of(points):
        found = fits(points)
        at = int(np.argmin([f[0] for f in found]))
        return points[at], found[at], np.array([f[0] for f in found])

    # A ratio matters where it reaches one over the rows of a group.
    decades = [-np.inf, *range(-math.ceil(math.log10(n)) - 1, 3)]
    best, fit, _ = best_of(np.stack(np.meshgrid(
        *[decades] * len(levels), indexing="ij"), -1)
        .reshape(-1, len(levels)))
    free = np.isfinite(best)  # the others have no variance
    step, moves = .5, np.stack(np.meshgrid(
        *[(-1, 0, 1) if f else (0,) for f in free], indexing="ij"), -1) \
        .reshape(-1, len(levels))
    for _ in range(max_rounds):
        if not free.any():
            break
        at, fit, dev = best_of(best + step * moves)
        value = {tuple(m): d for m, d in zip(moves.tolist(), dev)}
        jump = step * _lowest(value, np.flatnonzero(free), len(levels))
        inside = np.abs(jump).max() <= step
        new = best + np.clip(jump, -2 * step, 2 * step) \
            if np.isfinite(jump).all() else at
        moved, best = np.abs(new - best)[free].max(), new
        if inside and moved <= tol:
            fit = fits(best[None])[0]
            break
        if inside:
            step = max(step / 5.0, tol)
    else:
        raise ArithmeticError("mixed_model has not converged")
    _, beta, inverse, var = fit
    err = np.sqrt(np.clip(np.diag(inverse), 0.0, None) * var)
    out = [(t, float(b), float(e), float(b / e) if e > 0 else None,
            chi2_one((b / e) ** 2) if e > 0 else None)
           for t, b, e in zip(["intercept", *xs], beta, err)]
    for c, x in zip(levels, best):
        out.append((f"var_{c}", float(10.0 ** x * var), None, None, None))
    out.append(("var_residual", float(var), None, None, None))
    return df.sparkSession.createDataFrame(out, COEF)



def cox_groups(df: DataFrame, time: str, status: str, xs, group: str,
               variance: float | None = None, max_iter: int = 100,
               tol: float = 1e-4) -> DataFrame:
    """Proportional hazards (Breslow ties) with a random effect per group.

    Maximises the partial likelihood less sum(u^2) / (2 variance). A round
    sums the hazard up to each time from its risk sets, gives each row its
    expected events w, and sums w, observed less expected, and w x by group.
    The effects are taken out of the covariates' equations group by group, so
    the driver solves a system of the covariates only; then each effect is
    updated by its own sums. The gradient is exact, so are the estimates; the
    information (and with it the standard errors) takes the mean covariates of
    all risk sets for those of each. Without a given variance it is that at
    which it equals the mean of u^2 and of its uncertainty, until a round
    changes it by half a percent and 0.0001 at most. Rows with anything
    missing are left out. Returns coefficients and `var_<group>`.
    """
    xs = list(xs)
    p = len(xs) + 1
    raw = cut_lineage(df.select(group, time, status, *xs)).na.drop()
    means = raw.agg(*[F.avg(F.col(x).cast("double")).alias(x)
                      for x in xs]).first()
    rows = cut_lineage(raw.select(
        F.col(group).alias("g"), F.col(time).cast("double").alias("t"),
        F.col(status).cast("double").alias("d"),
        F.array(F.lit(1.0), *[F.col(x).cast("double")
                              - F.lit(float(means[x])) for x in xs])
        .alias("x")))
    effects = cut_lineage(rows.select("g").distinct()
                          .withColumn("u", F.lit(0.0)))
    groups = effects.count()
    # Times are few or not: one task orders them, or chunks of them do.
    scan = PLAIN if rows.select("t").distinct().count() <= HOT_ROWS \
        else CHUNKED
    beta, size = np.zeros(p), variance if variance is not None else 0.5
    trail: list[float] = []

    def cross(b):
        x, w = _matrix(b.column(0)), b.column(1).to_numpy()
        return (x.T @ (x * w[:, None])).ravel()

    for _ in range(max_iter):
        score = F.aggregate(
            F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta]),
                       lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        now = rows.join(effects, "g").withColumn("e", F.exp(score
                                                            + F.col("u")))
        risk = scan.add(
            now.groupBy(F.lit(1).alias("__all"), "t").agg(
                F.sum("d").alias("died"), F.sum("e").alias("e")),
            ["__all"], ["t"], left=remaining_sum("e"))
        hazard = scan.add(
            risk.withColumn("h", F.col("died") / F.col("left")),
            ["__all"], ["t"], hazard=running_sum("h")).select("t", "hazard")
        now = cut_lineage(now.join(hazard, "t").withColumn(
            "w", F.col("hazard") * F.col("e")).select("g", "d", "x", "w", "u"))
        square = summed(now.select("x", "w"), cross, p * p).reshape(p, p)
        per = cut_lineage(_per_group(now))

        def taken(b, size=size):
            m = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            c = _matrix(b.column(3))
            r = _matrix(b.column(4)).sum(0)
            h = m[:, 0] + 1.0 / size
            g = m[:, 1] - m[:, 2] / size
            return np.concatenate([
                (c.T @ (c / h[:, None])).ravel(), c.T @ (g / h), r,
                (c.T @ (c / (h * h)[:, None])).ravel(),
                [(1.0 / h).sum(), (m[:, 2] ** 2).sum()]])

        parts = summed(per.select("w", "o", "u", "c", "r"), taken,
                       2 * p * p + 2 * p + 2)
        a, b, r, s, (spread, squares) = np.split(
            parts, np.cumsum([p * p, p, p, p * p]))
        inverse = np.linalg.pinv(square - a.reshape(p, p), hermitian=True)
        step = inverse @ (r - b)
        beta = np.append(0.0, (beta + step)[1:])
        moved = (F.col("o") - F.col("u") / size - F.aggregate(
            F.zip_with("c", F.array(*[F.lit(float(v)) for v in step]),
                       lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
                 ) / (F.col("w") + 1.0 / size)
        old, effects = effects, written(
            per.select("g", (F.col("u") + moved).alias("u")))
        far = effects.join(old.withColumnRenamed("u", "v"), "g").agg(
            F.max(F.abs(F.col("u") - F.col("v")))).first()[0] or 0.0
        was = size
        if variance is None:
            size = max((squares + spread + np.trace(
                inverse @ s.reshape(p, p))) / groups, 1e-6)
            trail = [*trail[-2:], size]
        if max(np.abs(step[1:]).max(initial=0.0), far) < tol \
                and abs(size - was) <= 5e-3 * was + 1e-4:
            break
        if len(trail) == 3:
            # Steps shrink at an even rate: go to where they end.
            first, second = np.diff(trail)
            if 0 < second / (first or 1.0) < 1:
                end = trail[1] + second / (1 - second / first)
                size = float(np.clip(end, size / 4, size * 4))
            trail = []
    else:
        raise ArithmeticError("cox_groups has not converged")
    out = []
    for x, v, e in zip(xs, beta[1:], np.sqrt(np.clip(np.diag(inverse)[1:], 0,
                                                     None))):
        z = v / e if e > 0 else None
        out.append((x, float(v), float(e), z and float(z),
                    z and normal_two_sided(z)))
    out.append((f"var_{group}", float(size), None, None, None))
    return df.sparkSession.createDataFrame(out, COEF)


def _per_group(now: DataFrame) -> DataFrame:
    """By group: expected events (w), observed less expected (o), its effect
    (u), and sums of the covariates times w (c) and times d - w (r)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    times = lambda c: array_to_vector(F.transform("x", lambda v: v * c))
    total = lambda c: vector_to_array(Summarizer.sum(c))
    return (now.select("g", "d", "w", "u", times(F.col("w")).alias("c"),
                       times(F.col("d") - F.col("w")).alias("r"))
            .groupBy("g").agg(
                F.sum("w").alias("w"), F.sum(F.col("d") - F.col("w")).alias("o"),
                F.first("u").alias("u"), total(F.col("c")).alias("c"),
                total(F.col("r")).alias("r")))
