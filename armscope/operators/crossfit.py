"""Linear predictions of an outcome that no row's own outcome has shaped.

One pass sums the normal equations, X'X and X'y, of each experiment and fold. The fit that a fold's rows get is solved
from the total less that fold, in tasks; a second pass scores the rows. So a covariate made of the outcomes it is
to adjust stays independent of each row's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.operators.joins import same_keys

#: Sums of so many (experiment, fold) pairs are kept in a task before they are passed on.
_HELD = 256


def with_intercept(*columns: str | Column) -> Column:
    """The regressors as an array: 1, then the columns."""
    return F.array(F.lit(1.0), *[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def gram_sums(rows: DataFrame, groups: Sequence[str], label: str, x: str) -> DataFrame:
    """(groups, n, sums): X'X row by row, then X'y, of each group; rows with a null label or regressor take no part.

    All rows of a group have regressors of one length. Every task adds up its rows in matrix products; of each group
    it passes on one row.
    """
    groups = list(groups)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*groups).schema]
    there = F.col(label).isNotNull() & F.col(x).isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull()), F.lit(False))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def passed() -> pd.DataFrame:
            out = pd.DataFrame([(*key, v[0], v[1:].tolist()) for key, v in held.items()], columns=[*groups, "n", "sums"])
            held.clear()
            return out

        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                m, y = np.stack(part[x].to_numpy()), part[label].to_numpy(float)
                own = np.concatenate([[len(y)], (m.T @ m).ravel(), m.T @ y])
                held[key] = held[key] + own if key in held else own
            if len(held) > _HELD:
                yield passed()
        if held:
            yield passed()

    partial = rows.where(there).select(*groups, F.col(label).cast("double").alias(label), x).mapInPandas(
        add, ", ".join([*kinds, "n double, sums array<double>"])
    )
    counts = partial.groupBy(*groups).agg(F.sum("n").cast("bigint").alias("n"))
    cells = partial.select(*groups, F.posexplode("sums").alias("at", "v")).groupBy(*groups, "at").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"))
    key = F.struct(*groups).alias("_key")
    return whole.select("*", key).join(counts.select("n", key), "_key").drop("_key").select(*groups, "n", "sums")


def left_out_fits(sums: DataFrame, keys: Sequence[str], fold: str, ridge: float) -> DataFrame:
    """(keys, fold, n, beta): for each fold the least squares fit on all other folds; null beta if it has no solution.

    ``ridge`` is added to the diagonal, but for the intercept.
    """
    keys = list(keys)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys, fold).schema]
    names = [*keys, fold, "n", "beta"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                each = [(f["fold"], f["n"], np.array(f["sums"], float)) for f in row["folds"]]
                total = sum(s for _, _, s in each)
                n = sum(count for _, count, _ in each)
                d = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
                for number, count, own in each:
                    left = total - own
                    a = left[: d * d].reshape(d, d) + ridge * np.diag([0.0] + [1.0] * (d - 1))
                    scale = np.sqrt(np.maximum(np.diag(a), 0))
                    beta = None
                    if (scale > 0).all() and np.linalg.cond(a / np.outer(scale, scale)) < 1e13:
                        beta = np.linalg.solve(a, left[d * d :]).tolist()
                    out.append({**{k: row[k] for k in keys}, fold: number, "n": n - count, "beta": beta})
            yield pd.DataFrame(out, columns=names)

    # as many entries as there are folds
    listed = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col(fold).alias("fold"), "n", "sums")).alias("folds"))
    return listed.mapInPandas(solve, ", ".join([*kinds, "n bigint, beta array<double>"]))


def group_fits(sums: DataFrame, groups: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """(groups, n, beta): the least squares fit of each group; null beta if it has no solution."""
    whole = sums.withColumn("_none", F.lit(-1))
    # a fold of its own, without rows, sees all others
    none = whole.select(*groups, F.lit(0).cast("bigint").alias("n"), F.transform("sums", lambda _: F.lit(0.0)).alias("sums"), F.lit(-2).alias("_none"))
    fits = left_out_fits(whole.unionByName(none, allowMissingColumns=True), groups, "_none", ridge)
    return fits.where("_none = -2").select(*groups, "n", "beta")


def cross_fitted(
    rows: DataFrame, keys: Sequence[str], label: str, x: str, fold: str = "fold", ridge: float = 0.0, out: str = "score"
) -> DataFrame:
    """``rows`` with the linear prediction of ``label`` from ``x`` (array, intercept included) by the other folds' fit.

    Null where a regressor is null, or the fit has no solution.
    """
    fits = left_out_fits(gram_sums(rows, [*keys, fold], label, x), keys, fold, ridge)
    known = fits.select(*[F.col(g).alias(f"_fit{i}") for i, g in enumerate([*keys, fold])], F.col("beta").alias("_beta"))
    joined = rows.join(known, same_keys([*keys, fold], "_fit"), "left")
    product = F.aggregate(F.zip_with("_beta", x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn(out, product).select(*rows.columns, out)
