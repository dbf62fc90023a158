"""Regressions of many groups at once: Newton steps as grouped sums, solved in tasks.

The state of all fits is a table with a row a group (an experiment, or an experiment and a fold). A step joins
it to the rows, sums the information matrix, the gradient and the log-likelihood of each group with partial
aggregation in every task, and solves the small systems of the groups in tasks. The driver gets one number a
step: how many fits are still open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.operators.joins import same_keys
from armscope.session import cached, discard, written

OPEN, CONVERGED, SINGULAR, ENDED = "open", "converged", "singular", "not_converged"
#: A normalised information matrix beyond this has no inverse worth reporting.
_WORST_CONDITION = 1e12
_HALVINGS = 12


def advance(row: dict, k: int, tol: float) -> dict:
    """One step of one fit: ``row`` has the state and the sums at ``beta``; gives the state of the next step.

    A step that lowers the log-likelihood is halved. Standardised by its diagonal, a matrix that can't be
    inverted ends the fit: an empty arm, a constant column, or outcomes that the columns separate.
    """
    beta = np.array(row["beta"], float)
    held = None if row["held"] is None else np.array(row["held"], float)
    if not np.isfinite(row["ll"]) or (held is not None and row["ll"] < row["held_ll"] - 1e-9 * abs(row["held_ll"])):
        if held is None or row["halvings"] >= _HALVINGS:
            return {**row, "status": SINGULAR}
        return {**row, "beta": (held + (beta - held) / 2).tolist(), "halvings": row["halvings"] + 1}
    information = np.zeros((k, k))
    upper = np.triu_indices(k)
    information[upper] = row["cells"]
    information = information + np.triu(information, 1).T
    scale = np.sqrt(np.diag(information))
    if not np.isfinite(information).all() or (scale <= 0).any():
        return {**row, "status": SINGULAR}
    normal = information / np.outer(scale, scale)
    if np.linalg.cond(normal) > _WORST_CONDITION:
        return {**row, "status": SINGULAR}
    covariance = np.linalg.inv(normal) / np.outer(scale, scale)
    step = covariance @ np.array(row["slope"], float)
    if (np.abs(step) <= tol * (1 + np.abs(beta))).all():
        done = {"beta": (beta + step).tolist(), "status": CONVERGED, "errors": np.sqrt(np.diag(covariance)).tolist()}
        return {**row, **done}
    return {**row, "held": beta.tolist(), "held_ll": row["ll"], "beta": (beta + step).tolist(), "halvings": 0}


def linear(beta: Column, columns: Sequence[str], offset: Column | None = None) -> Column:
    """offset + beta[0] + beta[1] * first column + ..."""
    out = beta[0] if offset is None else offset + beta[0]
    for i, c in enumerate(columns, 1):
        out = out + beta[i] * F.col(c)
    return out


def newton_fits(
    rows: DataFrame,
    groups: Sequence[str],
    label: str,
    columns: Sequence[str],
    family: str = "binomial",
    offset: str | None = None,
    steps: int = 30,
    tol: float = 1e-10,
) -> DataFrame:
    """(groups, n, beta, errors, status, steps) of a logit (binomial) or log-linear (poisson) fit of each group.

    beta: intercept first; errors: its standard errors, null unless ``status`` is ``converged``. Other statuses:
    ``singular`` (no unique estimate) and ``not_converged`` (after ``steps`` steps). Rows with a null label, column
    or offset take no part; a group with no other rows has no fit. Null group keys are a group.
    """
    if family not in ("binomial", "poisson"):
        raise ValueError(family)
    groups, k = list(groups), len(columns) + 1
    wanted = [*columns, label, *([offset] if offset else [])]
    train = rows.select(*groups, *[F.col(c).cast("double").alias(c) for c in wanted]).dropna(subset=wanted)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in train.select(*groups).schema]
    state_of = "n long, beta array<double>, held array<double>, held_ll double, halvings int, errors array<double>, status string, steps int"
    state_schema = ", ".join([*kinds, state_of])
    names = [*groups, *[part.split()[0] for part in state_of.split(", ")]]
    y, off = F.col(label), F.col(offset) if offset else F.lit(0.0)
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for name in ("held", "errors"):
                    row[name] = None if row[name] is None else list(row[name])
                new = advance(row, k, tol)
                out.append({**{n: new[n] for n in names}, "steps": row["steps"] + 1})
            yield pd.DataFrame(out, columns=names)

    with cached(train) as data:
        first = F.log(F.try_divide(F.col("_y"), F.col("_e"))) if family == "poisson" else F.lit(0.0)
        begin = data.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("_y"), F.sum(F.exp(off)).alias("_e"))
        none = F.lit(None)
        state = written(
            begin.select(
                *groups, "n",
                F.array(F.coalesce(first, F.lit(0.0)), *[F.lit(0.0)] * (k - 1)).alias("beta"),
                none.cast("array<double>").alias("held"), none.cast("double").alias("held_ll"),
                F.lit(0).alias("halvings"), none.cast("array<double>").alias("errors"),
                F.lit(OPEN).alias("status"), F.lit(0).alias("steps"),
            ),
            "fits",
        )
        for _ in range(steps):
            live = state.where(F.col("status") == OPEN)
            if live.isEmpty():
                break
            known = live.select(*[F.col(g).alias(f"_fit{i}") for i, g in enumerate(groups)], "beta")
            met = data.join(known, same_keys(groups, "_fit")).withColumn("_eta", linear(F.col("beta"), columns, off))
            if family == "binomial":
                met = met.withColumn("_mu", 1 / (1 + F.exp(-F.col("_eta")))).withColumn("_w", F.col("_mu") * (1 - F.col("_mu")))
                # log(1 + exp(eta)) without overflow
                ll = y * F.col("_eta") - F.greatest(F.col("_eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs(F.col("_eta"))))
            else:
                met = met.withColumn("_mu", F.exp("_eta")).withColumn("_w", F.col("_mu"))
                ll = y * F.col("_eta") - F.col("_mu")
            sums = met.groupBy(*groups).agg(
                *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs],
                *[F.sum((y - F.col("_mu")) * x[i]).alias(f"g{i}") for i in range(k)],
                F.sum(ll).alias("ll"),
            )
            sums = sums.select(
                *[F.col(g).alias(f"_fit{i}") for i, g in enumerate(groups)],
                F.array(*[f"a{i}_{j}" for i, j in pairs]).alias("cells"),
                F.array(*[f"g{i}" for i in range(k)]).alias("slope"), "ll",
            )
            new = live.join(sums, same_keys(groups, "_fit")).select(*names, "cells", "slope", "ll")
            done = state.where(F.col("status") != OPEN)
            before, state = state, written(done.unionByName(new.mapInPandas(solved, state_schema)), "fits")
            discard(before)
    ended = F.when(F.col("status") == OPEN, ENDED).otherwise(F.col("status")).alias("status")
    return state.select(*groups, "n", "beta", "errors", ended, "steps")


def terms(fits: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a group and term: (groups, term, n, coef, se, converged); no estimates unless the fit converged."""
    names = F.array(*[F.lit(t) for t in ["intercept", *columns]])
    converged = F.col("status") == CONVERGED
    listed = fits.select(*groups, "n", converged.alias("converged"), F.posexplode(names).alias("_at", "term"), "beta", "errors")
    estimate = lambda c: F.when(F.col("converged"), F.col(c)[F.col("_at")])
    return listed.select(*groups, "term", "n", estimate("beta").alias("coef"), estimate("errors").alias("se"), "converged")


def scores(rows: DataFrame, fits: DataFrame, groups: Sequence[str], columns: Sequence[str], out: str = "score") -> DataFrame:
    """``rows`` with the probability that their group's fit gives them: null where a column is null or nothing converged."""
    known = fits.where(F.col("status") == CONVERGED)
    known = known.select(*[F.col(g).alias(f"_fit{i}") for i, g in enumerate(groups)], F.col("beta").alias("_beta"))
    eta = linear(F.col("_beta"), columns)
    joined = rows.join(known, same_keys(groups, "_fit"), "left")
    return joined.withColumn(out, 1 / (1 + F.exp(-eta))).select(*rows.columns, out)


def out_of_fold_scores(
    rows: DataFrame,
    groups: Sequence[str],
    label: str,
    columns: Sequence[str],
    fold: str = "fold",
    folds: int = 5,
    out: str = "score",
) -> DataFrame:
    """``rows`` with the probability given by the logit of their group that did not see their fold.

    All folds of all groups are fitted together; each row is scored once.
    """
    model = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    seen = rows.select(*groups, fold, label, *columns).withColumn("_model", model).where(F.col("_model") != F.col(fold))
    fits = newton_fits(seen, [*groups, "_model"], label, columns)
    return scores(rows, fits.withColumnRenamed("_model", fold), [*groups, fold], columns, out)
