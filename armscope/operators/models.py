"""Regression and tree models of the outcome on MLlib: coefficients, importances, scores, validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.functions.tails import two_sided_p
from armscope.operators import arms, cells, crossfit, newton
from armscope.operators.joins import attach_per_group
from armscope.operators.ranks import auc, quantiles
from armscope.operators.sampling import hash_folds
from armscope.operators.summaries import share_of_total
from armscope.operators.variance import cuped_report
from armscope.session import cached, written
from armscope.spec import ExperimentSpec

# Seed and settings of the forest and the boosted trees.
SEED = 42
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 100}
BOOSTING = {
    "maxIter": 200,
    "maxDepth": 6,
    "stepSize": 0.1,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 100,
}
FOLDS = 5
# A tree fit reads its rows once a level: a task gets this many while there are cores for more, and never above the second.
ROWS_A_TASK, MOST_ROWS_A_TASK = 20_000, 1_000_000


def main_features(spec: ExperimentSpec, strata: Sequence[str]) -> list[str]:
    """Treatment, time, strata but the last, speed and time bucket. ``slow_user`` is left out: with
    ``quick_user`` it always sums to the intercept."""
    return [
        "is_treatment",
        spec.time,
        *[f"{spec.stratum}_{s}" for s in strata[:-1]],
        "quick_user",
        "time_min_bucket",
    ]


def interaction_features(strata: Sequence[str]) -> list[str]:
    return ["treatment_x_time", *[f"treatment_x_{s}" for s in strata[:-1]], "treatment_x_quick"]


def training_frame(df: DataFrame, columns: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Only the columns a fit reads, as doubles, rows with nulls left out."""
    wanted = [c for c in dict.fromkeys([*columns, label]) if c not in extra]
    return df.select(*extra, *[F.col(c).cast("double").alias(c) for c in wanted]).dropna(subset=wanted)


def scoring_frame(df: DataFrame, columns: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """As ``training_frame``, with all rows: ``fit`` leaves out those with nulls, ``scored`` gives them a null score."""
    wanted = [c for c in dict.fromkeys([*columns, label]) if c not in extra]
    return df.select(*extra, *[F.col(c).cast("double").alias(c) for c in wanted])


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    """Rows with a null are kept, for ``scored``; fits leave them out first."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def scaled_stages(columns: Sequence[str], only: Sequence[str] | None = None) -> list:
    """Assemble and standardise all columns, or only some of them (the others pass through)."""
    if only is None:
        return [
            assembler(columns, "raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        ]
    rest = [c for c in columns if c not in only]
    return [
        assembler(only, "to_scale"),
        StandardScaler(inputCol="to_scale", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *rest], outputCol="features", handleInvalid="keep"),
    ]


def standardised(df: DataFrame, spec: ExperimentSpec, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """The columns centred and scaled per experiment as new ``<c>_std`` columns.

    ``ddof`` 0 divides by the population sd; MLlib's own scaler divides by the sample sd.
    """
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.groupBy(*spec.keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[sd(c).alias(f"_s_{c}") for c in columns]
    )
    joined = attach_per_group(df, stats, spec.keys)
    return joined.select(
        *df.columns,
        *[ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}_std") for c in columns],
    )


def wald_table(model, names: Sequence[str], spark, ci_z: float = 1.96) -> DataFrame:
    """Coefficient, standard error, z, p, interval and odds ratio per term. One row per term, intercept first."""
    summary = model.summary
    # The summary lists the intercept last.
    order = [len(names), *range(len(names))]
    terms = ["intercept", *names]
    coefficients = [model.intercept, *model.coefficients.toArray().tolist()]
    errors = summary.coefficientStandardErrors
    z, p = summary.tValues, summary.pValues
    rows = [
        (t, float(c), float(errors[i]), float(z[i]), float(p[i]))
        for t, c, i in zip(terms, coefficients, order)
    ]
    out = spark.createDataFrame(rows, "term string, coef double, se double, z double, p_value double")
    return out.withColumns(
        {
            "ci_low": F.col("coef") - ci_z * F.col("se"),
            "ci_high": F.col("coef") + ci_z * F.col("se"),
            "odds_ratio": F.exp("coef"),
        }
    )


def fit_glm(
    df: DataFrame,
    label: str,
    columns: Sequence[str],
    family: str = "binomial",
    link: str = "logit",
    offset: str | None = None,
    scale: bool = False,
):
    """A generalised linear model with standard errors; returns (model, terms)."""
    extra = [offset] if offset else []
    stages = scaled_stages(columns) if scale else [assembler(columns)]
    glm = GeneralizedLinearRegression(
        family=family, link=link, labelCol=label, featuresCol="features", maxIter=50, tol=1e-10, fitIntercept=True
    )
    if offset:
        glm = glm.setOffsetCol(offset)
    with cached(training_frame(df, columns, label, extra)) as train:
        model = Pipeline(stages=[*stages, glm]).fit(train)
    return model.stages[-1], list(columns)


def single_experiment(df: DataFrame, spec: ExperimentSpec) -> None:
    """MLlib fits one model: rows of several experiments must not be pooled into it. See ``fleet_glm``."""
    keys = [k for k in spec.keys if k in df.columns]
    if keys and len(df.select(*keys).distinct().limit(2).collect()) > 1:
        raise ValueError(f"several values of {keys}: fit each experiment on its own, or use fleet_glm")


def fleet_glm(
    df: DataFrame,
    spec: ExperimentSpec,
    label: str,
    columns: Sequence[str],
    family: str = "binomial",
    offset: str | None = None,
    steps: int = 30,
    tol: float = 1e-10,
) -> DataFrame:
    """A logit (binomial) or log-linear (poisson) model of every experiment, all fitted together in tasks.

    ``converged`` tells whether the estimates are final; otherwise they are null (see ``newton.newton_fits``).
    """
    keys = list(spec.keys)
    table = newton.terms(newton.newton_fits(df, keys, label, columns, family, offset, steps, tol), keys, columns)
    ratio_name = "odds_ratio" if family == "binomial" else "rate_ratio"
    return table.withColumn("z", F.col("coef") / F.col("se")).withColumns(
        {
            "p_value": two_sided_p(F.col("z")),
            "ci_low": F.col("coef") - spec.ci_z * F.col("se"),
            "ci_high": F.col("coef") + spec.ci_z * F.col("se"),
            ratio_name: F.exp("coef"),
        }
    )


def logit_table(
    df: DataFrame, label: str, columns: Sequence[str], spec: ExperimentSpec, scale: bool = False
) -> DataFrame:
    single_experiment(df, spec)
    model, names = fit_glm(df, label, columns, scale=scale)
    return wald_table(model, names, df.sparkSession, spec.ci_z)


def poisson_table(
    df: DataFrame, count: str, columns: Sequence[str], spec: ExperimentSpec, log_exposure: str | None = None
) -> DataFrame:
    """Poisson regression; ``odds_ratio`` is then a rate ratio and is named so."""
    single_experiment(df, spec)
    model, names = fit_glm(df, count, columns, "poisson", "log", log_exposure)
    return wald_table(model, names, df.sparkSession, spec.ci_z).withColumnRenamed("odds_ratio", "rate_ratio")


def logistic(
    label: str, columns: Sequence[str], scale: Sequence[str] | None = None, many_features: bool = False
) -> Pipeline:
    """Unpenalised logistic regression; ``scale`` names the columns to standardise (all by default).

    Reweighted least squares needs one pass per step and few steps; ``many_features`` takes the
    gradient solver instead, which has no limit on the number of features.
    """
    if many_features:
        fit = LogisticRegression(
            labelCol=label, featuresCol="features", regParam=0.0, maxIter=1000, tol=1e-10, standardization=True
        )
    else:
        fit = GeneralizedLinearRegression(
            labelCol=label, featuresCol="features", family="binomial", link="logit", maxIter=1000, tol=1e-10
        )
    return Pipeline(stages=[*scaled_stages(columns, scale), fit])


def forest(label: str, columns: Sequence[str], **settings) -> Pipeline:
    """Random forest with the fixed settings above; needs ``class_weight`` (see ``with_balanced_weights``)."""
    fit = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="class_weight", seed=SEED, **{**FOREST, **settings}
    )
    return Pipeline(stages=[assembler(columns), fit])


def boosting(label: str, columns: Sequence[str], **settings) -> Pipeline:
    """Gradient boosting with the fixed settings above; needs ``class_weight`` (see ``with_positive_weight``)."""
    fit = GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="class_weight", seed=SEED, **{**BOOSTING, **settings}
    )
    return Pipeline(stages=[assembler(columns), fit])


def _class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Two numbers on the driver."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    ).first()
    return {0: row["n0"], 1: row["n1"]}


def with_balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_class) per row."""
    counts = _class_counts(df, label)
    n = sum(counts.values())
    weights = {k: n / (2 * c) if c else 1.0 for k, c in counts.items()}
    return df.withColumn(
        "class_weight", F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    )


def with_positive_weight(df: DataFrame, label: str) -> DataFrame:
    """n0 / n1 on positives, 1 on negatives."""
    counts = _class_counts(df, label)
    weight = counts[0] / counts[1] if counts[1] else 1.0
    return df.withColumn("class_weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def _read_by(stages: Sequence) -> list[str]:
    """The columns that a pipeline's assemblers and its last stage read and no stage makes."""
    made, read = set(), []
    for stage in stages:
        if isinstance(stage, VectorAssembler):
            read += stage.getInputCols()
        made.add(stage.getOutputCol() if stage.hasParam("outputCol") else stage.getPredictionCol())
    return [c for c in dict.fromkeys(read) if c not in made]


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over as many tasks as their number is worth, up to the cores there are.

    A frame of few bytes comes as one partition from a scan or a join, and every pass of a tree fit, a thousand in
    boosting, would then be one task.
    """
    n = rows.count()
    tasks = max(min(-(-n // ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism), -(-n // MOST_ROWS_A_TASK))
    return rows.repartition(tasks) if tasks > 1 else rows


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit on the rows that have all columns and the label. Trees on many rows are grown from counts of them (``cells``)."""
    stages = pipeline.getStages()
    rows = train.dropna(subset=[*_read_by(stages), stages[-1].getLabelCol()])
    if cells.suits(pipeline) and rows.count() > cells.ROWS_FROM and (grown := cells.ensembles(pipeline, rows)):
        return grown[0]
    with cached(dealt(rows) if stages[-1].hasParam("maxBins") else rows) as data:
        return pipeline.fit(data)


def scored(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """The probability of class 1 as a column of the row; null where a feature is null."""
    keep, there = df.columns, F.lit(True)
    for c in _read_by(model.stages):
        there = there & F.col(c).isNotNull() & ~F.isnan(c)
    predicted = model.transform(df)
    if "probability" in predicted.columns:
        chance = vector_to_array("probability")[1]
    else:
        # A generalised linear model predicts the mean itself.
        chance = F.col("prediction")
    return predicted.withColumn(out, F.when(there, chance)).select(*keep, out)


def coefficient_table(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """Coefficient and odds ratio per feature of a fitted logistic regression."""
    fitted = model.stages[-1]
    rows = [("intercept", float(fitted.intercept))] + [
        (n, float(c)) for n, c in zip(names, fitted.coefficients.toArray())
    ]
    return spark.createDataFrame(rows, "feature string, coef double").withColumn("odds_ratio", F.exp("coef"))


def importance_table(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """Impurity importance per feature, 0 for unused ones, normalised and ranked.

    A forest that never split has no importances at all; then all are 0.
    """
    found = model.stages[-1].featureImportances
    values = {int(i): float(v) for i, v in zip(found.indices, found.values)} if found.size else {}
    rows = [(n, values.get(i, 0.0)) for i, n in enumerate(names)]
    table = share_of_total(
        spark.createDataFrame(rows, "feature string, importance double"), "importance", "importance_norm"
    )
    kind = (
        F.when(F.col("feature") == "is_treatment", "main")
        .when(F.col("feature").contains("treatment_x"), "interaction")
        .otherwise("control")
    )
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return table.withColumns({"kind": kind, "importance_rank": F.row_number().over(order)}).orderBy(
        "importance_rank"
    )


def fold_aucs(
    estimator: Estimator, df: DataFrame, label: str, fold: str = "fold", folds: int = FOLDS, parallelism: int = FOLDS
) -> DataFrame:
    """Exact held-out AUC of every fold: each row is scored by the model that did not see it.

    The rows, with their folds, are written once and dealt over the cores; all fits and scores read that table.
    Scaling sits inside the estimator, so no fold sees the others' moments. Fits are submitted side by side, and no
    final model is fitted on all rows; trees on many rows are grown from counts of them (``cells``), of all folds in
    the same passes. The scores are written, as ranking them takes several passes.
    """
    df = written(df, "folds")

    def scores(fitted: Sequence[PipelineModel], data: DataFrame) -> DataFrame:
        parts = [scored(m, data.filter(F.col(fold) == k)).select(fold, label, "score") for k, m in enumerate(fitted)]
        return written(reduce(DataFrame.unionByName, parts), "held-out")

    if cells.suits(estimator) and df.count() > cells.ROWS_FROM:
        rows = df.dropna(subset=[*_read_by(estimator.getStages()), label])
        if grown := cells.ensembles(estimator, rows, fold, folds):
            return auc(scores(grown, dealt(df)), [fold], "score", label)
    with cached(dealt(df)) as data, ThreadPool(min(parallelism, folds)) as pool:
        fit_one = inheritable_thread_target(df.sparkSession)(
            lambda k: estimator.fit(data.filter(F.col(fold) != k))
        )
        held_out = scores(pool.map(fit_one, range(folds)), data)
    return auc(held_out, [fold], "score", label)


def logistic_fold_aucs(
    df: DataFrame, spec: ExperimentSpec, label: str, columns: Sequence[str], fold: str = "fold", folds: int = FOLDS
) -> DataFrame:
    """Held-out AUC of every experiment and fold by logits that are all fitted together; rows are scored in one pass."""
    keys = list(spec.keys)
    held_out = newton.out_of_fold_scores(df, keys, label, columns, fold, folds)
    return auc(held_out, [*keys, fold], "score", label)


def cross_validated_auc(
    estimator: Estimator, df: DataFrame, label: str, fold: str = "fold", folds: int = FOLDS, parallelism: int = FOLDS
) -> DataFrame:
    """Mean, population sd, least and greatest held-out AUC over the folds."""
    return auc_summary(fold_aucs(estimator, df, label, fold, folds, parallelism))


def auc_summary(aucs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, population sd, least and greatest AUC over the folds of each group."""
    return aucs.groupBy(*groups).agg(
        F.count("auc").cast("int").alias("folds"),
        F.avg("auc").alias("auc_mean"),
        F.stddev_pop("auc").alias("auc_sd"),
        F.min("auc").alias("auc_min"),
        F.max("auc").alias("auc_max"),
    )


def compare_models(scores: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """AUC per score column. Columns are stacked, so all models share one ranking."""
    stacked = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in names])
    return auc(scores.select(label, F.inline(stacked)), ["model"], "score", label)


def cuped_by_model(
    df: DataFrame, spec: ExperimentSpec, columns: Sequence[str], label: str | None = None
) -> DataFrame:
    """Adjustment by the predicted outcome of a logistic model that does not see the arm.

    The covariate is fitted on the same outcomes, so it is flagged as not pre-period.
    """
    label = label or spec.metric
    single_experiment(df, spec)
    frame = training_frame(df, columns, label, [*spec.keys, spec.arm])
    model = fit(logistic(label, columns), frame)
    return cuped_report(scored(model, frame), spec, label, "score", pre_period=False)


def t_learner(
    df: DataFrame, spec: ExperimentSpec, columns: Sequence[str], label: str | None = None, **settings
) -> DataFrame:
    """Uplift per row: the difference of two boosted regressions, one fitted on each arm.

    The columns of the fits are written once; the check, the fits and what reads the uplift start from that table.
    """
    label = label or spec.metric
    if len(spec.treatments) > 1:
        raise ValueError("uplift compares one treatment with the control: choose one")
    frame = written(training_frame(df, columns, label, [*spec.keys, spec.arm]), "learners")
    single_experiment(frame, spec)
    frame = dealt(frame)
    options = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 50, **settings}
    out = assembler(columns).transform(frame)
    for suffix, arm in (("c", spec.control), ("t", spec.treatments[0])):
        learner = GBTRegressor(
            labelCol=label, featuresCol="features", predictionCol=f"pred_{suffix}", seed=SEED, **options
        )
        with cached(assembler(columns).transform(frame.filter(F.col(spec.arm) == arm))) as train:
            out = learner.fit(train).transform(out)
    return out.withColumn("uplift", F.col("pred_t") - F.col("pred_c")).drop("features")


def linear_uplift(df: DataFrame, spec: ExperimentSpec, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(keys, treatment, arm, label, uplift): a row for each row and comparison it belongs to.

    Two learners by least squares for every experiment and treatment, from one pass of sums an arm: the treated
    arm's prediction less the control's, rounded to nine digits so that equal rows have equal values. Null where a
    column is null or an arm has no fit. The arm is ``control`` or ``treatment``.
    """
    label = label or spec.metric
    frame = df.select(*spec.keys, spec.arm, F.col(label).cast("double").alias(label), crossfit.with_intercept(*columns).alias("_x"))
    groups = [*spec.keys, spec.arm]
    fits = crossfit.group_fits(crossfit.gram_sums(frame, groups, label, "_x"), groups)
    keyed = fits.select(F.struct(*spec.keys).alias("_key"), F.col(spec.arm).alias("_arm"), "beta")
    control = keyed.where(F.col("_arm") == spec.control).select("_key", F.col("beta").alias("_c"))
    treated = keyed.where(F.col("_arm").isin(*spec.treatments)).select("_key", F.col("_arm").alias("_treatment"), F.col("beta").alias("_t"))
    both = control.join(treated, "_key").withColumn("_key", F.struct("_key", "_treatment")).drop("_treatment")
    paired = arms.paired_rows(frame, spec).withColumn("_key", F.struct(F.struct(*spec.keys), arms.PAIR))
    step = F.zip_with("_t", "_c", lambda t, c: t - c)
    uplift = F.aggregate(F.zip_with(step, "_x", lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)
    return paired.join(both, "_key", "left").select(*spec.keys, arms.PAIR, spec.arm, label, F.round(uplift, 9).alias("uplift"))


def exact_uplift_deciles(rows: DataFrame, spec: ExperimentSpec, label: str | None = None) -> DataFrame:
    """Predicted uplift against the observed difference of the arms, by decile of each experiment and treatment.

    rows: as ``linear_uplift`` gives them. The nine cuts are exact quantiles of the group's own predictions; equal
    predictions stay together. Rows without a prediction are in no decile.
    """
    label = label or spec.metric
    groups = [*spec.keys, arms.PAIR]
    marks = {f"q{i}": i / 10 for i in range(1, 10)}
    cuts = quantiles(rows, groups, "uplift", marks).select(F.struct(*groups).alias("_key"), F.array(*marks).alias("_cuts"))
    placed = rows.where("uplift IS NOT NULL").withColumn("_key", F.struct(*groups)).join(cuts, "_key")
    decile = (F.size(F.filter("_cuts", lambda c: c < F.col("uplift"))) + 1).alias("decile")
    mine = {s: F.when(F.col(spec.arm) == a, F.col(label)) for s, a in (("c", spec.control), ("t", arms.PAIR))}
    out = placed.select("*", decile).groupBy(*groups, "decile").agg(
        F.avg("uplift").alias("predicted_uplift"),
        *[x for s, y in mine.items() for x in (F.count(y).alias(f"n_{s}"), F.avg(y).alias(f"mean_{s}"))],
    )
    return out.withColumn("observed_uplift", F.col("mean_t") - F.col("mean_c"))


def uplift_deciles(scored_rows: DataFrame, spec: ExperimentSpec, label: str | None = None) -> DataFrame:
    """Predicted uplift against the observed difference of the arms, by decile of predicted uplift.

    The nine cut points come from a quantile sketch; equal predictions stay together.
    """
    label = label or spec.metric
    cuts = scored_rows.approxQuantile("uplift", [i / 10 for i in range(1, 10)], 0.001)
    decile = F.lit(1)
    for cut in cuts:
        decile = decile + (F.col("uplift") > F.lit(cut)).cast("int")
    arms = {}
    for suffix, arm in (("c", spec.control), ("t", spec.treatments[0])):
        mine = F.when(F.col(spec.arm) == arm, F.col(label))
        arms[suffix] = (F.count(mine).alias(f"n_{suffix}"), F.avg(mine).alias(f"mean_{suffix}"))
    return (
        scored_rows.withColumn("decile", decile)
        .groupBy(*spec.keys, "decile")
        .agg(F.avg("uplift").alias("predicted_uplift"), *arms["c"], *arms["t"])
        .withColumn("observed_uplift", F.col("mean_t") - F.col("mean_c"))
    )


def cuped_by_linear(
    df: DataFrame, spec: ExperimentSpec, columns: Sequence[str], unit: Sequence[str], label: str | None = None, ridge: float = 0.0
) -> DataFrame:
    """Adjustment by a linear prediction from columns, cross-fitted: a row's prediction has not seen its outcome."""
    label = label or spec.metric
    frame = df.withColumn("_x", crossfit.with_intercept(*columns))
    return _cuped_cross_fitted(frame, spec, unit, label, ridge)


def cuped_by_embedding(
    df: DataFrame, spec: ExperimentSpec, embedding: str, label: str, unit: Sequence[str] = (), ridge: float = 1.0
) -> DataFrame:
    """Adjustment by a cross-fitted linear prediction of the outcome from an embedding array, for every experiment.

    ``unit`` names the columns whose hash deals the folds; without them rows of equal vectors share a fold.
    """
    vector = F.concat(F.array(F.lit(1.0)), F.col(embedding).cast("array<double>"))
    return _cuped_cross_fitted(df.withColumn("_x", vector), spec, unit or [embedding], label, ridge)


def _cuped_cross_fitted(frame: DataFrame, spec: ExperimentSpec, unit: Sequence[str], label: str, ridge: float) -> DataFrame:
    wanted = [*spec.keys, spec.arm, F.col(label).cast("double").alias(label), "_x", "fold"]
    folded = hash_folds(frame, unit, FOLDS).select(*wanted)
    scored_rows = crossfit.cross_fitted(folded, list(spec.keys), label, "_x", ridge=ridge)
    # made of outcomes, if not of the row's own: it does not precede the experiment
    return cuped_report(scored_rows, spec, label, "score", pre_period=False)
