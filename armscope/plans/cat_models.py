"""Catalogue: regressions, tree models, their importances and validation, model-based adjustment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from armscope.functions.hashing import hash_arm
from armscope.operators import models, newton, ranks, sampling, trees
from armscope.plans.cat_clean import _BUCKET_SQL
from armscope.plans.cat_power import _CUPED_COLUMNS, _CUPED_SQL
from armscope.plans.registry import REGIONS, SPEC, events_features, fleet_units, prepost_units, query, rounded
from armscope.plans.sqltext import EVENTS_ROWS, FLEET_UNITS, PREPOST, arm, cross_fit, div, glm, hashed, mid_ranked, p_two, r, rs
from armscope.session import written
from armscope.sources import views

MAIN = models.main_features(SPEC, REGIONS)
CROSSED = models.interaction_features(REGIONS)

# Feature columns of the SQL twins, under the same names.
_F = f"""f AS (SELECT *, time_seconds / 60 AS m, cast(arm = 'treatment' as int) AS is_treatment,
  cast(time_seconds < 1800 as int) AS quick_user,
  {', '.join(f"cast(country = '{c}' as int) AS country_{c}" for c in REGIONS[:-1])} FROM e),
fx AS (SELECT *, {_BUCKET_SQL} AS time_min_bucket, is_treatment * time_seconds AS treatment_x_time,
  is_treatment * quick_user AS treatment_x_quick,
  {', '.join(f"is_treatment * country_{c} AS treatment_x_{c}" for c in REGIONS[:-1])} FROM f)"""
_WALD = """SELECT term, {cols} FROM (SELECT *, coef / se AS z FROM glm)"""


def _wald_sql(name: str = "odds_ratio", digits: int = 6) -> str:
    parts = {
        "coef": "coef",
        "se": "se",
        "z": "z",
        "p_value": p_two("z"),
        "ci_low": "coef - 1.96 * se",
        "ci_high": "coef + 1.96 * se",
        name: "exp(coef)",
    }
    return _WALD.format(cols=", ".join(f"{r(e, digits)} AS {c}" for c, e in parts.items()))


@query(
    "st15_logit_time_arm",
    f"WITH {EVENTS_ROWS}, {_F}, {glm('fx', 'converted', ['time_seconds', 'is_treatment'])} {_wald_sql()}",
)
def st15(spark, sf_dir):
    """ST15: outcome on time and arm; the SQL twin runs unrolled Newton steps."""
    return rounded(
        models.logit_table(events_features(spark, sf_dir), "converted", ["time_seconds", "is_treatment"], SPEC)
    )


@query(
    "st16_logit_interaction",
    f"WITH {EVENTS_ROWS}, {_F}, {glm('fx', 'converted', ['time_seconds', 'is_treatment', 'treatment_x_time'])} {_wald_sql()}",
)
def st16(spark, sf_dir):
    return rounded(
        models.logit_table(
            events_features(spark, sf_dir), "converted", ["time_seconds", "is_treatment", "treatment_x_time"], SPEC
        )
    )


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_FLEET_LOGIT = " UNION ALL ".join(
    f"""SELECT '{name}' AS experiment, *, true AS converged FROM (WITH {FLEET_UNITS},
fx AS (SELECT *, cast(arm = 'treatment' as int) AS is_treatment, amount / 100000 AS size FROM u WHERE experiment = '{name}'),
{glm('fx', 'converted', ['size', 'is_treatment'])} {_wald_sql()})"""
    for name in _PRIORITIES
)


def _fleet_frame(spark, sf_dir):
    return fleet_units(spark, sf_dir).withColumns(
        {"is_treatment": (F.col("group") == "treatment").cast("int"), "size": F.col("amount") / 100000}
    )


@query("st15_fleet_logit", _FLEET_LOGIT)
def st15_fleet(spark, sf_dir):
    """A logit of every experiment of the fleet, fitted together, never pooled."""
    return rounded(models.fleet_glm(_fleet_frame(spark, sf_dir), SPEC, "converted", ["size", "is_treatment"]).drop("n"))


_COUNTRY_RATES = " UNION ALL ".join(
    f"""SELECT 'events' AS experiment, '{c}' AS country, *, true AS converged FROM (WITH {PREPOST},
px AS (SELECT *, cast(arm = 'treatment' as int) AS is_treatment, ln(n_events::double) AS log_exposure FROM pp WHERE n_events > 0 AND country = '{c}'),
{glm('px', 'purchases', ['is_treatment'], 'poisson', 'log_exposure')}
SELECT * FROM ({_wald_sql('rate_ratio')}) WHERE (SELECT count(DISTINCT arm) FROM px WHERE purchases > 0) = 2)"""
    for c in REGIONS
)


@query("mb11_fleet_rate_ratio", _COUNTRY_RATES)
def mb11_fleet(spark, sf_dir):
    """MB11 for many groups: a Poisson regression with exposure for every experiment and country, fitted together.

    A country in which an arm has no purchase has no estimate, and no row here.
    """
    units = prepost_units(spark, sf_dir).filter("n_events > 0").withColumns(
        {
            "is_treatment": (F.col("group") == "treatment").cast("int"),
            "log_exposure": F.log(F.col("n_events").cast("double")),
        }
    )
    by_country = replace(SPEC, keys=(*SPEC.keys, "country"))
    fits = models.fleet_glm(units, by_country, "purchases", ["is_treatment"], "poisson", "log_exposure")
    return rounded(fits.where("converged").drop("n"))


def _scaled_sql(columns: list[str], table: str = "fs") -> str:
    cols = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in columns)
    return f"{table} AS MATERIALIZED (SELECT experiment, arm, seq, converted, {cols} FROM fx)"


@query(
    "ml12_hte_logit",
    f"WITH {EVENTS_ROWS}, {_F}, {_scaled_sql(MAIN + CROSSED)}, {glm('fs', 'converted', MAIN + CROSSED, rounds=6)} {_wald_sql(digits=5)}",
)
def ml12(spark, sf_dir):
    """Scaled features and treatment interactions, with a p-value for every interaction."""
    return rounded(
        models.logit_table(events_features(spark, sf_dir), "converted", MAIN + CROSSED, SPEC, scale=True), 5
    )


@query(
    "ml12_interaction_terms",
    f"""WITH {EVENTS_ROWS}, {_F}, {_scaled_sql(MAIN + CROSSED)}, {glm('fs', 'converted', MAIN + CROSSED, rounds=6)}
SELECT term, {r('coef', 5)} AS coef, {r('exp(coef)', 5)} AS odds_ratio, {r(p_two('z'), 5)} AS p_value
FROM (SELECT *, coef / se AS z FROM glm) WHERE contains(term, 'treatment_x')""",
)
def ml12_terms(spark, sf_dir):
    """PF8: only the interaction terms."""
    table = models.logit_table(events_features(spark, sf_dir), "converted", MAIN + CROSSED, SPEC, scale=True)
    return rounded(
        table.filter(F.col("term").contains("treatment_x")).select("term", "coef", "odds_ratio", "p_value"), 5
    )


@query(
    "mb11_poisson_rate_ratio",
    f"""WITH {PREPOST}, px AS (SELECT *, cast(arm = 'treatment' as int) AS is_treatment, ln(n_events::double) AS log_exposure FROM pp WHERE n_events > 0),
{glm('px', 'purchases', ['is_treatment'], 'poisson', 'log_exposure')} {_wald_sql('rate_ratio')}""",
)
def mb11(spark, sf_dir):
    units = prepost_units(spark, sf_dir).filter("n_events > 0")
    units = units.withColumns(
        {
            "is_treatment": (F.col("group") == "treatment").cast("int"),
            "log_exposure": F.log(F.col("n_events").cast("double")),
        }
    )
    return rounded(models.poisson_table(units, "purchases", ["is_treatment"], SPEC, "log_exposure"))


@query(
    "ml01_standardised_columns",
    f"""WITH {EVENTS_ROWS}
SELECT seq, {rs('time_seconds_std=(time_seconds - avg(time_seconds) OVER ()) / stddev_pop(time_seconds) OVER ()',
 'value_std=(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} FROM e""",
)
def ml01(spark, sf_dir):
    """ML1, ML2, with the population sd."""
    frame = events_features(spark, sf_dir).select("experiment", "seq", "time_seconds", "value")
    return rounded(
        models.standardised(frame, SPEC, ["time_seconds", "value"]).select("seq", "time_seconds_std", "value_std")
    )


def _frame(spark, sf_dir, columns):
    return models.training_frame(events_features(spark, sf_dir), columns, "converted", ["experiment", "group", "seq"])


def _tree_frame(spark, sf_dir, columns):
    """As ``_frame``, written once: class counts, fits and scores read it."""
    return written(_frame(spark, sf_dir, columns), "rows")


def _rows(spark, sf_dir, columns):
    return models.scoring_frame(events_features(spark, sf_dir), columns, "converted", ["experiment", "group", "seq"])


_TIME_SCALED = """ft AS MATERIALIZED (SELECT * REPLACE ((time_seconds - avg(time_seconds) OVER ()) / stddev_samp(time_seconds) OVER () AS time_seconds) FROM fx)"""
_LOGIT_SQL = f"WITH {EVENTS_ROWS}, {_F}, {_TIME_SCALED}, {glm('ft', 'converted', MAIN, rounds=7)}"


@query(
    "st27_odds_ratios",
    f"{_LOGIT_SQL} SELECT term AS feature, {rs('coef', 'odds_ratio=exp(coef)')} FROM glm",
)
def st27(spark, sf_dir):
    """ST27, ML3, CD6: unpenalised logistic regression, time standardised."""
    model = models.fit(models.logistic("converted", MAIN, ["time_seconds"]), _frame(spark, sf_dir, MAIN))
    # The assembled order puts the scaled columns first.
    names = ["time_seconds", *[c for c in MAIN if c != "time_seconds"]]
    return rounded(models.coefficient_table(model, names, spark))


_ETA = " + ".join(
    ["(SELECT coef FROM glm WHERE term = 'intercept')"]
    + [f"(SELECT coef FROM glm WHERE term = '{c}') * {c}" for c in MAIN]
)


@query(
    "ml04_logistic_scores",
    f"{_LOGIT_SQL} SELECT seq, cast(converted as int) AS converted, {r(f'1 / (1 + exp(-({_ETA})))')} AS score FROM ft",
)
def ml04(spark, sf_dir):
    """Probability of conversion on every row."""
    frame = _rows(spark, sf_dir, MAIN)
    model = models.fit(models.logistic("converted", MAIN, ["time_seconds"]), frame)
    return rounded(
        models.scored(model, frame).select("seq", F.col("converted").cast("int").alias("converted"), "score")
    )


_NULL_TIME = "CASE WHEN seq % 10 <> 3 THEN time_seconds END"
_LOGIT_NULLS = f"""WITH {EVENTS_ROWS}, {_F}, fn AS (SELECT * REPLACE ({_NULL_TIME} AS time_seconds) FROM fx),
fc AS (SELECT * FROM fn WHERE time_seconds IS NOT NULL), {glm('fc', 'converted', ['time_seconds', 'is_treatment'], rounds=7)}"""


@query(
    "ml04_with_nulls",
    f"""{_LOGIT_NULLS} SELECT seq, {r("1 / (1 + exp(-((SELECT coef FROM glm WHERE term = 'intercept') + (SELECT coef FROM glm WHERE term = 'time_seconds') * time_seconds + (SELECT coef FROM glm WHERE term = 'is_treatment') * is_treatment)))")} AS score FROM fn""",
)
def ml04_nulls(spark, sf_dir):
    """Every row gets a line: those with a missing feature a null score, and no part in the fit."""
    frame = _rows(spark, sf_dir, ["time_seconds", "is_treatment"]).withColumn("time_seconds", F.expr(_NULL_TIME))
    model = models.fit(models.logistic("converted", ["time_seconds", "is_treatment"]), frame)
    return rounded(models.scored(model, frame).select("seq", "score"))


@query(
    "ml04_fleet_scores",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS experiment, * FROM (WITH {FLEET_UNITS},
fx AS (SELECT *, cast(arm = 'treatment' as int) AS is_treatment, amount / 100000 AS size FROM u WHERE experiment = '{name}'),
{glm('fx', 'converted', ['size', 'is_treatment'])}
SELECT seq, {r("1 / (1 + exp(-((SELECT coef FROM glm WHERE term = 'intercept') + (SELECT coef FROM glm WHERE term = 'size') * size + (SELECT coef FROM glm WHERE term = 'is_treatment') * is_treatment)))")} AS score FROM fx)"""
        for name in _PRIORITIES
    ),
)
def ml04_fleet(spark, sf_dir):
    """ML4 for a fleet: each row scored by the model of its experiment, all models fitted together."""
    units = _fleet_frame(spark, sf_dir)
    fits = newton.newton_fits(units, ["experiment"], "converted", ["size", "is_treatment"])
    scored = newton.scores(units, fits, ["experiment"], ["size", "is_treatment"])
    return rounded(scored.select("experiment", "seq", "score"))


@query(
    "ml05_logistic_auc",
    f"""{_LOGIT_SQL}, scores AS MATERIALIZED (SELECT experiment, converted, 1 / (1 + exp(-({_ETA}))) AS score FROM ft),
{mid_ranked('scores', 'score', '', 'converted = 1')}
SELECT experiment, n1 AS n_positive, n2 AS n_negative, {r(div('u', 'cast(n1 as double) * n2'))} AS auc FROM mw""",
)
def ml05_logistic(spark, sf_dir):
    frame = _frame(spark, sf_dir, MAIN)
    model = models.fit(models.logistic("converted", MAIN, ["time_seconds"]), frame)
    return rounded(ranks.auc(models.scored(model, frame), ["experiment"], "score", "converted"))


_COVARIATES = [c for c in MAIN if c != "is_treatment"]
_CUPED_ETA = " + ".join(
    ["(SELECT coef FROM glm WHERE term = 'intercept')"]
    + [f"(SELECT coef FROM glm WHERE term = '{c}') * {c}" for c in _COVARIATES]
)


@query(
    "st26_cuped_by_model",
    f"""WITH {EVENTS_ROWS}, {_F}, {_scaled_sql(_COVARIATES)}, {glm('fs', 'converted', _COVARIATES, rounds=7)},
sc AS MATERIALIZED (SELECT experiment, arm, converted::double AS converted, 1 / (1 + exp(-({_CUPED_ETA}))) AS score FROM fs),
{_CUPED_SQL.format(src='sc', y='converted', x='score')}
SELECT experiment, {_CUPED_COLUMNS}, false AS covariate_pre_period FROM q""",
)
def st26(spark, sf_dir):
    """Covariate: the prediction of a logistic model on the non-treatment features."""
    return rounded(models.cuped_by_model(events_features(spark, sf_dir), SPEC, _COVARIATES))


@query("ml07_forest_importances")
def ml07(spark, sf_dir):
    """ML7, ML8, SL1, CD7: forest of 100 trees, ranked importances from its table of nodes."""
    frame = models.with_balanced_weights(_tree_frame(spark, sf_dir, MAIN), "converted")
    forest = models.fit(models.forest("converted", MAIN), frame).stages[-1]
    return rounded(trees.node_importances(trees.tree_nodes(forest, spark, MAIN), MAIN, True))


_FLAGS = ["is_treatment", *[f"country_{c}" for c in REGIONS[:-1]], "quick_user"]


def _stump_sql(value: str, weight: str, impurity: str) -> str:
    """CTE chain: the best first split on 0/1 columns; ``impurity`` of a cell (w, s1, s2: weight, weighted sum of ``value``
    and of its square); ends in ``best(feature, gain, ...)`` with the cells of both sides."""
    side = lambda p: impurity.format(w=f"w{p}", s1=f"s{p}", s2=f"q{p}")
    cells = ", ".join(
        f"sum(cw) FILTER (x = {k}) AS w{k}, sum(cw * v) FILTER (x = {k}) AS s{k}, sum(cw * v * v) FILTER (x = {k}) AS q{k}, count(*) FILTER (x = {k}) AS n{k}"
        for k in (0, 1)
    )
    listed = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, v, cw FROM st" for c in _FLAGS)
    return f"""
cn AS (SELECT count(*) FILTER (converted = 0)::double AS c0, count(*) FILTER (converted = 1)::double AS c1 FROM fx),
st AS MATERIALIZED (SELECT fx.*, {value} AS v, {weight} AS cw FROM fx, cn),
cells AS (SELECT feature, {cells} FROM ({listed}) GROUP BY feature HAVING n0 > 0 AND n1 > 0),
gains AS (SELECT *, w0 + w1 AS w, s0 + s1 AS s, q0 + q1 AS q FROM cells),
best AS MATERIALIZED (SELECT *, {side('')} - w0 / w * {side('0')} - w1 / w * {side('1')} AS gain FROM gains ORDER BY gain DESC LIMIT 1)"""


_GINI = "(1 - ({s1} / {w}) * ({s1} / {w}) - (1 - {s1} / {w}) * (1 - {s1} / {w}))"
_VARIANCE = "({s2} / {w} - ({s1} / {w}) * ({s1} / {w}))"
_BALANCED = "CASE WHEN converted = 1 THEN (c0 + c1) / (2 * c1) ELSE (c0 + c1) / (2 * c0) END"
_POSITIVE = "CASE WHEN converted = 1 THEN c0 / c1 ELSE 1.0 END"
_STUMP = {"maxDepth": 1, "minInstancesPerNode": 1, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


@query(
    "ml07_one_tree_nodes",
    f"""WITH {EVENTS_ROWS}, {_F}, {_stump_sql('converted::double', _BALANCED, _GINI)}
SELECT 0 AS node, feature, 0.5::double AS threshold, {r('gain')} AS gain, {r('w')} AS weight, n0 + n1 AS n FROM best
UNION ALL SELECT 1, NULL, NULL, NULL, {r('w0')}, n0 FROM best UNION ALL SELECT 2, NULL, NULL, NULL, {r('w1')}, n1 FROM best""",
)
def ml07_nodes(spark, sf_dir):
    """ML7: the node table of a forest of one tree of one level, on all rows and columns of zeros and ones."""
    frame = models.with_balanced_weights(_tree_frame(spark, sf_dir, _FLAGS), "converted")
    forest = models.fit(models.forest("converted", _FLAGS, numTrees=1, bootstrap=False, **_STUMP), frame).stages[-1]
    nodes = trees.tree_nodes(forest, spark, _FLAGS)
    return rounded(nodes.select("node", "feature", "threshold", "gain", "weight", "n"))


@query(
    "ml09_one_round_importances",
    f"""WITH {EVENTS_ROWS}, {_F}, {_stump_sql('(2 * converted - 1)::double', _POSITIVE, _VARIANCE)},
names AS (SELECT unnest({_FLAGS!r}) AS feature),
i AS (SELECT feature, cast(b.gain IS NOT NULL as double) AS importance, cast(b.gain IS NOT NULL as bigint) AS splits,
  {r('coalesce(b.gain * b.w, 0)')} AS total_gain, {r('b.gain * b.w')} AS gain_per_split FROM names LEFT JOIN best b USING (feature))
SELECT feature, importance, importance AS importance_norm, CASE WHEN feature = 'is_treatment' THEN 'main' ELSE 'control' END AS kind,
  splits, total_gain, gain_per_split, cast(row_number() OVER (ORDER BY importance DESC, feature) as int) AS importance_rank FROM i""",
)
def ml09_importances(spark, sf_dir):
    """ML9, ML10, AG15: importances of one boosting round of one level, from its table of nodes."""
    frame = models.with_positive_weight(_tree_frame(spark, sf_dir, _FLAGS), "converted")
    boosted = models.fit(models.boosting("converted", _FLAGS, maxIter=1, **_STUMP), frame).stages[-1]
    return rounded(trees.node_importances(trees.tree_nodes(boosted, spark, _FLAGS), _FLAGS, False))


@query("ml09_boosting_importances")
def ml09(spark, sf_dir):
    """ML9, ML10, ML11, AG15, CD8: 200 boosting rounds with interactions, ranked and labelled by kind."""
    columns = MAIN + CROSSED
    frame = models.with_positive_weight(_tree_frame(spark, sf_dir, columns), "converted")
    boosted = models.fit(models.boosting("converted", columns), frame).stages[-1]
    return rounded(trees.node_importances(trees.tree_nodes(boosted, spark, columns), columns, False))


def _out_of_fold_sql(columns: list[str]) -> str:
    """CTE chain: stratified folds by md5, five unrolled fits, each row scored by the one that did not see it; ends in ``oof``."""
    eta = " + ".join(["b0", *[f"b{i} * {c}" for i, c in enumerate(columns, 1)]])
    fits, rows = [], []
    for k in range(5):
        pick = ", ".join(f"max(coef) FILTER (term = '{t}') AS b{i}" for i, t in enumerate(["intercept", *columns]))
        fits.append(
            f"c{k} AS MATERIALIZED (WITH part AS (SELECT * FROM folded WHERE fold <> {k}), {glm('part', 'converted', columns, rounds=7)} SELECT {pick} FROM glm)"
        )
        rows.append(f"SELECT experiment, seq, fold, converted, 1 / (1 + exp(-({eta}))) AS score FROM folded, c{k} WHERE fold = {k}")
    return f"""folded AS MATERIALIZED (SELECT *, cast((row_number() OVER (PARTITION BY experiment, converted
  ORDER BY {hashed("'fold42' || chr(58) || seq")}, seq) - 1) % 5 as int) AS fold FROM ft),
{', '.join(fits)}, oof AS MATERIALIZED ({' UNION ALL '.join(rows)})"""


_OOF = f"WITH {EVENTS_ROWS}, {_F}, {_TIME_SCALED}, {_out_of_fold_sql(MAIN)}"


def _folded(spark, sf_dir):
    """Rows with their fold; scaling time makes the Newton steps of both sides alike, not the predictions."""
    return sampling.stratified_folds(_rows(spark, sf_dir, MAIN), ["experiment"], "converted", ["seq"])


@query("ml06_out_of_fold_scores", f"{_OOF} SELECT seq, fold, {r('score')} AS score FROM oof")
def ml06_scores(spark, sf_dir):
    """ML6: every row's probability from the fit that did not see its fold."""
    scored = newton.out_of_fold_scores(_folded(spark, sf_dir), ["experiment"], "converted", MAIN)
    return rounded(scored.select("seq", "fold", "score"))


@query(
    "ml06_cv_auc_logistic",
    f"""{_OOF}, {mid_ranked('oof', 'score', 'fold', 'converted = 1')},
a AS (SELECT fold, {div('u', 'cast(n1 as double) * n2')} AS auc FROM mw)
SELECT cast(count(auc) as int) AS folds, {rs('auc_mean=avg(auc)', 'auc_sd=stddev_pop(auc)', 'auc_min=min(auc)', 'auc_max=max(auc)')} FROM a""",
)
def ml06(spark, sf_dir):
    """ML6, AG16: five stratified folds, fitted together."""
    return rounded(models.auc_summary(models.logistic_fold_aucs(_folded(spark, sf_dir), SPEC, "converted", MAIN)))


@query("ml06_cv_auc_forest")
def ml06_forest(spark, sf_dir):
    folds = sampling.stratified_folds(
        models.with_balanced_weights(_frame(spark, sf_dir, MAIN), "converted"), ["experiment"], "converted", ["seq"]
    )
    return models.cross_validated_auc(models.forest("converted", MAIN), folds, "converted")


@query("ml06_cv_auc_boosting")
def ml06_boosting(spark, sf_dir):
    columns = MAIN + CROSSED
    folds = sampling.stratified_folds(
        models.with_positive_weight(_frame(spark, sf_dir, columns), "converted"), ["experiment"], "converted", ["seq"]
    )
    return models.cross_validated_auc(models.boosting("converted", columns), folds, "converted")


@query("ml13_model_comparison")
def ml13(spark, sf_dir):
    """ML13, CD11: in-sample AUC of the three models, ranked together."""
    columns = MAIN + CROSSED
    frame = _tree_frame(spark, sf_dir, columns)
    fits = {
        "logistic_regression": (models.logistic("converted", MAIN, ["time_seconds"]), frame),
        "random_forest": (models.forest("converted", MAIN), models.with_balanced_weights(frame, "converted")),
        "gradient_boosting": (models.boosting("converted", columns), models.with_positive_weight(frame, "converted")),
    }
    scores = models.dealt(frame)
    for name, (pipeline, train) in fits.items():
        scores = models.scored(models.fit(pipeline, train), scores, name)
    # ranking takes several passes over the scores
    return models.compare_models(written(scores.select("converted", *fits), "scores"), list(fits), "converted")


@query("mb23_uplift_deciles")
def mb23(spark, sf_dir):
    """Two learners, one per arm; predicted uplift against observed."""
    columns = ["time_seconds", *[f"country_{c}" for c in REGIONS[:-1]], "quick_user", "time_min_bucket"]
    rows = models.t_learner(events_features(spark, sf_dir), SPEC, columns)
    return models.uplift_deciles(rows, SPEC)


_UPLIFT_COLUMNS = ["time_seconds", *[f"country_{c}" for c in REGIONS[:-1]], "quick_user", "time_min_bucket"]
_UPLIFT_X = ", ".join(["1.0::double", *[f"{c}::double" for c in _UPLIFT_COLUMNS]])


@query(
    "mb23_linear_uplift",
    f"""WITH RECURSIVE {EVENTS_ROWS}, {_F},
vx AS MATERIALIZED (SELECT experiment, arm, cast(arm = 'treatment' as int) AS fold, converted::double AS y, [{_UPLIFT_X}] AS x FROM fx),
{cross_fit('vx', len(_UPLIFT_COLUMNS) + 1, folds=2)},
up AS MATERIALIZED (SELECT experiment, arm, y, round(list_inner_product(list_transform(b_t, lambda b, i: b - b_c[i]), x), 9) AS uplift
  FROM vx, (SELECT beta AS b_t FROM cf_fit WHERE k = 0), (SELECT beta AS b_c FROM cf_fit WHERE k = 1)),
cuts AS (SELECT experiment, quantile_cont(uplift, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM up GROUP BY experiment),
dc AS (SELECT up.*, cast(len(list_filter(q, lambda c: c < uplift)) + 1 as int) AS decile FROM up JOIN cuts USING (experiment)),
de AS (SELECT experiment, 'treatment' AS treatment, decile, avg(uplift) AS predicted_uplift,
  count(y) FILTER (arm = 'control') AS n_c, avg(y) FILTER (arm = 'control') AS mean_c,
  count(y) FILTER (arm = 'treatment') AS n_t, avg(y) FILTER (arm = 'treatment') AS mean_t FROM dc GROUP BY experiment, decile)
SELECT experiment, treatment, decile, {rs('predicted_uplift')}, n_c, {rs('mean_c')}, n_t, {rs('mean_t', 'observed_uplift=mean_t - mean_c')} FROM de""",
)
def mb23_linear(spark, sf_dir):
    """MB23: two learners by least squares, exact deciles of predicted uplift for every experiment and treatment."""
    rows = models.linear_uplift(events_features(spark, sf_dir), SPEC, _UPLIFT_COLUMNS)
    return rounded(models.exact_uplift_deciles(rows, SPEC))


_MB28 = f"""WITH RECURSIVE vx AS MATERIALIZED (SELECT 'vectors' AS experiment, {arm('vec_id')} AS arm,
  cast({hashed("'fold42' || chr(58) || vec_id")} % 5 as int) AS fold, cast(label = 2 as double) AS y,
  list_concat([1.0::double], embedding::double[]) AS x FROM embeddings),
{cross_fit('vx', 65, 1.0)}, {_CUPED_SQL.format(src='cf', y='y', x='score')}
SELECT experiment, {_CUPED_COLUMNS}, false AS covariate_pre_period FROM q"""


@query("mb28_cuped_by_embedding", _MB28)
def mb28(spark, sf_dir):
    """Outcome: label 2; covariate: a cross-fitted linear prediction from the embedding."""
    vectors = views.table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("experiment"),
        hash_arm(views.SALT, F.col("vec_id")).alias("group"),
        "vec_id",
        "embedding",
        (F.col("label") == 2).cast("double").alias("outcome"),
    )
    return rounded(models.cuped_by_embedding(vectors, SPEC, "embedding", "outcome", ["vec_id"]))


_LINEAR_X = ", ".join(["1.0::double", *[f"{c}::double" for c in _COVARIATES]])


@query(
    "st26_cuped_linear",
    f"""WITH RECURSIVE {EVENTS_ROWS}, {_F},
vx AS MATERIALIZED (SELECT experiment, arm, cast({hashed("'fold42' || chr(58) || seq")} % 5 as int) AS fold, converted::double AS y, [{_LINEAR_X}] AS x FROM fx),
{cross_fit('vx', len(_COVARIATES) + 1)}, {_CUPED_SQL.format(src='cf', y='y', x='score')}
SELECT experiment, {_CUPED_COLUMNS}, false AS covariate_pre_period FROM q""",
)
def st26_linear(spark, sf_dir):
    """Covariate: a cross-fitted linear prediction on the non-treatment features."""
    return rounded(models.cuped_by_linear(events_features(spark, sf_dir), SPEC, _COVARIATES, ["seq"]))
