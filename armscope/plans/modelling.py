"""The model-based analysis of an experiment: effect on the odds, importances, subgroups, adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.operators import models, proportions, sampling
from armscope.operators.prepare import add_features
from armscope.session import materialise
from armscope.spec import ExperimentSpec


def model_analysis(
    rows: DataFrame,
    spec: ExperimentSpec,
    strata: Sequence[str],
    unit: Sequence[str],
    forest_settings: dict | None = None,
    boosting_settings: dict | None = None,
    validate: bool = True,
) -> dict[str, DataFrame]:
    """Every step's result table, by name. ``strata`` are the levels to encode, the last is the baseline.

    ``rows`` are cleaned and hold one experiment: a model is fitted per call. The features are written
    out once; every fit and score reads them.
    """
    spark = rows.sparkSession
    label = spec.metric
    main = models.main_features(spec, strata)
    crossed = models.interaction_features(strata)
    data = materialise(add_features(rows, spec, strata, compat=True))
    frame = models.training_frame(
        data, [*main, *crossed], label, [*spec.keys, spec.arm, *unit]
    )
    balanced = models.with_balanced_weights(frame, label)
    weighted = models.with_positive_weight(frame, label)
    plans = {
        "logistic_regression": (models.logistic(label, main, [spec.time]), frame, main),
        "random_forest": (models.forest(label, main, **(forest_settings or {})), balanced, main),
        "gradient_boosting": (
            models.boosting(label, [*main, *crossed], **(boosting_settings or {})),
            weighted,
            [*main, *crossed],
        ),
    }
    fitted = {name: models.fit(plan, train) for name, (plan, train, _) in plans.items()}
    scores = frame
    for name, model in fitted.items():
        scores = models.scored(model, scores, name)
    out = {
        "odds_ratios": models.logit_table(data, label, main, spec),
        "forest_importances": models.importance_table(fitted["random_forest"], main, spark),
        "boosting_importances": models.importance_table(
            fitted["gradient_boosting"], [*main, *crossed], spark
        ),
        "subgroup_effects": proportions.subgroup_effects(data, spec, [spec.stratum, "quick_user"]),
        "interaction_terms": models.logit_table(data, label, [*main, *crossed], spec, scale=True).filter(
            F.col("term").contains("treatment_x")
        ),
        "adjustment": models.cuped_by_model(data, spec, [c for c in main if c != "is_treatment"]),
        "model_comparison": models.compare_models(scores, list(fitted), label),
    }
    if validate:
        for name, (plan, train, _) in plans.items():
            folds = sampling.hash_folds(train, unit)
            out[f"validation_{name}"] = models.cross_validated_auc(plan, folds, label)
    return out
