"""Strata found in the data: a dictionary of levels, and sparse indicators with their treatment interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.spec import ExperimentSpec


def find_strata(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """The levels of each column, in their order by text, with one entry more for null and levels not seen here.

    The levels are counted in Spark; a row a level comes to the driver.
    """
    names = list(columns)
    levels = [f"{c}_level" for c in names]
    index = StringIndexer(inputCols=names, outputCols=levels, stringOrderType="alphabetAsc", handleInvalid="keep")
    spread = OneHotEncoder(inputCols=levels, outputCols=[f"{c}_strata" for c in names], dropLast=False, handleInvalid="error")
    return Pipeline(stages=[index, spread]).fit(df.select(*[F.col(c).cast("string").alias(c) for c in names]))


def level_names(model: PipelineModel) -> list[list[str]]:
    """The levels of each column as found; the entry after the last is that of null and unseen levels."""
    return [list(labels) for labels in model.stages[0].labelsArray]


def with_strata(df: DataFrame, model: PipelineModel, spec: ExperimentSpec, interactions: bool = True) -> DataFrame:
    """``df`` with, for each column c, c_level (int), c_strata (sparse indicators) and treatment_x_c (sparse, all zero
    in the control). Null and unseen levels have an entry of their own."""
    names = model.stages[0].getInputCols()
    out = model.transform(df.withColumns({c: F.col(c).cast("string") for c in names}))
    out = out.withColumns({f"{c}_level": F.col(f"{c}_level").cast("int") for c in names})
    if not interactions:
        return out
    treated = F.coalesce(F.col(spec.arm).isin(*spec.treatments), F.lit(False)).cast("double")
    product = Interaction(inputCols=["_treated", ""], outputCol="")
    out = out.withColumn("_treated", treated)
    for c in names:
        out = product.copy({product.inputCols: ["_treated", f"{c}_strata"], product.outputCol: f"treatment_x_{c}"}).transform(out)
    return out.drop("_treated")


def dense(column: str):
    """A vector column as an array of whole numbers."""
    return F.transform(vector_to_array(column), lambda v: v.cast("int"))
