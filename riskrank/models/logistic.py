"""L2 logistic regression on standardised and one-hot inputs, with per-term contributions.

``optimality`` certifies a fit without fitting again: one aggregate over the training rows gives the gradient of the
objective in every weight, which is zero at the optimum and there alone, as the objective is strictly convex.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.maths import logistic
from riskrank.schemas import MODEL_NUMERIC, PROFILE_ATTRIBUTES
from riskrank.session import for_iterations


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per column; constant columns keep scale 1."""

    mean: dict[str, float]
    scale: dict[str, float]
    rows: int

    def column(self, name: str) -> Column:
        return (F.col(name) - F.lit(self.mean[name])) / F.lit(self.scale[name])


def fit_scaling(train: DataFrame, numeric: list[str]) -> Scaling:
    """One aggregate over the training rows; two numbers per column reach the driver."""
    row = train.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"mean_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in numeric],
    ).first()
    return Scaling(
        {c: row[f"mean_{c}"] for c in numeric},
        {c: row[f"dev_{c}"] or 1.0 for c in numeric},
        row["rows"],
    )


@dataclass(frozen=True)
class LogisticFit:
    scaling: Scaling
    encoder: PipelineModel
    model: LogisticRegressionModel
    numeric: list[str]
    nominal: list[str]

    @property
    def levels(self) -> dict[str, list[str]]:
        indexer: StringIndexerModel = self.encoder.stages[0]
        return {c: list(labels) for c, labels in zip(self.nominal, indexer.labelsArray)}

    @property
    def terms(self) -> list[str]:
        """Names of the expanded inputs, in coefficient order."""
        return self.numeric + [f"{c}_{v}" for c in self.nominal for v in self.levels[c]]

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.terms, self.model.coefficients.toArray().tolist(), strict=True))


def scaled_inputs(df: DataFrame, scaling: Scaling, numeric: list[str]) -> DataFrame:
    """Add a standardised copy of every numeric input."""
    return df.withColumns({f"_z_{c}": scaling.column(c) for c in numeric})


def fit_logistic(train: DataFrame, numeric: list[str] = MODEL_NUMERIC,
                 nominal: list[str] = PROFILE_ATTRIBUTES, label: str = "future_aml_event",
                 c: float = 1.0, max_iter: int = 2000, tol: float = 1e-8) -> LogisticFit:
    """Minimise ``c * sum(log loss) + |w|^2 / 2`` with a free intercept.

    Spark averages the loss, so the same optimum needs ``regParam = 1/(c * n)``.
    Levels are in alphabetical order. The indexer keeps one slot for unseen
    levels and the encoder drops that slot, so an unseen level is all zeros.
    """
    scaling = fit_scaling(train, numeric)
    scaled = scaled_inputs(train, scaling, numeric)
    index = StringIndexer(
        inputCols=nominal, outputCols=[f"_i_{x}" for x in nominal],
        handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(
        inputCols=index.getOutputCols(), outputCols=[f"_h_{x}" for x in nominal],
        dropLast=True)
    indexer = index.fit(scaled)
    indexed = indexer.transform(scaled)
    one_hot = encode.fit(indexed)
    assemble = VectorAssembler(
        inputCols=[f"_z_{x}" for x in numeric] + encode.getOutputCols(), outputCol="_inputs")
    encoder = PipelineModel([indexer, one_hot, assemble])
    solver = LogisticRegression(
        featuresCol="_inputs", labelCol=label, regParam=1.0 / (c * scaling.rows),
        elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol)
    inputs = encoder.transform(scaled).select("_inputs", label)
    model = solver.fit(for_iterations(inputs, scaling.rows))
    return LogisticFit(scaling, encoder, model, list(numeric), list(nominal))


def score_logistic(df: DataFrame, fit: LogisticFit,
                   output: str = "logistic_probability") -> DataFrame:
    """Add the probability of the positive class."""
    encoded = fit.encoder.transform(scaled_inputs(df, fit.scaling, fit.numeric))
    scored = fit.model.transform(encoded)
    return scored.select(
        *[F.col(c) for c in df.columns], vector_to_array("probability")[1].alias(output))


@dataclass(frozen=True)
class LogisticWeights:
    """All that scoring and explaining need of a fit: plain numbers, no fitted Spark objects."""

    intercept: float
    scaling: Scaling
    levels: dict[str, list[str]]
    coefficients: dict[str, float]

    @property
    def numeric(self) -> list[str]:
        return list(self.scaling.mean)

    @property
    def terms(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, values in self.levels.items() for v in values]

    def inputs(self) -> dict[str, Column]:
        """Standardised or 0/1 value per term; an unseen or NULL level is all zeros."""
        values = {c: self.scaling.column(c) for c in self.numeric}
        for c, levels in self.levels.items():
            for level in levels:
                values[f"{c}_{level}"] = F.when(F.col(c) == level, 1.0).otherwise(0.0)
        return values

    def margin(self) -> Column:
        values = self.inputs()
        return sum((values[t] * F.lit(self.coefficients[t]) for t in self.terms), F.lit(self.intercept))


def weights_of(fit: LogisticFit) -> LogisticWeights:
    return LogisticWeights(float(fit.model.intercept), fit.scaling, fit.levels, fit.coefficients())


def score_weights(df: DataFrame, weights: LogisticWeights, output: str = "logistic_probability") -> DataFrame:
    """Add the probability of the positive class from the weights alone."""
    return df.withColumn(output, logistic(weights.margin()))


def optimality(train: DataFrame, weights: LogisticWeights, label: str = "future_aml_event", c: float = 1.0,
               tolerance: float = 1e-3) -> DataFrame:
    """(term, gradient, at_optimum) of ``c * sum(log loss) + |w|^2 / 2``, the free intercept included.

    One aggregate over the rows. A gradient is a sum that cancels at the optimum, so it is
    measured against the sum of its parts' sizes: ``at_optimum`` says that it is below
    ``tolerance`` times them. The objective exceeds its minimum by at most half the squared
    length of the gradient.
    """
    residual = logistic(weights.margin()) - F.col(label)
    values = {**weights.inputs(), "(intercept)": F.lit(1.0)}
    names = list(values)
    parts = train.select(residual.alias("_residual"), *[v.alias(f"_x{i}") for i, v in enumerate(values.values())])
    sums = parts.agg(
        *[F.sum(F.col("_residual") * F.col(f"_x{i}")).alias(f"_sum{i}") for i in range(len(names))],
        *[F.sum(F.abs(F.col("_residual") * F.col(f"_x{i}"))).alias(f"_size{i}") for i in range(len(names))])
    cells = []
    for i, name in enumerate(names):
        weight = F.lit(weights.coefficients.get(name, 0.0))
        gradient = F.coalesce(F.col(f"_sum{i}"), F.lit(0.0)) * c + weight
        size = F.coalesce(F.col(f"_size{i}"), F.lit(0.0)) * c + F.abs(weight)
        cells.append(F.struct(F.lit(name).alias("term"), gradient.alias("gradient"),
                              (F.abs(gradient) <= size * tolerance + 1e-9).alias("at_optimum")))
    return sums.select(F.inline(F.array(*cells)))


def logistic_contributions(df: DataFrame, fit: LogisticFit | LogisticWeights,
                           output: str = "contributions") -> DataFrame:
    """Add one (feature, contribution) entry per expanded input: coefficient times value."""
    weights = fit if isinstance(fit, LogisticWeights) else weights_of(fit)
    values = weights.inputs()
    entries = [
        F.struct(F.lit(t).alias("feature"), (values[t] * F.lit(weights.coefficients[t])).alias("contribution"))
        for t in weights.terms
    ]
    return df.withColumn(output, F.array(*entries))
