"""Fitted models as tables: written once, loaded in any session, scored and explained without a fit.

A model is a table of plain rows, one per weight or bin, in any format Spark writes.
Reading it back gives the same numbers, so scores and explanations are the same too.
Loaded additive models are evaluated by column functions alone; a nominal input with
many levels is looked up by a join instead of a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.functions.maths import logistic
from riskrank.models.additive import AdditiveModel, Term
from riskrank.models.logistic import LogisticWeights, Scaling
from riskrank.operators.joins import attach_dimension

INTERCEPT = "(intercept)"
LITERAL_LEVELS = 256  # inputs with more levels are joined
ADDITIVE_SCHEMA = "position int, term string, kind string, bin int, cut double, level string, score double"
LOGISTIC_SCHEMA = "position int, term string, kind string, level string, mean double, scale double, weight double"


def additive_table(spark: SparkSession, model: AdditiveModel) -> DataFrame:
    """One row per bin: its lower cut point (NULL for the lowest bin) or its level, and its score."""
    rows = [(-1, INTERCEPT, "intercept", 0, None, None, model.intercept)]
    for position, term in enumerate(model.terms):
        kind = "numeric" if term.levels is None else "nominal"
        lower = [None, *term.cuts] if term.levels is None else [None] * term.bins
        levels = term.levels or [None] * term.bins
        rows += [(position, term.name, kind, i, lower[i], levels[i], term.scores[i]) for i in range(term.bins)]
        if not term.bins:  # an input without levels in training
            rows.append((position, term.name, kind, -1, None, None, 0.0))
    return spark.createDataFrame(rows, ADDITIVE_SCHEMA)


def additive_from_table(table: DataFrame) -> AdditiveModel:
    """The model of a table that ``additive_table`` made; what the fit knew of its rounds is not kept."""
    intercept, terms = 0.0, {}
    for row in table.orderBy("position", "bin").collect():  # model state: bins and levels
        if row.kind == "intercept":
            intercept = row.score
            continue
        cuts, levels, scores = terms.setdefault(row.position, (row.term, row.kind, [], [], []))[2:]
        if row.bin < 0:
            continue
        scores.append(row.score)
        if row.kind == "nominal":
            levels.append(row.level)
        elif row.cut is not None:
            cuts.append(row.cut)
    return AdditiveModel(intercept, [
        Term(name, cuts if kind == "numeric" else None, levels if kind == "nominal" else None, scores)
        for _, (name, kind, cuts, levels, scores) in sorted(terms.items())], [])


def logistic_table(spark: SparkSession, weights: LogisticWeights) -> DataFrame:
    """One row per expanded input with its scaling or level, and one for the intercept."""
    rows = [(-1, INTERCEPT, "intercept", None, None, float(weights.scaling.rows), weights.intercept)]
    for c in weights.numeric:
        rows.append((len(rows), c, "numeric", None, weights.scaling.mean[c], weights.scaling.scale[c],
                     weights.coefficients[c]))
    for c, levels in weights.levels.items():
        rows += [(len(rows) + i, c, "nominal", level, None, None, weights.coefficients[f"{c}_{level}"])
                 for i, level in enumerate(levels)]
    return spark.createDataFrame(rows, LOGISTIC_SCHEMA)


def logistic_from_table(table: DataFrame) -> LogisticWeights:
    intercept, n, mean, scale, levels, coefficients = 0.0, 0, {}, {}, {}, {}
    for row in table.orderBy("position").collect():
        if row.kind == "intercept":
            intercept, n = row.weight, int(row.scale)
        elif row.kind == "numeric":
            mean[row.term], scale[row.term] = row.mean, row.scale
            coefficients[row.term] = row.weight
        else:
            levels.setdefault(row.term, []).append(row.level)
            coefficients[f"{row.term}_{row.level}"] = row.weight
    return LogisticWeights(intercept, Scaling(mean, scale, n), levels, coefficients)


def save_model(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    table.coalesce(1).write.format(fmt).mode("overwrite").save(path)


def load_additive(spark: SparkSession, path: str, fmt: str = "parquet") -> AdditiveModel:
    return additive_from_table(spark.read.format(fmt).load(path))


def load_logistic(spark: SparkSession, path: str, fmt: str = "parquet") -> LogisticWeights:
    return logistic_from_table(spark.read.format(fmt).load(path))


def _numeric_score(term: Term) -> Column:
    """The score of the bin a value falls into; NULL and NaN lie above all cut points."""
    value = F.coalesce(F.col(term.name).cast("double"), F.lit(float("nan")))
    bins = F.array(*map(F.lit, term.scores))
    if not term.cuts:
        return F.get(bins, F.lit(0))
    below = F.size(F.filter(F.array(*map(F.lit, term.cuts)), lambda cut: cut <= value))
    return F.get(bins, below)


def explain_additive(df: DataFrame, model: AdditiveModel, output: str = "contributions") -> DataFrame:
    """Add one (feature, contribution) entry per term by column functions; unseen levels contribute 0."""
    values, joined = {}, df
    for i, term in enumerate(model.terms):
        if term.levels is None:
            values[term.name] = _numeric_score(term)
        elif len(term.levels) <= LITERAL_LEVELS:
            cells = [F.lit(x) for pair in zip(term.levels, term.scores) for x in pair]
            values[term.name] = F.coalesce(F.try_element_at(F.create_map(*cells), F.col(term.name)), F.lit(0.0)) \
                if cells else F.lit(0.0)
        else:
            scores = df.sparkSession.createDataFrame(
                list(zip(term.levels, term.scores)), f"`{term.name}` string, _score_{i} double")
            joined = attach_dimension(joined, scores, term.name)
            values[term.name] = F.coalesce(F.col(f"_score_{i}"), F.lit(0.0))
    entries = F.array(*[F.struct(F.lit(name).alias("feature"), value.alias("contribution"))
                        for name, value in values.items()])
    return joined.withColumn(output, entries).select(*df.columns, output)


def additive_margin(model: AdditiveModel, contributions: str = "contributions") -> Column:
    return F.aggregate(contributions, F.lit(model.intercept), lambda total, x: total + x["contribution"])


def additive_probability(model: AdditiveModel, contributions: str = "contributions") -> Column:
    return logistic(additive_margin(model, contributions))


def importance(explained: DataFrame, contributions: str = "contributions") -> DataFrame:
    """(feature, importance): mean absolute contribution per term of explained rows."""
    return explained.select(F.inline(contributions)).groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("importance"))
