"""Global importance and per-customer explanations of fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.models.additive import AdditiveModel, term_contributions

TOP_TERMS = 12
TOP_LOCAL = 10


def global_importance(train: DataFrame, model: AdditiveModel,
                      top: int | None = TOP_TERMS) -> DataFrame:
    """Mean absolute contribution per term over the given rows, largest first."""
    terms = train.select(term_contributions(model).alias("terms"))
    means = terms.agg(*[
        F.avg(F.abs(F.col("terms")[i])).alias(name) for i, name in enumerate(model.names)])
    long = means.unpivot([], model.names, "feature", "importance").orderBy(
        F.desc("importance"), "feature")
    return long if top is None else long.limit(top)


def top_true_positive(scores: DataFrame, score: str = "ebm_probability",
                      label: str = "future_aml_event") -> DataFrame:
    """The positive customer with the highest score; ties go by entity id."""
    return scores.filter(F.col(label) == 1).orderBy(F.desc(score), "entity_id").limit(1)


def local_explanation(contributions: DataFrame, top: int = TOP_LOCAL) -> DataFrame:
    """The ``top`` strongest contributions of every customer, listed in ascending order.

    Selection happens inside each row's array, so no customer's terms are
    shuffled or windowed.
    """
    strongest = F.slice(
        F.sort_array(F.transform("contributions", lambda t: F.struct(
            (-F.abs(t["contribution"])).alias("rank"), t["feature"].alias("feature"),
            t["contribution"].alias("contribution")))),
        1, top)
    ascending = F.sort_array(F.transform(strongest, lambda t: F.struct(
        t["contribution"].alias("contribution"), t["feature"].alias("feature"))))
    return contributions.select("entity_id", F.posexplode(ascending).alias("place", "term")).select(
        "entity_id", (F.col("place") + 1).alias("place"), "term.feature", "term.contribution")


def case_explanation(case: DataFrame, contributions: DataFrame, top: int = TOP_LOCAL) -> DataFrame:
    """The local explanation of the picked customer alone: one row is looked up before any term is ordered."""
    picked = contributions.join(F.broadcast(case.select("entity_id").limit(1)), "entity_id", "left_semi")
    return local_explanation(picked, top)
