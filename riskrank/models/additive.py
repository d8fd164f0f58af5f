"""Additive log-odds model fitted by cyclic histogram boosting, one Spark job per round.

Every input becomes a small table of scores over its bins; a prediction is the
intercept plus one table entry per input. Training rows are packed once into
compact binned blocks. A round broadcasts the current tables (tens of kilobytes)
to the blocks and brings back gradient and curvature sums per (bag, input, bin),
merged in a tree; the driver only ever holds tables and those sums. The rounds
run on one cached RDD of blocks, since planning a query for each of up to 2,000
rounds costs more than the pass itself.

Within a round the inputs step one after the other, and each sees what those before
it did. No pass per input is needed for that: a step on input i changes the gradient
of a bin of input j by the step times the curvature of the rows that the two bins
share. These shared curvatures are summed in rounds 1, 2, 4, 8 and so on, as they
change ever more slowly; the gradients themselves are exact in every round, so the
curvatures decide the path of the fit, not where it ends.

Cut points are exact and sums are fixed-point integers, so neither depends on
the order in which partitions arrive: the same data and seed give the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.keys import hash_bucket
from riskrank.functions.maths import logistic
from riskrank.operators.ranked import running_totals, value_counts
from riskrank.schemas import MODEL_NUMERIC, PROFILE_ATTRIBUTES
from riskrank.session import for_iterations, materialise

MAX_LEVELS = 1_000_000  # per input: every level has a score in the tables on the driver
FIXED_POINT = float(1 << 30)


@dataclass(frozen=True)
class Settings:
    """Training knobs. The published configuration, which leaves
    ``max_leaves`` open.
    """

    max_bins: int = 64
    bags: int = 4
    validation_size: float = 0.15
    learning_rate: float = 0.03
    max_rounds: int = 2000
    patience: int = 50
    min_leaf_rows: int = 20
    max_leaves: int = 3
    seed: int = 42
    shared_cells: int = 1 << 16  # pairs of inputs with more cells step from one gradient; 0: all of them do


@dataclass(frozen=True)
class Term:
    """One input: cut points (continuous) or levels (nominal) and a score per bin."""

    name: str
    cuts: list[float] | None
    levels: list[str] | None
    scores: list[float] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return len(self.cuts) + 1 if self.levels is None else len(self.levels)


@dataclass(frozen=True)
class AdditiveModel:
    intercept: float
    terms: list[Term]
    rounds: list[int]
    losses: list[float] = field(default_factory=list)  # mean hold-out loss of each bag's best round
    first_losses: list[float] = field(default_factory=list)  # the same with the intercept alone

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]


def cut_points(train: DataFrame, numeric: list[str], max_bins: int) -> dict[str, list[float]]:
    """Exact quantile cut points per input: the values at i/max_bins of its non-NULL rows."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in numeric])
    known = train.select(F.inline(cells)).filter(F.col("value").isNotNull())
    counts = value_counts(known, "feature", "value", {"n": F.lit(1)})
    ranked = running_totals(counts, "feature", "value", ["n"])

    def reached(rows: Column) -> Column:
        """How many of the inner quantile positions lie at or below this many rows."""
        return F.least(F.floor(rows * max_bins / F.col("n_total")), F.lit(max_bins - 1))

    cuts = ranked.filter(reached(F.col("n_before") + F.col("n")) > reached(F.col("n_before")))
    found: dict[str, list[float]] = {c: [] for c in numeric}
    for row in cuts.select("feature", "value").collect():  # below max_bins per input
        found[row["feature"]].append(row["value"])
    return {c: sorted(values) for c, values in found.items()}


def nominal_levels(train: DataFrame, nominal: list[str]) -> dict[str, list[str]]:
    """Observed levels per input, up to ``MAX_LEVELS`` of each."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in nominal])
    seen = materialise(train.select(F.inline(cells)).dropna().distinct(), "levels")
    sizes = {r["feature"]: r["count"] for r in seen.groupBy("feature").count().collect()}
    wide = [c for c, size in sizes.items() if size > MAX_LEVELS]
    if wide:
        raise ValueError(f"more than {MAX_LEVELS} levels in {wide}; group rare levels first")
    found: dict[str, list[str]] = {c: [] for c in nominal}
    for row in seen.collect():
        found[row["feature"]].append(row["level"])
    return {c: sorted(values) for c, values in found.items()}


def bin_terms(train: DataFrame, numeric: list[str], nominal: list[str],
              max_bins: int) -> list[Term]:
    """One term per input with its cut points or levels."""
    cuts = cut_points(train, numeric, max_bins) if numeric else {}
    levels = nominal_levels(train, nominal) if nominal else {}
    return [Term(c, cuts[c], None) for c in numeric] + [Term(c, None, levels[c]) for c in nominal]


def _bin_type(terms: list[Term]) -> type:
    """Smallest type that holds every bin number, the one of unseen levels included."""
    return np.uint16 if max((t.bins for t in terms), default=0) < 1 << 16 else np.uint32


def _bin_lookup(terms: list[Term]):
    """Function from a pandas frame to a (term, row) matrix of bin numbers.

    Unseen levels map to the bin one past the last.
    """
    specs = [(t.name, None if t.cuts is None else np.asarray(t.cuts, dtype=float), t.levels)
             for t in terms]
    kind = _bin_type(terms)

    def lookup(frame: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(specs), len(frame)), dtype=kind)
        for i, (name, cuts, levels) in enumerate(specs):
            if levels is None:
                out[i] = np.searchsorted(cuts, frame[name].to_numpy(dtype=float), side="right")
            else:
                codes = pd.Categorical(frame[name], categories=levels).codes.astype(np.int64)
                out[i] = np.where(codes < 0, len(levels), codes)
        return out

    return lookup


def pack_blocks(train: DataFrame, terms: list[Term], rows: int, settings: Settings, key: str,
                label: str) -> DataFrame:
    """Binned training rows, a few thousand per output row, with per-bag hold-out bits."""
    held_out = F.lit(0)
    for bag in range(settings.bags):
        draw = hash_bucket(key, settings.seed * 1000 + bag, 10_000)
        chosen = (draw < int(settings.validation_size * 10_000)).cast("int")
        held_out = held_out + chosen * F.lit(1 << bag)
    lookup = _bin_lookup(terms)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield pd.DataFrame({
                    "rows": [len(frame)],
                    "bins": [lookup(frame).tobytes()],
                    "label": [frame["_label"].to_numpy(dtype=np.uint8).tobytes()],
                    "held_out": [frame["_held_out"].to_numpy(dtype=np.uint32).tobytes()],
                })

    inputs = train.select(
        *[t.name for t in terms], F.col(label).cast("int").alias("_label"),
        held_out.cast("int").alias("_held_out"))
    blocks = for_iterations(inputs, rows).mapInPandas(
        pack, "rows int, bins binary, label binary, held_out binary")
    return materialise(blocks, "additive-blocks")


def _offsets(terms: list[Term]) -> np.ndarray:
    """Start of every term in the flat score vector; one spare bin per term for unseen levels."""
    widths = [t.bins + 1 for t in terms]
    return np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)


def _block(row, terms: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins per term, labels, hold-out bits) of one packed block."""
    return (np.frombuffer(row["bins"], dtype=kind).reshape(terms, row["rows"]),
            np.frombuffer(row["label"], dtype=np.uint8),
            np.frombuffer(row["held_out"], dtype=np.uint32))


def _block_sums(block: tuple, starts: np.ndarray, tables: np.ndarray, intercepts: np.ndarray,
                active: list[int], counted: bool) -> np.ndarray:
    """Fixed-point gradient and curvature sums of a block, and row counts if asked: (2 or 3, active bags, bins + 1).

    The extra cell of a bag carries its hold-out loss and row count.
    """
    bins, labels, held = block
    width = tables.shape[1]
    total = np.zeros((3 if counted else 2, len(active), width + 1), dtype=np.int64)
    cells = bins.astype(np.int64) + starts[:, None]
    y = labels.astype(float)
    for at, bag in enumerate(active):
        margin = intercepts[bag] + tables[bag][cells].sum(axis=0)
        p = 1.0 / (1.0 + np.exp(-margin))
        out = (held >> bag) & 1 == 1
        loss = np.logaddexp(0.0, margin[out]) - y[out] * margin[out]
        total[0, at, width] = np.rint(loss * FIXED_POINT).astype(np.int64).sum()
        if counted:
            total[2, at, width] = int(out.sum())
        inside = cells[:, ~out]
        grad = np.rint((y - p)[~out] * FIXED_POINT)
        curve = np.rint((p * (1.0 - p))[~out] * FIXED_POINT)
        for line, begin, end in zip(inside - starts[:, None], starts, [*starts[1:], width]):
            # bincount adds doubles: whole numbers below 2^53 stay exact.
            total[0, at, begin:end] += np.bincount(line, grad, end - begin).astype(np.int64)
            total[1, at, begin:end] += np.bincount(line, curve, end - begin).astype(np.int64)
            if counted:
                total[2, at, begin:end] += np.bincount(line, minlength=end - begin)
    return total


def _summed(blocks: RDD, sent: tuple, one_block, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``one_block(block, *sent)`` over all blocks, merged in a tree."""
    held = blocks.context.broadcast(sent)

    def sums(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros(shape, dtype=np.int64)
        for block in part:
            total += one_block(block, *held.value)
        yield total

    total = blocks.mapPartitions(sums).treeReduce(np.add)
    held.destroy()
    return total


def _round_sums(blocks: RDD, tables: np.ndarray, intercepts: np.ndarray, offsets: np.ndarray, active: list[int],
                counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Sums of all blocks as (bags, bins + 1) arrays, whatever the data size.

    Only sums of active bags come back; those of the others are zero. Row counts are the same in
    every round, so ``counts`` takes those of an earlier one, in which all bags were active.
    """
    planes, bags, cells = 2 if counts is not None else 3, tables.shape[0], tables.shape[1] + 1
    total = np.zeros((planes, bags, cells), dtype=np.int64)
    total[:, active] = _summed(blocks, (offsets[:-1], tables, intercepts, active, counts is None), _block_sums,
                               (planes, len(active), cells))
    return {"gradient": total[0] / FIXED_POINT, "curvature": total[1] / FIXED_POINT,
            "n": total[2].astype(float) if counts is None else counts}


@dataclass(frozen=True)
class Shared:
    """Where the shared curvatures of a pair of inputs, the first below the second, lie in one flat array."""

    places: dict[tuple[int, int], int]
    widths: list[int]
    size: int

    @classmethod
    def of(cls, terms: list[Term], most_cells: int) -> Shared:
        widths, places, size = [t.bins + 1 for t in terms], {}, 0
        for i, first in enumerate(widths):
            for j in range(i + 1, len(widths)):
                if first * widths[j] <= most_cells:
                    places[i, j] = size
                    size += first * widths[j]
        return cls(places, widths, size)

    def after(self, i: int, step: np.ndarray, curvatures: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each later input, how much a step on input ``i`` takes off the gradients of its bins."""
        for j in range(i + 1, len(self.widths)):
            at = self.places.get((i, j))
            if at is not None:
                cells = curvatures[at:at + self.widths[i] * self.widths[j]].reshape(self.widths[i], self.widths[j])
                yield j, step @ cells[:len(step), :-1]


def _block_shared(block: tuple, starts: np.ndarray, tables: np.ndarray, intercepts: np.ndarray,
                  active: list[int], shared: Shared) -> np.ndarray:
    """Fixed-point curvature sums of a block's rows per pair of bins, at the mean margin of the active bags."""
    bins, _, _ = block
    whole = bins.astype(np.int64)
    cells = whole + starts[:, None]
    margin = np.mean([intercepts[bag] + tables[bag][cells].sum(axis=0) for bag in active], axis=0)
    p = 1.0 / (1.0 + np.exp(-margin))
    curve = np.rint(p * (1.0 - p) * FIXED_POINT)
    total = np.zeros(shared.size, dtype=np.int64)
    for (i, j), at in shared.places.items():
        size = shared.widths[i] * shared.widths[j]
        total[at:at + size] += np.bincount(whole[i] * shared.widths[j] + whole[j], curve, size).astype(np.int64)
    return total


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, min_rows: int) -> tuple[float, int]:
    """Largest gain of cutting an ordered run of bins in two, and where (0 when none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h, left_n = (np.cumsum(x)[:-1] for x in (g, h, n))
    right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
    allowed = (left_n >= min_rows) & (right_n >= min_rows) & (left_h > 1e-12) & (right_h > 1e-12)
    if not allowed.any():
        return 0.0, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_h + right_g**2 / right_h - g.sum() ** 2 / h.sum()
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-12 else (0.0, 0)


def _step(g: np.ndarray, h: np.ndarray, n: np.ndarray, ordered: bool,
          settings: Settings) -> np.ndarray:
    """Newton step per bin from a greedily grown tree with few leaves on one input."""
    step = np.zeros(len(g))
    order = np.arange(len(g))
    if not ordered:
        used = np.flatnonzero(n > 0)
        order = used[np.argsort(g[used] / np.maximum(h[used], 1e-12), kind="stable")]
    g, h, n = g[order], h[order], n[order]
    leaves = [(0, len(order))]
    while len(leaves) < settings.max_leaves:
        options = []
        for i, (a, b) in enumerate(leaves):
            gain, at = _best_cut(g[a:b], h[a:b], n[a:b], settings.min_leaf_rows)
            options.append((gain, i, at))
        gain, i, at = max(options, key=lambda o: (o[0], -o[1]))
        if gain <= 0.0:
            break
        a, b = leaves.pop(i)
        leaves += [(a, a + at), (a + at, b)]
    if len(leaves) > 1:
        for a, b in leaves:
            step[order[a:b]] = settings.learning_rate * g[a:b].sum() / h[a:b].sum()
    return step


def fit_additive(train: DataFrame, numeric: list[str] = MODEL_NUMERIC,
                 nominal: list[str] = PROFILE_ATTRIBUTES, key: str = "entity_id",
                 label: str = "future_aml_event", settings: Settings = Settings()) -> AdditiveModel:
    """Boost the inputs one after the other in every round, one gradient pass per round, without interactions.

    Each bag holds out its own hash-drawn share for early stopping and keeps
    the tables of its best round. Bags are averaged and every table is centred
    on the training rows.
    """
    terms = bin_terms(train, numeric, nominal, settings.max_bins)
    packed = pack_blocks(train, terms, train.count(), settings, key, label)
    count, kind = len(terms), _bin_type(terms)
    blocks = packed.rdd.map(lambda row: _block(row, count, kind)).persist(
        StorageLevel.MEMORY_AND_DISK)
    offsets = _offsets(terms)
    width, bags = int(offsets[-1]), settings.bags
    tables = np.zeros((bags, width))
    intercepts = np.zeros(bags)
    best = tables.copy()
    best_loss, best_round = np.full(bags, np.inf), np.zeros(bags, dtype=int)
    first_loss = np.zeros(bags)
    active = list(range(bags))
    rows_per_bin, rows, counts = None, 0.0, None
    shared, curvatures = Shared.of(terms, settings.shared_cells), None
    try:
        for current in range(settings.max_rounds + 1):
            sums = _round_sums(blocks, tables, intercepts, offsets, active, counts)
            if current == 0:
                counts = sums["n"]
                rows_per_bin = sums["n"][:, :width].sum(axis=0)
                # The first pass at margin 0 gives the class balance of each bag.
                span = slice(int(offsets[0]), int(offsets[1]))
                n = sums["n"][:, span].sum(axis=1)
                rows = float(n[0] + sums["n"][0, width]) if bags else 0.0
                positives = sums["gradient"][:, span].sum(axis=1) + n / 2.0
                rate = np.clip(positives / np.maximum(n, 1.0), 1e-6, 1 - 1e-6)
                intercepts = np.log(rate / (1.0 - rate))
                continue
            held = sums["n"][:, width]
            for bag in list(active):
                loss = sums["gradient"][bag, width] / held[bag] if held[bag] else 0.0
                if current == 1:
                    first_loss[bag] = loss
                if loss < best_loss[bag] or not held[bag]:
                    best_loss[bag], best_round[bag] = loss, current
                    best[bag] = tables[bag]
                elif current - best_round[bag] >= settings.patience:
                    active.remove(bag)
            if not active:
                break
            if shared.size and current & (current - 1) == 0:
                curvatures = _summed(blocks, (offsets[:-1], tables, intercepts, active, shared),
                                     _block_shared, (shared.size,)) / FIXED_POINT
            for bag in active:
                gradient = sums["gradient"][bag, :width].copy()
                part = sums["n"][bag, :int(offsets[1])].sum() / max(rows, 1.0)  # the bag's share of the rows
                for i, term in enumerate(terms):
                    span = slice(int(offsets[i]), int(offsets[i]) + term.bins)
                    step = _step(gradient[span], *(sums[m][bag, span] for m in ("curvature", "n")),
                                 term.levels is None, settings)
                    tables[bag, span] += step
                    if curvatures is not None and step.any():
                        for j, change in shared.after(i, step, curvatures):
                            gradient[int(offsets[j]):int(offsets[j]) + terms[j].bins] -= part * change
    finally:
        blocks.unpersist()

    mean = best.mean(axis=0)
    intercept, fitted = float(intercepts.mean()), []
    for i, term in enumerate(terms):
        span = slice(int(offsets[i]), int(offsets[i]) + term.bins)
        weight = rows_per_bin[span]
        centre = float((mean[span] * weight).sum() / max(weight.sum(), 1.0))
        intercept += centre
        fitted.append(Term(term.name, term.cuts, term.levels, (mean[span] - centre).tolist()))
    return AdditiveModel(intercept, fitted, best_round.tolist(), best_loss.tolist(), first_loss.tolist())


def term_contributions(model: AdditiveModel) -> Column:
    """Array column with one contribution per term; unseen levels contribute nothing."""
    lookup = _bin_lookup(model.terms)
    scores = [np.asarray(t.scores + [0.0]) for t in model.terms]

    @F.pandas_udf("array<double>")
    def contributions(frame: pd.DataFrame) -> pd.Series:
        bins = lookup(frame)
        values = np.stack([s[b] for s, b in zip(scores, bins)], axis=1)
        return pd.Series(list(values))

    return contributions(F.struct(*model.names))


def score_additive(df: DataFrame, model: AdditiveModel, output: str = "ebm_probability",
                   keep_terms: bool = False) -> DataFrame:
    """Add the probability, and on request the per-term contributions behind it."""
    margin = F.aggregate("_terms", F.lit(model.intercept), lambda total, x: total + x)
    scored = df.withColumn("_terms", term_contributions(model)).withColumn(output, logistic(margin))
    return scored if keep_terms else scored.drop("_terms")


def additive_contributions(df: DataFrame, model: AdditiveModel,
                           output: str = "contributions") -> DataFrame:
    """Add one (feature, contribution) entry per term."""
    names = F.array(*[F.lit(n) for n in model.names])
    entries = F.zip_with(names, "_terms", lambda name, value: F.struct(
        name.alias("feature"), value.alias("contribution")))
    return df.withColumn("_terms", term_contributions(model)).withColumn(output, entries).drop(
        "_terms")
