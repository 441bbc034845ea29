"""The tutoring study end to end: slice, score, join with annotations, merge with earlier runs, validate, ablate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom import evaluator
from gradeloom.operators import ablation, judges
from gradeloom.operators import results as R
from gradeloom.operators import statistics as S
from gradeloom.operators.ordering import running_total
from gradeloom.session import cut
from gradeloom.sources.loaders import number_rows

#: Gate of the study (the metric's own default is 0.5).
GATE = 0.25
# Label orders of the two corpora.
MOVES = ("probing", "focus", "generic", "telling")
LABELS = ("Yes", "To some extent", "No")


def sample_slice(samples: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset..offset+limit in order of sample_index, each numbered within its range: no task holds all rows."""
    got = running_total(samples, [], ["sample_index"], F.lit(1)).where(F.col("__before") >= offset)
    got = got if limit is None else got.where(F.col("__before") < offset + limit)
    return got.drop("__before", "__total")


def study_samples(annotated: DataFrame) -> DataFrame:
    """Numbered samples with their annotation columns beside them, from ``dialogue_samples`` or ``response_samples``."""
    x = annotated if "sample_index" in annotated.columns else number_rows(annotated)
    return x.withColumn("ground_truth", F.lit("")) if "ground_truth" not in x.columns else x


def score_frame(composite: DataFrame, samples: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Composite rows joined with the samples' annotation columns; results of unknown samples are left out."""
    names = {"score": "pes_score", "score_before_gate": "pes_before_gate", "faithfulness": "faithfulness_score", "m1": "M1_uptake", "m2": "M2_linguistic", "m3": "M3_disclosure", "state": "state_code"}
    parts = composite.select("sample_index", *[F.col(a).alias(b) for a, b in names.items()], "gate_failed", "reason")
    beside = samples.select("sample_index", *keep, F.substring("answer", 1, 200).alias("response_text"))
    return parts.join(beside, "sample_index")


def run(annotated: DataFrame, judge: Callable[[str, str], str] | None, model: str, cache: DataFrame, keep: Sequence[str], earlier: DataFrame | None = None, offset: int = 0, limit: int | None = None, gate: float | None = GATE, **options: float) -> DataFrame:
    """The score frame of a study. ``earlier`` frames are continued: only samples without a row are scored, and new rows
    replace old ones. ``gate=None`` leaves out faithfulness."""
    s = sample_slice(study_samples(annotated), offset, limit)
    todo = s if earlier is None else R.remaining(s, earlier)
    parts = [p for p in evaluator.PARTS["pes"] if gate is not None or p != "faithfulness"]
    got, _ = judges.judgements(judges.requests(todo, parts, model), cache, judge, **options)
    told = evaluator.told_results(todo, got)
    base = judges.scored(todo, ["state"] if gate is None else ["faithfulness", "state"], got)
    new = score_frame(evaluator.composite_results(todo, base, told, gate), todo, keep)
    return cut(new if earlier is None else R.upsert(earlier, new, ["sample_index"]))


def validation(frame: DataFrame, score: str, label: str, truth: str, order: Sequence[str]) -> DataFrame:
    """Long table (test, name, statistic, p_value, n): correlation with the truth, group tests and all pairs of labels."""
    rho = S.spearman(frame, score, truth).select(F.lit("spearman").alias("test"), F.lit(truth).alias("name"), F.col("rho").alias("statistic"), "p_value", "n")
    a = S.anova(frame, label, score)
    anova = a.select(F.lit("anova").alias("test"), F.lit(label).alias("name"), F.col("f_stat").alias("statistic"), "p_value", "n")
    eta = a.select(F.lit("eta_squared").alias("test"), F.lit(label).alias("name"), F.col("eta_squared").alias("statistic"), F.lit(None).cast("double").alias("p_value"), "n")
    h = S.kruskal(frame, label, score).select(F.lit("kruskal").alias("test"), F.lit(label).alias("name"), F.col("h_stat").alias("statistic"), "p_value", "n")
    u = S.mannwhitney(frame, label, score, order).select(F.lit("mannwhitney").alias("test"), F.concat_ws(" / ", "group_a", "group_b").alias("name"), F.col("u_stat").alias("statistic"), "p_value", (F.col("n_a") + F.col("n_b")).alias("n"))
    return reduce(DataFrame.unionByName, [rho, anova, eta, h, u])


def ranking(frame: DataFrame, by: str, score: str) -> DataFrame:
    """Mean score per group, best first (ties: by name)."""
    got = frame.groupBy(by).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))
    return got.orderBy(F.desc(F.round("mean_score", 10)), by)


def compare_weights(frame: DataFrame, label: str, default: tuple[float, float, float], best: tuple[float, float, float], m: tuple[str, str, str] = ("m1", "m2", "m3"), gate: str = "gate_failed") -> DataFrame:
    """Mean re-scored value per label under two weightings, and their difference."""
    cols = tuple(F.col(c) for c in m)
    a, b = (ablation.rescored(cols, tuple(F.lit(float(x)) for x in w), F.col(gate)) for w in (default, best))
    got = frame.groupBy(label).agg(F.avg(a).alias("default_mean"), F.avg(b).alias("best_mean"), F.count("*").alias("n"))
    return got.withColumn("delta", F.col("best_mean") - F.col("default_mean"))
