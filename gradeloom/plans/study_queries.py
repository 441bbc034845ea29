"""Queries of the tutoring study and of set, order and slice operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import results as R
from gradeloom.operators import statistics as S
from gradeloom.operators import study
from gradeloom.plans import judge_queries as J
from gradeloom.plans import sqltext as Q
from gradeloom.session import read
from gradeloom.sources import canonical, dialogues, sinks


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores of the dialogue samples with their moves, over all runs."""
    s = canonical.samples(read(spark, sf_dir, "samples")).where("source = 'mathdial'")
    ident = F.try_variant_get(F.try_parse_json("metadata"), "$.conversation_id", "string")
    notes = dialogues.dialogue_samples(read(spark, sf_dir, "mathdial")).select("conversation_id", "qid", "teacher_move", "move_score", "turn_index")
    keyed = s.select("sample_index", "answer", ident.alias("conversation_id")).join(notes, "conversation_id")
    frame = J._frame(spark, sf_dir).where("truth is not null")
    return frame.join(keyed, "sample_index")


def study_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("run_id", "sample_index", "conversation_id", "qid", "teacher_move", "move_score", "turn_index", "truth", "faithfulness", F.substring("answer", 1, 200).alias("response_text"))


def study_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all tests of the study."""
    return study_validation_p(spark, sf_dir).select("test", "name", F.round("statistic", 5).alias("statistic"), "n")


def study_validation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With their p-values."""
    return study.validation(_annotated(spark, sf_dir), "truth", "teacher_move", "move_score", study.MOVES)


def study_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.group_stats(_annotated(spark, sf_dir), "teacher_move", "truth", study.MOVES)
    return got.withColumns({c: F.round(c, 3) for c in ("mean", "median", "std", "min", "max")})


def study_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the box plots of the study need: quartiles of the score per teacher move."""
    got = sinks.plot_data(_annotated(spark, sf_dir), "teacher_move", "truth")
    return got.withColumns({c: F.round(c, 5) for c in ("q1", "median", "q3", "low", "high", "mean")})


def study_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(_annotated(spark, sf_dir), "truth", "move_score").select("n", F.round("rho", 6).alias("rho"))


def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.canonical_results(read(spark, sf_dir, "eval_results"))
    runs = read(spark, sf_dir, "runs").select("run_id", "model_name").where("run_id is not null").distinct()
    return study.ranking(r.join(runs, "run_id"), "model_name", "score").withColumn("mean_score", F.round("mean_score", 6))


def weights_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = J._frame(spark, sf_dir).where("truth is not null").withColumn("gate_failed", F.coalesce(F.col("faithfulness") < 0.25, F.lit(False)))
    got = study.compare_weights(x, "state", (0.33, 0.33, 0.34), (0.0, 0.3, 0.7))
    return got.withColumns({c: F.round(c, 5) for c in ("default_mean", "best_mean", "delta")})


def sample_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.sample_slice(canonical.samples(read(spark, sf_dir, "samples")), 100, 50).select("sample_index")


def _metrics(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    return R.canonical_results(read(spark, sf_dir, "eval_results")).where(F.col("run_id") == run).select("metric_name")


def metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "run-00-00000").unionByName(_metrics(spark, sf_dir, "run-00-00001")).distinct()


def metric_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "run-00-00001").intersect(_metrics(spark, sf_dir, "run-00-00002"))


QUERIES = {f.__name__: f for f in (study_frame, study_validation, study_validation_p, study_groups, study_boxes, study_spearman, model_ranking, weights_compared, sample_slice, metric_union, metric_intersection)}

_STUDY = f"""(SELECT f.run_id, f.sample_index, n.conversation_id, n.qid, n.teacher_move, n.move_score, n.turn_index, f.truth, f.faithfulness, s.answer FROM {J._FRAME} f
 JOIN (SELECT * FROM {Q.SAMPLES} WHERE source = 'mathdial') s USING (sample_index)
 JOIN ({J.ORACLE["mathdial_parse"]}) n ON n.conversation_id = (CASE WHEN json_valid(s.metadata) THEN s.metadata->>'conversation_id' END) WHERE f.truth IS NOT NULL)"""
_RE = "(CASE WHEN coalesce(faithfulness < 0.25, FALSE) THEN 0.0 ELSE exp(({0} * ln(greatest(1e-6, coalesce(m1, 0.5))) + {1} * ln(greatest(1e-6, coalesce(m2, 0.5))) + {2} * ln(greatest(1e-6, coalesce(m3, 0.5)))) / ({0} + {1} + {2})::DOUBLE) END)"
_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"

ORACLE = {
    "study_frame": f"SELECT run_id, sample_index, conversation_id, qid, teacher_move, move_score, turn_index, truth, faithfulness, substring(answer, 1, 200) AS response_text FROM {_STUDY}",
    "study_groups": f"""SELECT l.teacher_move, l.position, g.* EXCLUDE (o) FROM (VALUES (0, 'probing'), (1, 'focus'), (2, 'generic'), (3, 'telling')) l(position, teacher_move) LEFT JOIN
 (SELECT teacher_move AS o, count(truth) AS count, round(round(avg(truth), 4), 3) AS mean, round(round(median(truth), 4), 3) AS median, round(round(stddev_samp(truth), 4), 3) AS std, round(round(min(truth), 4), 3) AS min, round(round(max(truth), 4), 3) AS max FROM {_STUDY} GROUP BY 1) g ON g.o = l.teacher_move""",
    "study_validation": f"""WITH f AS (SELECT teacher_move AS g, truth AS v, move_score AS m FROM {_STUDY}),
 r AS (SELECT *, {_RANK.format("v")} AS rv, {_RANK.format("m")} AS rm FROM f),
 g AS (SELECT g, count(*) AS c, avg(v) AS m, var_pop(v) AS x, sum(rv) AS s FROM r GROUP BY 1),
 a AS (SELECT count(*) AS k, sum(c)::DOUBLE AS n, sum(c * x) AS w, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS b, sum(s * s / c::DOUBLE) AS q FROM g),
 t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM f GROUP BY v)),
 o(i, g) AS (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(study.MOVES))}),
 p AS (SELECT x.g AS ga, y.g AS gb, x.i AS i, y.i AS j FROM o x JOIN o y ON x.i < y.i),
 u AS (SELECT ga, gb, f.g, rank() OVER (PARTITION BY ga, gb ORDER BY v) + (count(*) OVER (PARTITION BY ga, gb, v) - 1) / 2.0 AS r FROM f JOIN p ON f.g IN (ga, gb)),
 w AS (SELECT ga, gb, count(*) FILTER (g = ga) AS na, count(*) FILTER (g = gb) AS nb, sum(r) FILTER (g = ga) AS s FROM u GROUP BY 1, 2)
 SELECT 'spearman' AS test, 'move_score' AS name, round(covar_pop(rv, rm) / nullif(stddev_pop(rv) * stddev_pop(rm), 0), 5)::DOUBLE AS statistic, count(*)::BIGINT AS n FROM r HAVING count(*) >= 3
 UNION ALL SELECT 'anova', 'teacher_move', round((b / (k - 1)) / nullif(w / nullif(n - k, 0), 0), 5), n::BIGINT FROM a WHERE k >= 2 UNION ALL SELECT 'eta_squared', 'teacher_move', round(coalesce(b / nullif(b + w, 0), 0.0), 5), n::BIGINT FROM a WHERE k >= 2
 UNION ALL SELECT 'kruskal', 'teacher_move', round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - ties / nullif(n * n * n - n, 0), 0), 5), n::BIGINT FROM a, t WHERE k >= 2
 UNION ALL SELECT 'mannwhitney', ga || ' / ' || gb, round(s - na * (na + 1) / 2.0, 5), (na + nb)::BIGINT FROM w WHERE na > 0 AND nb > 0""",
    "study_boxes": f"SELECT teacher_move, round(quantile_cont(truth, 0.25), 5) AS q1, round(quantile_cont(truth, 0.5), 5) AS median, round(quantile_cont(truth, 0.75), 5) AS q3, round(min(truth), 5) AS low, round(max(truth), 5) AS high, round(avg(truth), 5) AS mean, count(truth) AS n FROM {_STUDY} GROUP BY 1",
    "study_spearman": f"SELECT count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho FROM (SELECT {_RANK.format('truth')} AS a, {_RANK.format('move_score')} AS b FROM {_STUDY}) HAVING count(*) >= 3",
    "model_ranking": f"SELECT model_name, round(avg(score), 6) AS mean_score, count(score) AS n FROM {Q.RESULTS} JOIN (SELECT DISTINCT run_id, model_name FROM runs WHERE run_id IS NOT NULL) USING (run_id) GROUP BY 1",
    "weights_compared": f"SELECT state, round(avg({_RE.format('0.33', '0.33', '0.34')}), 5) AS default_mean, round(avg({_RE.format('0.0', '0.3', '0.7')}), 5) AS best_mean, count(*) AS n, round(avg({_RE.format('0.0', '0.3', '0.7')}) - avg({_RE.format('0.33', '0.33', '0.34')}), 5) AS delta FROM {J._FRAME} WHERE truth IS NOT NULL GROUP BY 1",
    "sample_slice": "SELECT DISTINCT sample_index FROM samples WHERE sample_index IS NOT NULL ORDER BY 1 LIMIT 50 OFFSET 100",
    "metric_union": f"SELECT DISTINCT metric_name FROM {Q.RESULTS} WHERE run_id IN ('run-00-00000', 'run-00-00001')",
    "metric_intersection": f"SELECT metric_name FROM {Q.RESULTS} WHERE run_id = 'run-00-00001' INTERSECT SELECT metric_name FROM {Q.RESULTS} WHERE run_id = 'run-00-00002'",
}
