"""Reports, comparisons and statistics over the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import results as R
from gradeloom.operators import statistics as S
from gradeloom.plans import sqltext as Q
from gradeloom.session import read
from gradeloom.sources import canonical

CONFIGS = ("run-00-00000", "run-00-00001", "run-00-00002")
FLAGS = ("A", "N", "R")
STATES = ("error_remediation", "socratic_assessment", "concept_teaching", "metacognitive_review")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.canonical_results(read(spark, sf_dir, "eval_results"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("run_id", "sample_index", "metric_name", "score", "reason", "result_id")


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.summary(_results(spark, sf_dir)), "mean", "median", "stdev", "min", "max")


def histogram10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(_results(spark, sf_dir))


def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sparkline(R.histogram(_results(spark, sf_dir)))


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extremes(_results(spark, sf_dir))


def per_sample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.per_sample_mean(_results(spark, sf_dir)), "mean_score", digits=9)


def comparative_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.comparative(_results(spark, sf_dir), CONFIGS)
    return got.select("metric_name", *[F.round(F.col(f"`{c}`"), 3).alias(c.replace("-", "_")) for c in CONFIGS], F.round("delta", 3).alias("delta"))


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).where("run_id is not null and sample_index is not null")
    base = r.where(F.col("run_id") == CONFIGS[0]).select("metric_name", "sample_index", "score")
    cand = r.where(F.col("run_id") != CONFIGS[0]).select(F.col("run_id").alias("config"), "metric_name", "sample_index", "score")
    got = S.paired_compare(base, cand)
    return _rounded(got.select("config", "metric_name", "n", "baseline_mean", "candidate_mean", "delta", "t_stat"), "baseline_mean", "candidate_mean", "delta", "t_stat", digits=5)


def paired_compare_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values and verdicts; SQL integrates the density instead."""
    r = _results(spark, sf_dir).where("run_id is not null and sample_index is not null")
    base = r.where(F.col("run_id") == CONFIGS[0]).select("metric_name", "sample_index", "score")
    got = S.paired_compare(base, r.where(F.col("run_id") != CONFIGS[0]).select(F.col("run_id").alias("config"), "metric_name", "sample_index", "score"))
    return _rounded(got.select("config", "metric_name", "n", "p_value", "significant_improvement", "significant_degradation"), "p_value")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).where("run_id is not null and sample_index is not null")
    f = r.where("metric_name = 'faithfulness'").select("run_id", "sample_index", F.col("score").alias("x"))
    return f.join(r.where("metric_name = 'pes'").select("run_id", "sample_index", F.col("score").alias("y")), ["run_id", "sample_index"])


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.spearman(_pairs(spark, sf_dir), "x", "y").select("n", "rho"), "rho")


def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.spearman(_pairs(spark, sf_dir), "x", "y", ["run_id"]).select("run_id", "n", "rho"), "rho")


def spearman_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.spearman(_pairs(spark, sf_dir), "x", "y", ["run_id"]).withColumn("stars", S.stars(F.col("p_value"))), "rho", "p_value")


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return _rounded(S.spearman_matrix(line, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "rho")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("score"))


def anova_eta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.anova(_orders(spark, sf_dir), "label", "score").select("k", "n", "f_stat", "eta_squared"), "f_stat", "eta_squared", digits=5)


def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.kruskal(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select("k", "n", "h_stat"), "h_stat", digits=4)


def mannwhitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.mannwhitney(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", FLAGS).select("group_a", "group_b", "n_a", "n_b", "u_stat"), "u_stat", digits=1)


def group_tests_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the group tests over orders, in long form."""
    o = _orders(spark, sf_dir)
    a = S.anova(o, "label", "score").select(F.lit("anova").alias("test"), F.col("f_stat").alias("statistic"), "p_value")
    return _rounded(a.unionByName(S.kruskal(o, "label", "score").select(F.lit("kruskal").alias("test"), F.col("h_stat").alias("statistic"), "p_value")), "statistic", "p_value", digits=5)


def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.ols(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "slope", "intercept", "r2", digits=3)


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.group_stats(_orders(spark, sf_dir), "label", "score", ("F", "O", "P", "X"))
    return _rounded(got, "mean", "median", "std", "min", "max", digits=2)


def two_key_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.two_key_mean(_orders(spark, sf_dir), "priority", "label", "score", ("F", "O", "P"))
    return _rounded(got, "F", "O", "P", digits=3)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "synthetic_dataset").select("synth_id", F.col("metadata.difficulty").alias("label")).distinct()
    return s.groupBy("label").agg(F.count("*").alias("n"))


def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "eval_results").where("result_id is not null").select("result_id", "score", "scored_at", "ingested_at")
    old = e.where("ingested_at < timestamp'2024-07-01'").groupBy("result_id").agg(F.max("score").alias("score"), F.max("scored_at").alias("scored_at"))
    new = e.where("ingested_at >= timestamp'2024-07-01'").groupBy("result_id").agg(F.max("score").alias("score"), F.max("scored_at").alias("scored_at"))
    return R.upsert(old, new, ["result_id"])


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples")).select("sample_index")
    return R.remaining(s, _results(spark, sf_dir).where(F.col("run_id") == CONFIGS[0]))


def merge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).where("metric_name = 'state' and sample_index is not null")
    old = r.where(F.col("run_id") == "run-shared-baseline").select("sample_index", "score")
    return R.merge_raw(old, r.where(F.col("run_id") == CONFIGS[0]).select("sample_index", "score"))


def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_index(_results(spark, sf_dir))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    return s.groupBy(R.batch_number(50).alias("batch")).agg(F.count("*").alias("n"))


def metadata_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metadata_costs(_results(spark, sf_dir))


def dedupe_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct questions without case; the first synth_id keeps its row."""
    s = read(spark, sf_dir, "synthetic_dataset").where("question is not null and synth_id is not null")
    return s.groupBy(F.lower("question").alias("q")).agg(F.min("synth_id").alias("synth_id")).select("synth_id", "q")


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.sources.loaders import statistics

    return _rounded(statistics(canonical.samples(read(spark, sf_dir, "samples"))), "avg_contexts_per_sample", "avg_context_length")


QUERIES = {
    f.__name__: f
    for f in (
        results_long, summary_stats, histogram10, sparkline, extremes, per_sample_mean, comparative_pivot, paired_compare, paired_compare_p, spearman, spearman_by_group, spearman_p, spearman_matrix, anova_eta2, kruskal_h, mannwhitney_u,
        group_tests_p, ols_line, group_stats, two_key_mean, label_counts, upsert_keep_last, resume_antijoin, merge_raw, next_index, batch_counts, metadata_costs, dedupe_question, dataset_statistics,
    )
}

_R = Q.RESULTS


def _avg_rank(col: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    also = f"{by}, " if by else ""
    return f"rank() OVER ({part}ORDER BY {col}) + (count(*) OVER (PARTITION BY {also}{col}) - 1) / 2.0"


_PAIRS = f"(SELECT a.run_id, a.sample_index, a.score AS x, b.score AS y FROM {_R} a JOIN {_R} b USING (run_id, sample_index) WHERE a.metric_name = 'faithfulness' AND b.metric_name = 'pes')"
_PAIRED = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric_name ORDER BY sample_index) AS rn FROM {_R} WHERE run_id IS NOT NULL AND sample_index IS NOT NULL),
 p0 AS (SELECT c.run_id AS config, c.metric_name, c.score AS c, b.score AS b FROM r c JOIN r b ON c.metric_name = b.metric_name AND c.rn = b.rn AND b.run_id = '{CONFIGS[0]}' AND c.run_id <> '{CONFIGS[0]}'),
 g AS (SELECT config, metric_name, count(*) AS n, avg(b) AS bm, avg(c) AS cm, avg(c - b) AS d, stddev_samp(c - b) AS s FROM p0 GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN s IS NULL OR s <= 1e-12 * greatest(1.0, abs(d)) THEN CASE WHEN abs(d) <= 1e-12 THEN 'nan'::DOUBLE ELSE sign(d) * 'inf'::DOUBLE END ELSE d / (s / sqrt(n)) END AS t FROM g)"""


def _t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * {angle} / 2000.0), {df} - 1))) * {angle} / 6000.0"
    return f"(CASE WHEN isnan({t}) THEN 1.0 WHEN isinf({t}) THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area}) END)"


_MEAN = "coalesce(round(round(avg(score) FILTER (run_id = '{}'), 4), 3), 0.0) AS {}"

ORACLE = {
    "results_long": f"SELECT run_id, sample_index, metric_name, score, reason, result_id FROM {_R}",
    "summary_stats": f"SELECT metric_name, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0.0), 6) AS stdev, round(min(score), 6) AS min, round(max(score), 6) AS max FROM {_R} GROUP BY 1",
    "histogram10": f"""WITH h AS (SELECT metric_name, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n FROM {_R} GROUP BY 1, 2)
 SELECT m.metric_name, g.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT metric_name FROM {_R}) m CROSS JOIN range(0, 10) g(bin) LEFT JOIN h ON h.metric_name = m.metric_name AND h.bin = g.bin""",
    "sparkline": f"""WITH h AS (SELECT metric_name, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n FROM {_R} GROUP BY 1, 2),
 d AS (SELECT m.metric_name, g.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT metric_name FROM {_R}) m CROSS JOIN range(0, 10) g(bin) LEFT JOIN h ON h.metric_name = m.metric_name AND h.bin = g.bin),
 t AS (SELECT *, max(n) OVER (PARTITION BY metric_name) AS top FROM d)
 SELECT metric_name, string_agg(substring('▁▂▃▄▅▆▇█', floor(n::DOUBLE / top * 7)::INT + 1, 1), '' ORDER BY bin) AS sparkline FROM t GROUP BY 1""",
    "extremes": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY score DESC, sample_index NULLS FIRST, run_id NULLS FIRST) AS i,
   row_number() OVER (PARTITION BY metric_name ORDER BY score, sample_index NULLS FIRST, run_id NULLS FIRST) AS j FROM {_R})
 SELECT x.metric_name, x.score AS best_score, x.sample_index AS best_sample_index, x.run_id AS best_run_id, y.score AS worst_score, y.sample_index AS worst_sample_index, y.run_id AS worst_run_id
 FROM b x JOIN b y ON x.metric_name = y.metric_name AND x.i = 1 AND y.j = 1""",
    "per_sample_mean": f"SELECT run_id, sample_index, round(avg(score), 9) AS mean_score, count(*) AS n_metrics FROM {_R} GROUP BY 1, 2",
    "comparative_pivot": f"""SELECT metric_name, {", ".join(_MEAN.format(c, c.replace("-", "_")) for c in CONFIGS)},
  round(round(greatest({", ".join(f"coalesce(round(avg(score) FILTER (run_id = '{c}'), 4), 0.0)" for c in CONFIGS)}) - least({", ".join(f"coalesce(round(avg(score) FILTER (run_id = '{c}'), 4), 0.0)" for c in CONFIGS)}), 4), 3) AS delta
 FROM {_R} WHERE run_id IN {CONFIGS} GROUP BY 1""",
    "paired_compare": f"""{_PAIRED}
 SELECT config, metric_name, n, round(bm, 5) AS baseline_mean, round(cm, 5) AS candidate_mean, round(cm - bm, 5) AS delta, round(t, 5) AS t_stat FROM t""",
    "paired_compare_p": f"""{_PAIRED}, p AS (SELECT *, CASE WHEN n > 1 THEN {_t_p("t", "(n - 1)")} ELSE 1.0 END AS p FROM t)
 SELECT config, metric_name, n, round(p, 6) AS p_value, p < 0.05 AND cm > bm AS significant_improvement, p < 0.05 AND cm < bm AS significant_degradation FROM p""",
    "spearman": f"SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {_avg_rank('x')} AS rx, {_avg_rank('y')} AS ry FROM {_PAIRS})",
    "spearman_by_group": f"""SELECT run_id, count(*) AS n, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN NULL ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS rho
 FROM (SELECT run_id, {_avg_rank("x", "run_id")} AS rx, {_avg_rank("y", "run_id")} AS ry FROM {_PAIRS}) GROUP BY 1 HAVING count(*) >= 3""",
    "spearman_p": f"""WITH r AS (SELECT run_id, {_avg_rank("x", "run_id")} AS rx, {_avg_rank("y", "run_id")} AS ry FROM {_PAIRS}),
 g AS (SELECT run_id, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN NULL ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM r GROUP BY 1 HAVING count(*) >= 3),
 t AS (SELECT *, CASE WHEN abs(rho) < 1 - 1e-12 THEN rho * sqrt((n - 2) / (1 - rho * rho)) WHEN rho IS NOT NULL THEN 'inf'::DOUBLE END AS t FROM g),
 p AS (SELECT *, CASE WHEN t IS NOT NULL THEN {_t_p("t", "(n - 2)")} END AS p FROM t)
 SELECT run_id, n, round(rho, 6) AS rho, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM p""",
    "group_tests_p": f"""WITH g AS (SELECT o_orderstatus, count(*) AS c, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
 a AS (SELECT count(*) AS k, sum(c)::DOUBLE AS n, sum(c * v) AS w, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS b FROM g), f AS (SELECT k, n, (b / (k - 1)) / (w / (n - k)) AS f FROM a),
 r AS (SELECT o_orderstatus AS g, {_avg_rank("o_totalprice")} AS r FROM orders), s AS (SELECT g, count(*)::DOUBLE AS c, sum(r) AS s FROM r GROUP BY 1),
 ties AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice)), q AS (SELECT sum(c) AS n, sum(s * s / c) AS q FROM s),
 h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM q, ties)
 SELECT 'anova' AS test, round(f, 5) AS statistic, round(pow((n - k) / ((n - k) + 2 * f), (n - k) / 2), 5) AS p_value FROM f UNION ALL SELECT 'kruskal', round(h, 5), round(exp(-h / 2), 5) FROM h -- three groups: both tails are elementary""",
    "spearman_matrix": "WITH r AS (SELECT "
    + ", ".join(f"{_avg_rank(c)} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + " FROM lineitem), m AS (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {'1.0' if a == b else f'round(corr({a}, {b}), 6)'} AS rho, count(*) AS n FROM r"
        for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]
    )
    + ")) SELECT x, y, rho, n FROM m",
    "anova_eta2": """WITH g AS (SELECT o_orderstatus, count(*) AS c, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
 t AS (SELECT count(*) AS k, sum(c) AS n, sum(c * v) AS w, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS b FROM g)
 SELECT k, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 5) AS f_stat, round(b / (b + w), 5) AS eta_squared FROM t""",
    "kruskal_h": f"""WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, {_avg_rank("l_quantity")} AS r FROM lineitem), s AS (SELECT g, count(*)::DOUBLE AS c, sum(r) AS s FROM r GROUP BY 1),
 t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity)), q AS (SELECT count(*) AS k, sum(c) AS n, sum(s * s / c) AS q FROM s)
 SELECT k, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h_stat FROM q, t""",
    "mannwhitney_u": " UNION ALL ".join(
        f"SELECT '{a}' AS group_a, '{b}' AS group_b, count(*) FILTER (g = '{a}') AS n_a, count(*) FILTER (g = '{b}') AS n_b, round(sum(r) FILTER (g = '{a}') - count(*) FILTER (g = '{a}') * (count(*) FILTER (g = '{a}') + 1) / 2.0, 1) AS u_stat FROM (SELECT l_returnflag AS g, {_avg_rank('l_quantity')} AS r FROM lineitem WHERE l_returnflag IN ('{a}', '{b}'))"
        for i, a in enumerate(FLAGS)
        for b in FLAGS[i + 1 :]
    ),
    "ols_line": "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 3) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem",
    "group_stats": """SELECT l.label, l.position, g.* EXCLUDE (o) FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) l(position, label) LEFT JOIN
 (SELECT o_orderstatus AS o, count(o_totalprice) AS count, round(round(avg(o_totalprice), 4), 2) AS mean, round(round(median(o_totalprice), 4), 2) AS median, round(round(stddev_samp(o_totalprice), 4), 2) AS std, round(round(min(o_totalprice), 4), 2) AS min, round(round(max(o_totalprice), 4), 2) AS max FROM orders GROUP BY 1) g ON g.o = l.label""",
    "two_key_mean": "SELECT o_orderpriority AS priority, "
    + ", ".join(f"coalesce(round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 3), 0.0) AS \"{s}\"" for s in ("F", "O", "P"))
    + " FROM orders GROUP BY 1",
    "label_counts": "SELECT label, count(*) AS n FROM (SELECT DISTINCT synth_id, metadata.difficulty AS label FROM synthetic_dataset) GROUP BY 1",
    "upsert_keep_last": "SELECT result_id, max(CASE WHEN new = mx THEN score END) AS score, max(CASE WHEN new = mx THEN scored_at END) AS scored_at FROM (SELECT *, max(new) OVER (PARTITION BY result_id) AS mx FROM (SELECT result_id, score, scored_at, (ingested_at >= TIMESTAMP '2024-07-01')::INT AS new FROM eval_results WHERE result_id IS NOT NULL)) GROUP BY 1",
    "resume_antijoin": f"SELECT DISTINCT sample_index FROM samples WHERE sample_index IS NOT NULL AND sample_index NOT IN (SELECT sample_index FROM {_R} WHERE run_id = '{CONFIGS[0]}' AND sample_index IS NOT NULL)",
    "merge_raw": f"""WITH r AS (SELECT * FROM {_R} WHERE metric_name = 'state' AND sample_index IS NOT NULL), n AS (SELECT sample_index, score FROM r WHERE run_id = '{CONFIGS[0]}')
 SELECT sample_index, score FROM r WHERE run_id = 'run-shared-baseline' AND sample_index NOT IN (SELECT sample_index FROM n) UNION ALL SELECT * FROM n""",
    "next_index": f"SELECT coalesce(max(sample_index) + 1, 0) AS next_index FROM {_R}",
    "batch_counts": "SELECT sample_index // 50 AS batch, count(DISTINCT sample_index) AS n FROM samples WHERE sample_index IS NOT NULL GROUP BY 1",
    "metadata_costs": f"SELECT coalesce(sum((metadata->>'prompt_tokens')::BIGINT), 0)::BIGINT AS total_input_tokens, coalesce(sum((metadata->>'completion_tokens')::BIGINT), 0)::BIGINT AS total_output_tokens, round(coalesce(sum((metadata->>'estimated_cost')::DOUBLE), 0), 6) AS total_cost FROM {_R}",
    "dedupe_question": "SELECT min(synth_id) AS synth_id, lower(question) AS q FROM synthetic_dataset WHERE question IS NOT NULL AND synth_id IS NOT NULL GROUP BY 2",
    "dataset_statistics": f"""SELECT count(*) AS num_samples, round(avg(len(contexts)), 6) AS avg_contexts_per_sample, round(coalesce(sum(list_sum(list_transform(contexts, lambda c: length(c))))::DOUBLE / nullif(sum(len(contexts)), 0), 0), 6) AS avg_context_length,
 count(*) FILTER (answer = '') AS missing_answers, count(*) FILTER (len(contexts) = 0) AS missing_contexts, count(*) FILTER (ground_truth = '') AS missing_ground_truths FROM {Q.SAMPLES}""",
}
