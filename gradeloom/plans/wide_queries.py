"""Queries of the wide-table operator (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators import wide
from gradeloom.session import read


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.wide_results(read(spark, sf_dir, "eval_results"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.contradicting_cells(wide.wide_results(read(spark, sf_dir, "eval_results")))


QUERIES = {"p6_found": p6_found, "p6_wide": p6_wide}

METRICS = (
    "answer_relevance", "bert_score", "bleu_4", "context_precision", "context_recall", "exact_match", "faithfulness", "linguistic_adaptation", "no_immediate_disclosure", "pes", "rougel", "semantic_similarity", "state", "token_f1", "uptake",
)
_OK = "score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1"

ORACLE = {
    "p6_wide": rf"""
        WITH c AS (SELECT run_id, sample_index, regexp_replace(lower(regexp_replace(metric_name, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g') AS m,
                     arg_max({{'v': CASE WHEN {_OK} THEN score END, 'r': reason}}, {{'ok': {_OK}, 'at': coalesce(scored_at, TIMESTAMP '1970-01-01'), 'id': coalesce(result_id, -1)}}) AS x,
                     count(DISTINCT CASE WHEN {_OK} THEN score END) AS n FROM eval_results WHERE metric_name IS NOT NULL GROUP BY 1, 2, 3)
        SELECT run_id, sample_index, {", ".join(f"max(x.v) FILTER (m = '{m}') AS {m}_score, max(x.r) FILTER (m = '{m}') AS {m}_reason" for m in METRICS)},
          coalesce(list_sort(list(m) FILTER (n > 1)), []) AS flagged FROM c GROUP BY 1, 2""",
    "p6_found": r"""
        SELECT run_id, sample_index, metric_name FROM (
          SELECT run_id, sample_index, regexp_replace(lower(regexp_replace(metric_name, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g') AS metric_name, score
          FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1)
        GROUP BY run_id, sample_index, metric_name HAVING count(DISTINCT score) > 1""",
}
