"""Pieces of SQL shared by the equivalent statements."""

SAMPLES = """(SELECT sample_index, coalesce(question, '') AS question, coalesce(answer, '') AS answer, coalesce(ground_truth, '') AS ground_truth,
 coalesce(contexts, []) AS contexts, metadata, lang, source, created_at, ingested_at FROM samples
 WHERE sample_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY ingested_at DESC) = 1)"""

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda t: t <> '')"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({c}), '{PUNCT}', ''), '{SPACE}+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"


def overlap(a: str, b: str) -> str:
    """Size of the multiset intersection of two lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda d: least(len(list_filter({a}, lambda y: y = d)), len(list_filter({b}, lambda z: z = d))))), 0)"


def grams(tok: str, n: int) -> str:
    return tok if n == 1 else f"list_transform(generate_series(1, len({tok}) - {n - 1}), lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))"


RESULTS = r"""(SELECT run_id, sample_index, metric_name, last.v AS score, last.reason AS reason, last.metadata AS metadata, last.scored_at AS scored_at, last.result_id AS result_id FROM (
 SELECT run_id, sample_index, regexp_replace(lower(regexp_replace(metric_name, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g') AS metric_name,
 arg_max({'v': CASE WHEN score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 THEN score END, 'reason': reason, 'metadata': metadata, 'scored_at': scored_at, 'result_id': result_id},
 {'ok': score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1, 'at': scored_at, 'id': result_id}) AS last
 FROM eval_results WHERE metric_name IS NOT NULL GROUP BY 1, 2, 3) WHERE last.v IS NOT NULL)"""
