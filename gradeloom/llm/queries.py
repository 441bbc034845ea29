"""Queries of the text operators (problems 1-5 and 7-9) and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import cutoff, encode, languages, leaks, pairs, quota, reading, spans
from gradeloom.session import cut, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "samples")
    return pairs.defects(samples, languages.samples_model(samples, read(spark, sf_dir, "graded_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "samples")
    return languages.unnamed_languages(samples, languages.samples_model(samples, read(spark, sf_dir, "graded_items")))


def _detected(spark: SparkSession, sf_dir: str, segments: bool) -> DataFrame:
    samples = read(spark, sf_dir, "samples")
    model = languages.samples_model(samples, read(spark, sf_dir, "graded_items"))
    once = samples.where("sample_index is not null").groupBy("sample_index").agg(F.max("question").alias("question"), F.max("answer").alias("answer"))
    got = languages.detect(once, model, ["sample_index"], ["question", "answer"], segments)
    sides = [got.select("sample_index", F.lit(f).alias("field_name"), F.posexplode(f).alias("seg_no", "x")) for f in ("question", "answer")]
    return sides[0].unionByName(sides[1]).select("sample_index", "field_name", "seg_no", "x.*")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every question and answer with share of words and confidence."""
    return _detected(spark, sf_dir, False)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one language of every question and answer, with confidence."""
    return _detected(spark, sf_dir, True)


def _read_levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, reading.Scale]:
    encoded = reading.encode(read(spark, sf_dir, "samples"), "sample_index", "answer")
    return encoded, reading.fit(encoded, read(spark, sf_dir, "graded_items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.demanding(*_read_levels(spark, sf_dir))


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent and graded level of every answer."""
    return reading.levels(*_read_levels(spark, sf_dir), "sample_index").distinct()


def _quota(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    labels = quota.synthetic_labels()
    rows = cut(quota.usable_rows(read(spark, sf_dir, "synthetic_dataset"), "synth_id", labels))  # counted, planned and drawn from
    return rows, read(spark, sf_dir, "sample_targets"), list(labels)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets, dims = _quota(spark, sf_dir)
    return quota.short_categories(rows, targets, "synth_id", dims).select("dimension", "category")


def p4_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and available rows and the deficit per category."""
    rows, targets, dims = _quota(spark, sf_dir)
    return quota.requirements(rows, targets, dims)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets, dims = _quota(spark, sf_dir)
    return quota.draw(rows, quota.plan(rows, targets, dims), "synth_id", dims)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required, available and sampled rows and the deficit per category."""
    rows, targets, dims = _quota(spark, sf_dir)
    cells = quota.plan(rows, targets, dims)
    sample = quota.draw(rows, cells, "synth_id", dims)
    return quota.sample_report(quota.requirements(rows, targets, dims), sample, dims, (cells.first() or {"least_gap": 0})["least_gap"])


def _cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = cutoff.answer_texts(read(spark, sf_dir, "samples"), "answer")
    return answers.unionByName(cutoff.reason_texts(read(spark, sf_dir, "eval_results"), read(spark, sf_dir, "runs")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.find_cut(_cut_texts(spark, sf_dir)).select("field_name", "record_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per source of answers and per judge of reasons."""
    texts = _cut_texts(spark, sf_dir)
    return cutoff.cut_rates(texts, cutoff.find_cut(texts))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_column(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.exact_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and edited copies of items, or of long parts of them, with their alignment."""
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).where(leaks.is_leak())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(read(spark, sf_dir, "documents"))


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the group of those that hold one span: the pairs of ``p9_found`` without expanding copies.

    The group is named by its least document, its size and a number that tells apart groups alike in these.
    """
    g = spans.groups(read(spark, sf_dir, "documents"))
    named = g.groupBy("h", "w").agg(F.min("doc_id").alias("first_doc"), F.max("n").alias("n_docs"), F.bit_xor(F.xxhash64("doc_id")).alias("group_id"))
    return g.select("h", "w", "doc_id").join(named, ["h", "w"]).select("group_id", "first_doc", "n_docs", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_languages, p2_segments, p3_found, p3_levels, p4_found, p4_requirements, p4_sample, p4_report, p5_found, p5_rates, p7_ids, p8_found, p8_leaks, p9_found, p9_groups, p9_shares,
    )
}

_COUNTS = r"""
        WITH l AS (SELECT DISTINCT synth_id, unnest([{'d': 'question_type', 'v': metadata.question_type}, {'d': 'difficulty', 'v': metadata.difficulty},
                     {'d': 'target_pedagogical_state', 'v': metadata.target_pedagogical_state}]) AS x FROM synthetic_dataset),
             c AS (SELECT x.d AS d, regexp_replace(lower(regexp_replace(x.v, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g') AS v, count(DISTINCT synth_id) AS n
                   FROM l WHERE x.v IS NOT NULL GROUP BY 1, 2),
             r AS (SELECT dimension, category, greatest(min_rows, round(target_share * sample_rows))::BIGINT AS required, coalesce(c.n, 0) AS available
                   FROM sample_targets t LEFT JOIN c ON c.d = t.dimension AND c.v = regexp_replace(lower(trim(t.category)), '[\s-]', '_', 'g'))"""

ORACLE = {
    "p4_found": _COUNTS + " SELECT dimension, category FROM r WHERE available < required",
    "p4_requirements": _COUNTS + " SELECT dimension, category, required, available, greatest(0, required - available) AS deficit FROM r",
    "p8_found": r"""
        WITH w AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (
                     SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)),
             d AS (SELECT doc_id, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS g,
                          count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM w),
             v AS (SELECT item_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (
                     SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL)),
             b AS (SELECT item_id, string_agg(x, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS g,
                          count(*) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM v)
        SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (g) WHERE d.n = 12 AND b.n = 12""",
    "p9_found": r"""
        WITH s AS (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400),
             h AS (SELECT doc_id, substring(text, i, 400) AS w FROM s),
             r AS (SELECT DISTINCT doc_id, md5(w) AS w FROM h)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM r a JOIN r b ON a.w = b.w AND a.doc_id < b.doc_id""",
    "p9_shares": r"""
        WITH s AS (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400),
             h AS (SELECT doc_id, i, md5(substring(text, i, 400)) AS w FROM s),
             g AS (SELECT w FROM h GROUP BY w HAVING count(DISTINCT doc_id) > 1),
             c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h JOIN g USING (w)),
             x AS (SELECT doc_id, sum(CASE WHEN p IS NULL OR i - p >= 400 THEN 400 ELSE i - p END)::BIGINT AS shared_chars FROM c GROUP BY 1)
        SELECT d.doc_id, coalesce(length(d.text), 0)::INT AS n_chars, coalesce(x.shared_chars, 0) AS shared_chars,
          coalesce(x.shared_chars::DOUBLE / nullif(length(d.text), 0), 0.0) AS share FROM documents d LEFT JOIN x USING (doc_id)""",
}
