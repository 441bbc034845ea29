"""Judge parsing, usage, composite score, ablation and dialogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scoring as K
from gradeloom.functions import text as X
from gradeloom.functions.chunking import chunks
from gradeloom.functions.jsontext import extract_json
from gradeloom.operators import ablation, capture, judges, synthetic, tutoring, usage, vectors
from gradeloom.operators import results as R
from gradeloom.plans import sqltext as Q
from gradeloom.session import read
from gradeloom.sources import canonical, dialogues

NOW = 1_730_000_000.0


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cache_rows(read(spark, sf_dir, "llm_cache"))


def _parsed(name: str, *more: str):  # type: ignore[no-untyped-def]
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = _cache(spark, sf_dir).select("cache_key", judges.SCORES[name](F.col("text")).alias("m"))
        return got.select("cache_key", F.round("m.score", 8).alias("score"), (F.col("m.error").isNotNull()).alias("failed"), *[F.col(f"m.{c}").alias(c) for c in more])

    run.__name__ = f"{name}_score"
    return run


def disclosure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _cache(spark, sf_dir).select("cache_key", judges.disclosure(F.col("text"), F.col("text")).alias("m"))
    return got.select("cache_key", F.round("m.score", 3).alias("score"), "m.raw_helpfulness", F.col("m.error").isNotNull().alias("failed"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("cache_key", extract_json("text").alias("json"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "llm_cache")
    return c.select("cache_key", K.cache_key(F.col("judge_name"), F.col("system_prompt"), F.col("prompt")).alias("computed"))


def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.alive(_cache(spark, sf_dir), NOW, 90 * 86400.0).select("cache_key", "cached_at")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cache(spark, sf_dir)
    asked = c.select(F.col("cache_key").alias("key"))
    return usage.cache_stats(asked, usage.alive(c, NOW, 90 * 86400.0)).withColumn("hit_rate", F.round("hit_rate", 6))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_cache(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the cached calls at the prices of the listed models in turn; local providers are free."""
    c = _cache(spark, sf_dir)
    model = F.element_at(F.array(*map(F.lit, K.PRICES)), F.pmod(F.col("input_tokens"), F.lit(len(K.PRICES))).cast("int") + 1)
    return c.select("cache_key", F.round(K.cost(model, F.col("input_tokens"), F.col("output_tokens"), F.col("provider")), 8).alias("cost"))


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    return judges.requests(s, ["answer_relevance", "context_recall"], "aster-8b").select("sample_index", "metric", "key")


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score frame: metric scores per run and sample, with the composite's parts as columns."""
    r = R.canonical_results(read(spark, sf_dir, "eval_results")).where("run_id is not null and sample_index is not null")
    named = {"uptake": "m1", "linguistic_adaptation": "m2", "no_immediate_disclosure": "m3", "faithfulness": "faithfulness", "pes": "truth"}
    got = r.where(F.col("metric_name").isin(*named)).groupBy("run_id", "sample_index").pivot("metric_name", list(named)).agg(F.max("score"))
    got = got.select("run_id", "sample_index", *[F.col(k).alias(v) for k, v in named.items()])
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("")), F.pmod(F.col("sample_index"), F.lit(4)).cast("int") + 1)
    return got.withColumn("state", letter)


def pes_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frame(spark, sf_dir).where("m1 is not null and m2 is not null and m3 is not null")
    got = x.select("run_id", "sample_index", "state", K.composite(F.col("m1"), F.col("m2"), F.col("m3"), F.col("state"), F.col("faithfulness")).alias("c"))
    return got.select("run_id", "sample_index", "state", F.round("c.score", 3).alias("score"), "c.gate_failed", F.round("c.score_before_gate", 3).alias("score_before_gate"))


def pes_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frame(spark, sf_dir).where("m1 is not null and m2 is not null and m3 is not null")
    c = x.select("state", K.composite(F.col("m1"), F.col("m2"), F.col("m3"), F.col("state"), F.col("faithfulness"), 0.25).alias("c"))
    return c.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("c.score"), 4).alias("mean_score"), F.count_if("c.gate_failed").alias("gate_failures"), F.round(F.avg(F.col("c.gate_failed").cast("int")), 6).alias("gate_rate"))


def pes_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frame(spark, sf_dir).where("m1 is not null and m2 is not null and m3 is not null and faithfulness is not null")
    return x.select("run_id", "sample_index", tutoring.composite_reason(F.col("m1"), F.col("m2"), F.col("m3"), F.col("state"), F.lit(""), F.col("faithfulness"), F.col("faithfulness") < 0.5).alias("reason"))


def _ablated(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frame(spark, sf_dir).where("truth is not null")
    x = x.withColumn("gate_failed", F.coalesce(F.col("faithfulness") < 0.25, F.lit(False)))
    return ablation.ablate(x, ablation.weight_grid(spark), "truth")


def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ablated(spark, sf_dir).select("w1", "w2", "w3", "n", F.round("pes_mean", 5).alias("pes_mean"), F.round("rho", 5).alias("rho"))


def ablation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.top(_ablated(spark, sf_dir)).select("w1", "w2", "w3", F.round("rho", 5).alias("rho"))


def ablation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.slices(_ablated(spark, sf_dir)).withColumn("rho", F.round("rho", 5))


def ablation_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frame(spark, sf_dir).where("truth is not null").withColumn("gate_failed", F.lit(False))
    got = ablation.ablate(x, ablation.named_grid(spark), "truth")
    return got.select("config", "n", F.round("pes_mean", 5).alias("pes_mean"), F.round("rho", 5).alias("rho"))


def mathdial_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dialogues.dialogue_samples(read(spark, sf_dir, "mathdial"))
    return got.select("conversation_id", "qid", "question", "answer", "teacher_move", "move_score", "self_correctness", "turn_index", "total_turns", "teacher_text")


def dialog_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "mathdial").select("qid", F.posexplode(dialogues.turns(F.col("conversation"))).alias("turn_index", "t"))
    return t.select("qid", "turn_index", "t.role", "t.move", "t.text")


def move_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dialogues.dialogue_samples(read(spark, sf_dir, "mathdial"))
    return got.groupBy("teacher_move").agg(F.count("*").alias("n"), F.round(F.avg("move_score"), 6).alias("mean_move_score"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the vector whose id follows."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    return K.pairwise_cosine(e, nxt, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the centroid of its label; centroids have one row per label and dimension."""
    e = read(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", "label", F.round(K.cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    return s.select("sample_index", vectors.semantic_similarity(F.col("answer"), F.col("ground_truth")).alias("m")).select("sample_index", "m.score", "m.reason")


def bert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    return s.select("sample_index", vectors.bert_score(F.col("answer"), F.col("ground_truth")).alias("m")).select("sample_index", "m.*")


def uptake(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    got = s.select("sample_index", tutoring.uptake(F.col("question"), F.col("answer"), F.col("contexts")).alias("m"))
    return got.select("sample_index", F.round("m.score", 6).alias("score"), "m.reason", F.round("m.context_overlap", 6).alias("context_overlap"))


def uptake_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    return s.select("sample_index", tutoring.uptake_route(F.col("question"), F.col("answer"), F.col("contexts")).alias("route"))


def linguistic_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    got = s.select("sample_index", tutoring.linguistic_adaptation(F.col("answer")).alias("m")).select("sample_index", "m.*").drop("reason")
    return got.withColumns({"flesch_reading_ease": F.round("flesch_reading_ease", 4), "flesch_kincaid_grade": F.round("flesch_kincaid_grade", 4)})


def adaptation_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canonical.samples(read(spark, sf_dir, "samples"))
    t = tutoring.tentativeness(F.col("answer"))
    return s.select("sample_index", t["count"].alias("tentative"), F.round(t["score"], 3).alias("score"), tutoring.has_contrast(F.col("answer")).alias("contrast"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"), vectors.hashing_encoder)).alias("chunk_no", "chunk"))


def synthetic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("doc_id is not null")
    c = docs.select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk")).select("chunk")
    from gradeloom.sources.loaders import number_rows

    return synthetic.plan(number_rows(c, "chunk_id"), ("factual", "multi-hop", "reasoning", "comparative")).drop("chunk", "prompt")


def run_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of a forest over events: each event's parent is a third of its id, ids below three are roots."""
    e = read(spark, sf_dir, "events").where("event_id is not null").select("event_id")
    parent = F.when(F.col("event_id") >= 3, F.floor(F.col("event_id") / 3))
    runs = e.select(F.col("event_id").cast("string").alias("run_id"), parent.cast("string").alias("parent_run_id"))
    return capture.roots(runs)


QUERIES = {
    **{f"{m}_score": _parsed(m, *(["state"] if m == "state" else [])) for m in judges.SCORES},
    **{
        f.__name__: f
        for f in (
            disclosure_score, json_extract, cache_key, cache_ttl, cache_stats, usage_rollup, cost_estimate, judge_requests, pes_score, pes_by_state, pes_reason, ablation_grid, ablation_topk, ablation_slices, ablation_named, mathdial_parse, dialog_history,
            move_scores, cosine_pairs, centroid_similarity, semantic_similarity, bert_score, uptake, uptake_route, linguistic_adaptation, adaptation_lexicon, semantic_chunks, synthetic_plan, run_root,
        )
    },
}

_CACHE = "(SELECT cache_key, response.text AS text, coalesce(response.input_tokens, 0) AS input_tokens, coalesce(response.output_tokens, 0) AS output_tokens, response.model AS model, response.provider AS provider, coalesce(response.cost_estimate, 0.0) AS cost, cached_at FROM llm_cache WHERE response IS NOT NULL)"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g'), '^```[^\n]*\n', ''), '\n?```$', '')"
_J = rf"""(SELECT *, CASE WHEN json_valid(bare) THEN bare::JSON WHEN json_valid(inside) THEN inside::JSON END AS j FROM (SELECT *, regexp_extract(bare, '\{{.*\}}', 0, 's') AS inside FROM (SELECT *, {_BARE} AS bare FROM {_CACHE})))"""
_TRUE = "(CASE json_type(c, '$.{0}') WHEN 'BOOLEAN' THEN (c->>'{0}')::BOOLEAN WHEN 'VARCHAR' THEN length(c->>'{0}') > 0 WHEN 'NULL' THEN FALSE WHEN 'ARRAY' THEN (c->>'{0}') <> '[]' WHEN 'OBJECT' THEN (c->>'{0}') <> '{{}}' ELSE coalesce((c->>'{0}')::DOUBLE <> 0, FALSE) END)"


def _share_sql(items: str, flag: str, empty: float) -> str:
    return f"""SELECT cache_key, round(CASE WHEN a IS NULL THEN 0.0 WHEN len(a) = 0 THEN {empty} ELSE len(list_filter(a, lambda c: coalesce({_TRUE.format(flag)}, FALSE)))::DOUBLE / len(a) END, 8) AS score, a IS NULL AS failed
 FROM (SELECT cache_key, CASE WHEN json_type(j, '$.{items}') = 'ARRAY' THEN json_extract(j, '$.{items}[*]') END AS a FROM {_J})"""


_FRAME = f"""(SELECT *, ['A', 'B', 'C', ''][(sample_index % 4) + 1] AS state FROM (SELECT run_id, sample_index, max(score) FILTER (metric_name = 'uptake') AS m1, max(score) FILTER (metric_name = 'linguistic_adaptation') AS m2, max(score) FILTER (metric_name = 'no_immediate_disclosure') AS m3,
 max(score) FILTER (metric_name = 'faithfulness') AS faithfulness, max(score) FILTER (metric_name = 'pes') AS truth FROM {Q.RESULTS} WHERE run_id IS NOT NULL AND sample_index IS NOT NULL AND metric_name IN ('uptake', 'linguistic_adaptation', 'no_immediate_disclosure', 'faithfulness', 'pes') GROUP BY 1, 2))"""
_W = "CASE state WHEN 'A' THEN [0.35, 0.35, 0.30] WHEN 'B' THEN [0.0, 0.30, 0.70] WHEN 'C' THEN [0.0, 0.25, 0.75] ELSE [0.33, 0.33, 0.34] END::DOUBLE[]"
_PES = f"""(SELECT *, round(least(1.0, greatest(0.0, exp((w[1] * ln(greatest(1e-6, least(1, m1))) + w[2] * ln(greatest(1e-6, least(1, m2))) + w[3] * ln(greatest(1e-6, least(1, m3)))) / (w[1] + w[2] + w[3])))), 4) AS raw
 FROM (SELECT *, {_W} AS w FROM {_FRAME} WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL))"""
_GRID = """(SELECT round(a * 0.05::DOUBLE, 4) AS w1, round(b * 0.05::DOUBLE, 4) AS w2, greatest(0.0::DOUBLE, round(1 - a * 0.05::DOUBLE - b * 0.05::DOUBLE, 4)) AS w3 FROM range(0, 21) x(a), range(0, 21) y(b) WHERE a + b <= 20)"""
_ABL = f"""WITH f AS (SELECT *, coalesce(faithfulness < 0.25, FALSE) AS failed FROM {_FRAME} WHERE truth IS NOT NULL),
 s AS (SELECT w1, w2, w3, truth, round(CASE WHEN failed THEN 0.0 ELSE exp((w1 * ln(greatest(1e-6, coalesce(m1, 0.5))) + w2 * ln(greatest(1e-6, coalesce(m2, 0.5))) + w3 * ln(greatest(1e-6, coalesce(m3, 0.5)))) / (w1 + w2 + w3)) END, 12) AS pes FROM f CROSS JOIN {_GRID}),
 r AS (SELECT *, rank() OVER (PARTITION BY w1, w2 ORDER BY pes) + (count(*) OVER (PARTITION BY w1, w2, pes) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY w1, w2 ORDER BY truth) + (count(*) OVER (PARTITION BY w1, w2, truth) - 1) / 2.0 AS rt FROM s)"""
_RHO = "CASE WHEN stddev_pop(rp) * stddev_pop(rt) = 0 THEN NULL ELSE covar_pop(rp, rt) / (stddev_pop(rp) * stddev_pop(rt)) END"
_STRIP = r"regexp_replace({}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g')"
_TURNS = rf"""(SELECT *, i - 1 AS turn_index, len(segs) AS total_turns, CASE WHEN starts_with(seg, 'Teacher:') THEN 'Teacher' ELSE 'Student' END AS role,
  CASE WHEN starts_with(seg, 'Teacher:') THEN nullif(lower(regexp_extract(body, '^\(([\p{{L}}\p{{N}}_]+)\)', 1)), '') END AS move,
  CASE WHEN starts_with(seg, 'Teacher:') AND regexp_matches(body, '^\([\p{{L}}\p{{N}}_]+\)') THEN {_STRIP.format(r"regexp_replace(body, '^\([\p{L}\p{N}_]+\)\s*', '')")} ELSE body END AS txt
 FROM (SELECT *, {_STRIP.format("substring(seg, 9)")} AS body FROM (SELECT qid, question, self_correctness, segs, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i
  FROM (SELECT *, list_filter(list_transform(string_split(conversation, '|EOM|'), lambda s: {_STRIP.format("s")}), lambda s: starts_with(s, 'Teacher:') OR starts_with(s, 'Student:')) AS segs FROM mathdial))))"""
_MOVE = "CASE move WHEN 'probing' THEN 1.0 WHEN 'focus' THEN 0.75 WHEN 'generic' THEN 0.5 WHEN 'telling' THEN 0.0 END::DOUBLE"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_TOK = r"regexp_extract_all(lower(answer), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]')"
_IN = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)

_PIECES = {"question": "question", "answer": "answer", "ground_truth": "ground_truth", "contexts": "array_to_string(list_transform(contexts, lambda c, i: '[' || (i - 1)::VARCHAR || '] ' || c), chr(10))"}


def _prompt_sql(metric: str) -> str:
    out = "'" + judges.PROMPTS[metric].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in _PIECES.items():
        out = out.replace("${" + k + "}", f"' || {v} || '")
    return out


_REQUESTS = f"""SELECT sample_index, metric, sha256('aster-8b::::' || prompt) AS key FROM (
 SELECT sample_index, 'answer_relevance' AS metric, {_prompt_sql("answer_relevance")} AS prompt FROM {Q.SAMPLES} WHERE answer <> ''
 UNION ALL SELECT sample_index, 'context_recall', {_prompt_sql("context_recall")} FROM {Q.SAMPLES} WHERE ground_truth <> '' AND len(contexts) > 0)"""

_STRIPPED = f"regexp_replace(text, '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g')"
ORACLE = {
    "json_extract": rf"""SELECT cache_key, CASE WHEN json_valid(whole) THEN whole WHEN json_valid(object) THEN object WHEN json_valid(list) THEN list END AS json
 FROM (SELECT cache_key, {_STRIPPED} AS whole, regexp_extract(text, '\{{.*\}}', 0, 's') AS object, regexp_extract(text, '\[.*\]', 0, 's') AS list FROM {_CACHE})""",
    "faithfulness_score": _share_sql("claims", "supported", 1.0),
    "context_precision_score": _share_sql("evaluations", "is_relevant", 1.0),
    "context_recall_score": _share_sql("statements", "is_covered", 0.0),
    "answer_relevance_score": f"""SELECT cache_key, round(CASE WHEN bad THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(try_cast(s AS DOUBLE), 0.0))) END, 8) AS score, bad AS failed
 FROM (SELECT cache_key, s, j IS NULL OR (s IS NOT NULL AND try_cast(s AS DOUBLE) IS NULL) AS bad FROM (SELECT *, j->>'score' AS s FROM {_J}))""",
    "state_score": f"""SELECT cache_key, round(CASE WHEN j IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(try_cast(j->>'confidence' AS DOUBLE), 0.0))) END, 8) AS score, j IS NULL AS failed,
 CASE WHEN j IS NOT NULL THEN regexp_extract(upper(trim(coalesce(j->>'state', ''))), '[ABC]', 0) END AS state FROM {_J}""",
    "disclosure_score": rf"""WITH x AS (SELECT cache_key, j, round(least(1.0, greatest(0.0, coalesce(try_cast(j->>'score' AS DOUBLE), 0.0))), 4) AS nid,
  greatest(1, least(5, coalesce(CASE WHEN json_type(j, '$.score') = 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(j->>'score'), '[+-]?\d+') THEN try_cast(j->>'score' AS INT) END ELSE trunc(try_cast(j->>'score' AS DOUBLE))::INT END, 1))) AS h FROM {_J})
 SELECT cache_key, round(CASE WHEN j IS NULL THEN 0.0 ELSE round(0.5 * nid + 0.5 * round((h - 1) / 4.0, 4), 4) END, 3) AS score, h AS raw_helpfulness, j IS NULL AS failed FROM x""",
    "cache_key": "SELECT cache_key, sha256(coalesce(judge_name, '') || '::' || coalesce(system_prompt, '') || '::' || coalesce(prompt, '')) AS computed FROM llm_cache",
    "cache_ttl": f"SELECT cache_key, cached_at FROM {_CACHE} WHERE {NOW} - cached_at <= {90 * 86400.0}",
    "cache_stats": f"""WITH c AS (SELECT * FROM {_CACHE}), k AS (SELECT DISTINCT cache_key FROM c WHERE {NOW} - cached_at <= {90 * 86400.0})
 SELECT count(k.cache_key) AS hits, count(*) - count(k.cache_key) AS misses, round(count(k.cache_key)::DOUBLE / count(*), 6) AS hit_rate, (SELECT count(*) FROM k) AS entries FROM c LEFT JOIN k USING (cache_key)""",
    "usage_rollup": f"SELECT provider || '/' || model AS model_key, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(round(sum(cost), 6), 4) AS cost, count(*) AS calls, (sum(input_tokens) + sum(output_tokens))::BIGINT AS total_tokens FROM {_CACHE} GROUP BY ROLLUP (provider || '/' || model)",
    "cost_estimate": f"""SELECT cache_key, round(CASE WHEN provider IN ('ollama', 'vllm') THEN 0.0 ELSE input_tokens / 1e6 * list_extract({[p[0] for p in K.PRICES.values()]}::DOUBLE[], (input_tokens % {len(K.PRICES)} + 1)::INT) + output_tokens / 1e6 * list_extract({[p[1] for p in K.PRICES.values()]}::DOUBLE[], (input_tokens % {len(K.PRICES)} + 1)::INT) END, 8) AS cost FROM {_CACHE}""",
    "pes_score": f"SELECT run_id, sample_index, state, round(CASE WHEN coalesce(faithfulness < 0.5, FALSE) THEN 0.0 ELSE raw END, 3) AS score, coalesce(faithfulness < 0.5, FALSE) AS gate_failed, round(raw, 3) AS score_before_gate FROM {_PES}",
    "pes_by_state": f"SELECT state, count(*) AS n, round(avg(CASE WHEN coalesce(faithfulness < 0.25, FALSE) THEN 0.0 ELSE raw END), 4) AS mean_score, count(*) FILTER (faithfulness < 0.25) AS gate_failures, round(avg(coalesce(faithfulness < 0.25, FALSE)::INT), 6) AS gate_rate FROM {_PES} GROUP BY 1",
    "pes_reason": f"""SELECT run_id, sample_index, 'State=' || CASE WHEN state = '' THEN '?' ELSE state END || ' (unknown) | weights=(' || printf('%.2f, %.2f, %.2f', w[1], w[2], w[3]) || ') | M1=' || printf('%.4f, M2=%.4f, M3=%.4f', m1, m2, m3) || ' | faithfulness=' || printf('%.4f', faithfulness) || ' (gate ' || CASE WHEN faithfulness < 0.5 THEN 'FAILED' ELSE 'PASSED' END || ')' AS reason
 FROM {_PES} WHERE faithfulness IS NOT NULL""",
    "ablation_grid": f"{_ABL} SELECT w1, w2, w3, count(*) AS n, round(avg(pes), 5) AS pes_mean, round({_RHO}, 5) AS rho FROM r GROUP BY 1, 2, 3",
    "ablation_topk": f"{_ABL} SELECT w1, w2, w3, round(rho, 5) AS rho FROM (SELECT w1, w2, w3, {_RHO} AS rho FROM r GROUP BY 1, 2, 3) WHERE rho IS NOT NULL ORDER BY round(rho, 10) DESC, w1, w2 LIMIT 10",
    "ablation_slices": f"{_ABL}, g AS (SELECT w1, w2, w3, round({_RHO}, 5) AS rho FROM r GROUP BY 1, 2, 3) SELECT CASE WHEN w2 < 0.025 THEN 0.0 WHEN abs(w2 - 0.15) < 0.025 THEN 0.15 WHEN abs(w2 - 0.30) < 0.025 THEN 0.30 END::DOUBLE AS slice, w1, w3, rho FROM g WHERE w2 < 0.025 OR abs(w2 - 0.15) < 0.025 OR abs(w2 - 0.30) < 0.025",
    "ablation_named": f"""WITH f AS (SELECT * FROM {_FRAME} WHERE truth IS NOT NULL), g(config, w1, w2, w3) AS (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in ablation.NAMED.items())}),
 s AS (SELECT config, truth, round(exp((w1 * ln(greatest(1e-6, coalesce(m1, 0.5))) + w2 * ln(greatest(1e-6, coalesce(m2, 0.5))) + w3 * ln(greatest(1e-6, coalesce(m3, 0.5)))) / (w1 + w2 + w3)), 12) AS pes FROM f CROSS JOIN g),
 r AS (SELECT *, rank() OVER (PARTITION BY config ORDER BY pes) + (count(*) OVER (PARTITION BY config, pes) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY config ORDER BY truth) + (count(*) OVER (PARTITION BY config, truth) - 1) / 2.0 AS rt FROM s)
 SELECT config, count(*) AS n, round(avg(pes), 5) AS pes_mean, round({_RHO}, 5) AS rho FROM r GROUP BY 1""",
    "judge_requests": _REQUESTS,
    "mathdial_parse": f"""SELECT 'mathdial-' || coalesce(qid, '') || '-t' || turn_index AS conversation_id, qid, CASE WHEN turn_index > 0 THEN array_to_string(hist, chr(10)) ELSE coalesce(question, '') END AS question, txt AS answer, move AS teacher_move, {_MOVE} AS move_score,
 coalesce(self_correctness, 'N/A') AS self_correctness, turn_index::INT AS turn_index, total_turns::INT AS total_turns, substring(txt, 1, 200) AS teacher_text
 FROM (SELECT *, list(role || ': ' || txt) OVER (PARTITION BY qid ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM {_TURNS}) WHERE role = 'Teacher' AND length(txt) >= 20 AND {_MOVE} IS NOT NULL""",
    "dialog_history": f"SELECT qid, turn_index::INT AS turn_index, role, move, txt AS text FROM {_TURNS}",
    "move_scores": f"SELECT move AS teacher_move, count(*) AS n, round(avg({_MOVE}), 6) AS mean_move_score FROM {_TURNS} WHERE role = 'Teacher' AND length(txt) >= 20 AND {_MOVE} IS NOT NULL GROUP BY 1",
    "cosine_pairs": f"SELECT a.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "centroid_similarity": f"""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
 SELECT vec_id, e.label, round({_DOT.format("embedding", "centre")} / (sqrt({_DOT.format("embedding", "embedding")}) * sqrt({_DOT.format("centre", "centre")})), 6) AS similarity FROM embeddings e JOIN c USING (label)""",
    "uptake_route": f"SELECT sample_index, CASE WHEN answer = '' THEN NULL WHEN len({Q.words('question')}) >= 5 THEN 'question' WHEN array_to_string(contexts, ' ') <> '' THEN 'context' ELSE 'none' END AS route FROM {Q.SAMPLES}",
    "uptake": rf"""WITH r AS (SELECT *, array_to_string(contexts, ' ') AS joined, len({Q.words("question")}) AS n FROM {Q.SAMPLES}),
 d AS (SELECT *, CASE WHEN answer = '' THEN NULL WHEN n >= 5 THEN 'question' WHEN joined <> '' THEN 'context' ELSE 'none' END AS route FROM r),
 w AS (SELECT *, list_distinct(regexp_extract_all(lower(CASE route WHEN 'question' THEN question WHEN 'context' THEN joined END), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]+')) AS b,
  list_transform(list_filter({Q.words("joined")}, lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+')), lambda x: lower(x)) AS s, list_transform(list_filter({Q.words("answer")}, lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+')), lambda x: lower(x)) AS t FROM d)
 SELECT sample_index, round(CASE WHEN a IS NULL OR len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 6) AS score,
  CASE route WHEN 'question' THEN 'Computed conversational uptake.' WHEN 'context' THEN 'Computed context uptake (question of ' || n || ' tokens is too short).' WHEN 'none' THEN 'Insufficient data to compute any uptake score.' ELSE '{tutoring.NO_ANSWER}' END AS reason,
  CASE WHEN route IS NOT NULL AND joined <> '' THEN round(CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_filter(s, lambda x: list_contains(t, x)))::DOUBLE / len(s) END, 6) END AS context_overlap FROM w""",
    "linguistic_adaptation": rf"""WITH x AS (SELECT sample_index, answer, {_TOK} AS t, regexp_extract_all(answer, '\p{{L}}+(?:[''’-]\p{{L}}+)*') AS w, greatest(1, len(regexp_extract_all(answer, '[.!?…]+(?:\s|$)')))::DOUBLE AS s FROM {Q.SAMPLES}),
 y AS (SELECT *, list_sum(list_transform(w, lambda v: greatest(1, len(regexp_extract_all(lower(v), '[aeiouyàâäáéèêëíìîïóòôöúùûü]+')) - (CASE WHEN len(regexp_extract_all(lower(v), '[aeiouyàâäáéèêëíìîïóòôöúùûü]+')) > 1 AND lower(v) LIKE '%e' AND lower(v) NOT LIKE '%le' AND lower(v) NOT LIKE '%ee' THEN 1 ELSE 0 END)))) AS y, len(w)::DOUBLE AS n FROM x),
 z AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * n / s - 84.6::DOUBLE * y / n END AS ease, CASE WHEN n = 0 THEN 0.0 ELSE 0.39::DOUBLE * n / s + 11.8::DOUBLE * y / n - 15.59::DOUBLE END AS grade,
  CASE WHEN len(t) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(t, lambda v: v IN ({_IN(tutoring.TENTATIVE)})))::DOUBLE / len(t) / 0.05) END AS tent, CASE WHEN len(list_filter(t, lambda v: v IN ({_IN(tutoring.CONTRAST)}))) > 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS crit FROM y)
 SELECT sample_index, CASE WHEN answer = '' THEN 0.0 ELSE round(least(1.0, greatest(0.0, 0.4::DOUBLE * least(1.0, greatest(0.0, ease / 100)) + 0.3::DOUBLE * tent + 0.3::DOUBLE * crit)), 4) END AS score, round(ease, 4) AS flesch_reading_ease, round(grade, 4) AS flesch_kincaid_grade, n::INT AS word_count FROM z""",
    "adaptation_lexicon": f"""WITH x AS (SELECT sample_index, {_TOK} AS t FROM {Q.SAMPLES}), n AS (SELECT *, len(list_filter(t, lambda w: w IN ({_IN(tutoring.TENTATIVE)}))) AS k FROM x)
 SELECT sample_index, k::INT AS tentative, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE least(1.0, k::DOUBLE / len(t) / 0.05) END, 3) AS score, len(list_filter(t, lambda w: w IN ({_IN(tutoring.CONTRAST)}))) > 0 AS contrast FROM n""",
    "run_root": "WITH RECURSIVE r(run_id, root_id) AS (SELECT event_id, event_id FROM events WHERE event_id < 3 UNION ALL SELECT e.event_id, r.root_id FROM events e JOIN r ON e.event_id // 3 = r.run_id WHERE e.event_id >= 3) SELECT run_id::VARCHAR AS run_id, root_id::VARCHAR AS root_id FROM r",
}
