"""Queries of sources, sinks, adapters and the evaluation run: tables written and read again, and shapes rebuilt from the
samples, so that SQL over the samples says the same."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import evaluator
from gradeloom.operators import capture, tutoring
from gradeloom.operators import results as R
from gradeloom.plans import sqltext as Q
from gradeloom.plans.judge_queries import _prompt_sql
from gradeloom.plans.lexical_queries import ORACLE as LEXICAL
from gradeloom.registry import Registry, install
from gradeloom.session import ensure_checkpoint_dir, kept, read
from gradeloom.sources import adapters, canonical, dialogues, loaders, sinks


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.samples(read(spark, sf_dir, "samples"))


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


def _source(name: str, s: DataFrame) -> DataFrame:
    """Rows in the shape of a public benchmark, made of the samples."""
    seq, q, t = F.col("sample_index").alias("seq"), F.col("question"), F.col("ground_truth")
    kind = F.coalesce("source", F.lit("")).alias("type")
    if name == "hotpotqa":
        context = F.struct(F.transform("contexts", lambda c: F.substring(c, 1, 8)).alias("title"), F.transform("contexts", lambda c: F.array(F.substring(c, 1, 20), F.lit(" end."))).alias("sentences"))
        return s.select(seq, q, t.alias("answer"), context.alias("context"), F.lit("easy").alias("level"), kind)
    if name == "nq":
        return s.select(seq, q, F.array(t, F.col("answer")).alias("answer"))
    if name == "triviaqa":
        return s.select(seq, q, F.struct(t.alias("value"), F.array("answer").alias("aliases")).alias("answer"), F.struct(F.col("contexts").alias("search_context")).alias("search_results"))
    if name == "squad2":
        texts = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
        return s.select(seq, q, F.struct(texts.alias("text")).alias("answers"), F.col("answer").alias("context"))
    if name == "rgb":
        return s.select(seq, q.alias("query"), t.alias("answer"), F.transform("contexts", lambda c: F.struct(c.alias("text"))).alias("docs"), kind)
    return s.select(seq, q, t.alias("ground_truth"), F.col("answer").alias("context"), kind)


def _adapter(name: str):  # type: ignore[no-untyped-def]
    return lambda spark, sf_dir: adapters.get_adapter(name)(_source(name, _samples(spark, sf_dir)))


def _written(kind: str):  # type: ignore[no-untyped-def]
    """Samples written as files of one format and loaded again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _samples(spark, sf_dir).select("question", "answer", "ground_truth", "contexts", F.coalesce("metadata", F.lit("{}")).alias("metadata"))
        path = f"{_folder(spark)}.{kind}"
        if kind == "csv":
            s.withColumn("contexts", F.to_json("contexts")).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        else:
            s.write.json(path)
        return kept(loaders.load_dataset(spark, path, kind).drop("sample_index"), path)

    return run


def load_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other column names, mapped while loading."""
    path = f"{_folder(spark)}.jsonl"
    _samples(spark, sf_dir).select(F.col("question").alias("q"), F.col("answer").alias("a"), F.col("ground_truth").alias("gt"), F.col("contexts").alias("ctx")).write.json(path)
    got = loaders.load_dataset(spark, path, None, {"q": "question", "a": "answer", "gt": "ground_truth", "ctx": "contexts", "nothing": "metadata"})
    return kept(got.select("question", "answer", "ground_truth", "contexts"), path)


def load_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of all samples with their numbers in its order."""
    path = f"{_folder(spark)}.json"
    rows = F.array_sort(F.collect_list(F.struct("sample_index", "question", "answer")))
    _samples(spark, sf_dir).agg(F.to_json(rows).alias("value")).coalesce(1).write.text(path)
    return kept(loaders.load_dataset(spark, path, "json").select("sample_index", "question", "answer"), path)


def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = loaders.validate(_samples(spark, sf_dir))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results as a JSON report, read back."""
    path = _folder(spark)
    sinks.write_json(R.canonical_results(read(spark, sf_dir, "eval_results")).select("run_id", "sample_index", "metric_name", "score", "reason"), path)
    got = loaders.read_report(spark, path)
    return kept(got.select(*[F.col(c).cast(t).alias(c) for c, t in (("run_id", "string"), ("sample_index", "long"), ("metric_name", "string"), ("score", "double"), ("reason", "string"))]), path)


def evaluate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batched run in two goes, the second of which finds the first one's batches done."""
    s, path = _samples(spark, sf_dir), _folder(spark)
    evaluator.evaluate_batches(s.where("sample_index < 200"), ["exact_match"], path, 50)
    got = evaluator.evaluate_batches(s, ["exact_match"], path, 50)
    return kept(got.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum("score").alias("hits")), path)


def _length_judge(system: str, prompt: str) -> str:
    return f'```json\n{{"score": {len(prompt) % 100 / 100}, "reason": "r{len(prompt)}"}}\n```'


def evaluate_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge metric through requests, a judge and the parser; the judge rates the length of the prompt."""
    got = evaluator.evaluate(_samples(spark, sf_dir), ["answer_relevance"], judge=_length_judge, model="length")
    return got.withColumn("score", F.round("score", 6))


def evaluate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics that SQL knows, through the evaluator."""
    got = evaluator.evaluate(_samples(spark, sf_dir), ["exact_match", "token_f1", "bleu-4"])
    return R.mean_scores(got).withColumn("mean_score", F.round("mean_score", 6))


def _short_encoder(texts: list[str]) -> np.ndarray:
    return np.array([[1.0, len(t) % 7] for t in texts]).reshape(-1, 2)


def similarity_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic similarity with an encoder given from outside: vectors (1, length modulo 7)."""
    r = Registry()
    install(r)
    got = _samples(spark, sf_dir).select("sample_index", "answer", "ground_truth", r.create("semantic_similarity", encoder=_short_encoder).alias("m"))
    return got.where("answer <> '' and ground_truth <> ''").select("sample_index", F.round("m.score", 6).alias("score"))


def _unit_encoder(texts: list[str]) -> np.ndarray:
    v = np.array([[1.0, len(t) % 5] for t in texts]).reshape(-1, 2)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def alignment_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token alignment with an encoder given from outside: unit vectors along (1, length modulo 5)."""
    r = Registry()
    install(r)
    got = _samples(spark, sf_dir).where("answer <> '' and ground_truth <> ''").select("sample_index", r.create("bert_score", encoder=_unit_encoder).alias("m"))
    return got.select("sample_index", *[F.round(f"m.{c}", 6).alias(c) for c in ("score", "precision", "recall")])


def uptake_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tutoring.uptake(F.col("question"), F.col("answer"), F.col("contexts"))
    return _samples(spark, sf_dir).select("sample_index", m.alias("m")).select("sample_index", F.round("m.score", 6).alias("score"))


def responses_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated responses of two models per conversation, made of the samples."""
    label = lambda k: F.element_at(F.array(F.lit("Yes"), F.lit("To some extent"), F.lit("No")), F.pmod(F.col("sample_index") + k, F.lit(3)).cast("int") + 1)
    notes = lambda k: F.create_map(F.lit("Providing_Guidance"), label(k), F.lit("Actionability"), label(k + 1))
    kind = "struct<response: string, annotation: map<string, string>>"
    reply = lambda c, k: F.struct(F.col(c).alias("response"), notes(k).alias("annotation")).cast(kind)
    history = F.concat(F.lit("Tutor: Hello. The question is: "), F.col("question"), F.lit(" \\n Student: I do not know."))
    c = _samples(spark, sf_dir).select(F.col("sample_index").cast("string").alias("conversation_id"), history.alias("conversation_history"), F.create_map(F.lit("A"), reply("answer", 0), F.lit("B"), reply("ground_truth", 1)).alias("tutor_responses"))
    return dialogues.response_samples(c).withColumn("contexts", F.col("contexts")[0])


def chain_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of one chain per sample, with a retriever below it that reports its documents twice."""
    s = _samples(spark, sf_dir)
    root, child = F.concat(F.lit("run-"), "sample_index"), F.concat(F.lit("retriever-"), "sample_index")
    none = F.lit(None).cast("string")
    event = lambda run, parent, kind, seq, payload: F.struct(run.alias("run_id"), parent.alias("parent_run_id"), F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), payload.alias("payload"), none.alias("metadata"))
    documents = F.to_json("contexts")
    log = F.array(
        event(root, none, "chain_start", 1, F.to_json(F.struct(F.col("question").alias("query")))),
        event(child, root, "documents", 2, documents),
        event(root, none, "documents", 3, documents),
        event(root, none, "chain_end", 4, F.to_json(F.struct(F.col("answer").alias("result")))),
    )
    return capture.captured_samples(s.select(F.explode(log).alias("e")).select("e.*")).select("root_id", "question", "answer", "contexts")


_NAMES = ("hotpotqa", "nq", "triviaqa", "squad2", "rgb", "recall")
QUERIES = {
    **{f"benchmark_{n}": _adapter(n) for n in _NAMES},
    **{f"load_{k}": _written(k) for k in ("jsonl", "csv")},
    **{f.__name__: f for f in (load_mapped, load_array, dataset_validation, report_roundtrip, evaluate_batches, evaluate_judged, evaluate_means, similarity_injected, alignment_injected, uptake_overlap, responses_parse, chain_capture)},
}

_BENCH = "SELECT sample_index AS seq, question, '' AS answer, {} AS ground_truth, {} AS contexts, {} AS metadata FROM " + Q.SAMPLES + " {}"
_LOADED = f"SELECT question, answer, ground_truth, contexts, coalesce(metadata, '{{}}') AS metadata FROM {Q.SAMPLES}"
_SET = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_ROUTE = f"(SELECT *, CASE WHEN answer = '' THEN NULL WHEN len({Q.words('question')}) >= 5 THEN question WHEN array_to_string(contexts, ' ') <> '' THEN array_to_string(contexts, ' ') END AS src FROM {Q.SAMPLES})"
_TOKEN = r"[\p{L}\p{N}_]+"
_COS = "(1 + (length(x) % 5) * (length(y) % 5)) / sqrt((1.0 + pow(length(x) % 5, 2)) * (1.0 + pow(length(y) % 5, 2)))"
_LABEL = "list_extract(['Yes', 'To some extent', 'No'], ((sample_index + {}) % 3 + 1)::INT)"
_VALUE = "list_extract([1.0, 0.5, 0.0], ((sample_index + {}) % 3 + 1)::INT)::DOUBLE"


def _response(model: str, position: int, answer: str) -> str:
    g, a = _VALUE.format(position), _VALUE.format(position + 1)
    return f"""SELECT sample_index::VARCHAR AS conversation_id, '{model}' AS model_name, {position}::INT AS position, 'Tutor: Hello. The question is: ' || question || ' \\n Student: I do not know.' AS question, {answer} AS answer,
 CASE WHEN regexp_matches(question, '\\S') THEN {_TRIM} ELSE 'Hello. The question is:' END AS contexts, {_LABEL.format(position)} AS providing_guidance_label, {_LABEL.format(position + 1)} AS actionability_label, {g} AS providing_guidance, {a} AS actionability, round(0.6 * {g} + 0.4 * {a}, 2) AS combined_score FROM {Q.SAMPLES}"""


_TRIM = r"regexp_replace(question, '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g')"
ORACLE = {
    "benchmark_hotpotqa": _BENCH.format("ground_truth", "list_transform(contexts, lambda c: 'Title: ' || substring(c, 1, 8) || chr(10) || substring(c, 1, 20) || ' end.')", "'{\"level\":\"easy\",\"type\":\"' || coalesce(source, '') || '\"}'", ""),
    "benchmark_nq": _BENCH.format("ground_truth", "[]::VARCHAR[]", "to_json({'all_answers': [ground_truth, answer]})::VARCHAR", ""),
    "benchmark_triviaqa": _BENCH.format("ground_truth", "list_filter(contexts, lambda c: c <> '')", "to_json({'aliases': [answer]})::VARCHAR", ""),
    "benchmark_squad2": _BENCH.format("ground_truth", "[answer]", "NULL::VARCHAR", "WHERE ground_truth <> ''"),
    "benchmark_rgb": _BENCH.format("ground_truth", "contexts", "to_json({'type': coalesce(source, '')})::VARCHAR", ""),
    "benchmark_recall": _BENCH.format("ground_truth", "[answer]", "to_json({'type': coalesce(source, '')})::VARCHAR", ""),
    "load_jsonl": _LOADED,
    "load_csv": _LOADED,
    "load_mapped": f"SELECT question, answer, ground_truth, contexts FROM {Q.SAMPLES}",
    "load_array": f"SELECT row_number() OVER (ORDER BY sample_index) - 1 AS sample_index, question, answer FROM {Q.SAMPLES}",
    "dataset_validation": f"SELECT count(*) AS n, count(*) FILTER (answer = '') AS missing_answers, count(*) FILTER (len(contexts) = 0) AS missing_contexts, count(*) FILTER (ground_truth = '') AS missing_ground_truths FROM {Q.SAMPLES}",
    "report_roundtrip": f"SELECT run_id, sample_index, metric_name, score, reason FROM {Q.RESULTS}",
    "evaluate_batches": f"SELECT sample_index // 50 AS batch, count(*) AS n, sum(CASE WHEN answer = '' OR ground_truth = '' THEN 0.0 WHEN {Q.tokens('answer')} = {Q.tokens('ground_truth')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hits FROM {Q.SAMPLES} GROUP BY 1",
    "evaluate_judged": f"""SELECT sample_index, 'answer_relevance' AS metric_name, CASE WHEN answer = '' THEN 0.0 ELSE round(length(p) % 100 / 100.0, 6) END::DOUBLE AS score, CASE WHEN answer = '' THEN 'No answer provided.' ELSE 'r' || length(p) END AS reason
 FROM (SELECT sample_index, answer, {_prompt_sql("answer_relevance")} AS p FROM {Q.SAMPLES})""",
    "evaluate_means": " UNION ALL ".join(f"SELECT '{m}' AS metric_name, round(avg(score), 6) AS mean_score FROM ({LEXICAL[k]})" for m, k in (("exact_match", "exact_match"), ("token_f1", "token_f1"), ("bleu-4", "bleu4"))),
    "similarity_injected": f"SELECT sample_index, round((1 + a * b) / sqrt((1.0 + a * a) * (1.0 + b * b)), 6) AS score FROM (SELECT sample_index, length(answer) % 7 AS a, length(ground_truth) % 7 AS b FROM {Q.SAMPLES} WHERE answer <> '' AND ground_truth <> '')",
    "alignment_injected": rf"""WITH w AS (SELECT sample_index, regexp_extract_all(lower(answer), '{_TOKEN}') AS a, regexp_extract_all(lower(ground_truth), '{_TOKEN}') AS t FROM {Q.SAMPLES} WHERE answer <> '' AND ground_truth <> ''),
 p AS (SELECT sample_index, coalesce(list_avg(list_transform(a, lambda x: list_max(list_transform(t, lambda y: {_COS})))), 0.0) AS p, coalesce(list_avg(list_transform(t, lambda x: list_max(list_transform(a, lambda y: {_COS})))), 0.0) AS r FROM w)
 SELECT sample_index, round(CASE WHEN p + r > 0 THEN least(1.0, greatest(0.0, 2 * p * r / (p + r))) ELSE 0.0 END, 6) AS score, round(p, 6) AS precision, round(r, 6) AS recall FROM p""",
    "uptake_overlap": f"""SELECT sample_index, round(CASE WHEN src IS NULL OR len({_SET.format("src")}) = 0 THEN 0.0 ELSE len(list_intersect({_SET.format("src")}, {_SET.format("answer")}))::DOUBLE / len({_SET.format("src")}) END, 6) AS score FROM {_ROUTE}""",
    "responses_parse": _response("A", 0, "answer") + " UNION ALL " + _response("B", 1, "ground_truth"),
    "chain_capture": f"SELECT 'run-' || sample_index AS root_id, question, answer, list_transform(list_filter(list_transform(contexts, lambda c, i: {{'c': c, 'first': list_position(contexts, c) = i}}), lambda x: x.first), lambda x: x.c) AS contexts FROM {Q.SAMPLES}",
}
