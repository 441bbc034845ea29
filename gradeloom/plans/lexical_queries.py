"""Lexical metrics and text functions over the samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import lexical, synthetic
from gradeloom.plans import sqltext as Q
from gradeloom.session import read
from gradeloom.sources import canonical


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.samples(read(spark, sf_dir, "samples"))


def _metric(f: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = _samples(spark, sf_dir).select("sample_index", f(F.col("answer"), F.col("ground_truth")).alias("m"))
        return got.select("sample_index", *[F.round(F.col(f"m.{c}"), 8).alias(c) if c != "reason" else F.col("m.reason") for c in got.schema["m"].dataType.names])

    return run


def _text(c: Callable[[], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _samples(spark, sf_dir).select("sample_index", *[v.alias(k) for k, v in c().items()])


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"), F.size(X.chunk_sentences(F.col("text"))).alias("n_chunk_sentences"))


def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = F.col("answer"), F.col("ground_truth")
    got = _samples(spark, sf_dir).select("sample_index", *[lexical.rouge(a, t, v)["score"].alias(v) for v in ("rouge1", "rouge2", "rougeL")])
    return got


def _bleu_sql(n: int) -> str:
    a, t = ("regexp_extract_all(lower(answer), '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')", "regexp_extract_all(lower(ground_truth), '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')")
    hits = ", ".join(f"{Q.overlap(f'ga{k}', f'gt{k}')} AS h{k}" for k in range(1, n + 1))
    gs = ", ".join(f"{Q.grams('a', k)} AS ga{k}, {Q.grams('t', k)} AS gt{k}" for k in range(1, n + 1))
    logs = " + ".join(f"ln((CASE WHEN h{k} > 0 THEN h{k} ELSE 0.1 END)::DOUBLE / greatest(1, len(a) - {k - 1})) / {n}" for k in range(1, n + 1))
    return f"""WITH x AS (SELECT sample_index, answer, ground_truth, {a} AS a, {t} AS t FROM {Q.SAMPLES}),
 g AS (SELECT *, {gs} FROM x), h AS (SELECT *, {hits} FROM g)
 SELECT sample_index, round(CASE WHEN answer = '' OR ground_truth = '' OR len(a) = 0 OR len(t) = 0 OR h1 = 0 THEN 0.0
   ELSE (CASE WHEN len(a) > len(t) THEN 1.0 ELSE exp(1 - len(t)::DOUBLE / len(a)) END) * exp({logs}) END, 8) AS score,
   CASE WHEN answer = '' OR ground_truth = '' THEN 'Missing answer or ground truth.' WHEN len(a) = 0 OR len(t) = 0 THEN 'Empty after tokenization.' ELSE 'Computed BLEU-{n}' END AS reason FROM h"""


def _rouge_sql(n: int) -> str:
    tok = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f"""WITH x AS (SELECT sample_index, answer, ground_truth, {tok.format("answer")} AS a0, {tok.format("ground_truth")} AS t0 FROM {Q.SAMPLES}),
 g AS (SELECT *, {Q.grams("a0", n)} AS a, {Q.grams("t0", n)} AS t FROM x),
 h AS (SELECT *, {Q.overlap("a", "t")} AS hit FROM g),
 p AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE hit::DOUBLE / len(a) END AS p, CASE WHEN len(t) = 0 THEN 0.0 ELSE hit::DOUBLE / len(t) END AS r FROM h)
 SELECT sample_index, round(CASE WHEN answer = '' OR ground_truth = '' OR p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 8) AS score,
  CASE WHEN answer = '' OR ground_truth = '' THEN 'Missing answer or ground truth.' ELSE 'Computed rouge{n} F1' END AS reason, round(p, 8) AS precision, round(r, 8) AS recall FROM p"""


_SENT = rf"""list_filter(list_transform(string_split(regexp_replace(__TEXT__, '([.!?]){Q.SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g')), lambda s: s <> '')"""

_STRIPPED = f"lambda s: regexp_replace(s, '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g')"
_NEXT = rf"'([.!?]){Q.SPACE}+([A-Z\d\"''(\[])', '\1' || chr(1) || '\2', 'g'"
_GLUED = rf"'(?i)((?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(X.ABBREVIATIONS)})\.|\d\.)' || chr(1)"
_PER = rf"list_filter(list_transform(flatten(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, {_NEXT}), {_NEXT}), '\n\s*\n'), lambda p: string_split(regexp_replace(p, {_GLUED}, '\1 ', 'g'), chr(1)))), {_STRIPPED}), lambda s: s <> '')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), {_STRIPPED}), lambda s: s <> '')"
_ART = r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])"

QUERIES = {
    "exact_match": _metric(lexical.exact_match),
    "token_f1": _metric(lexical.token_f1),
    **{f"bleu{n}": _metric(lambda a, t, n=n: lexical.bleu(a, t, n)) for n in (1, 2, 3, 4)},
    **{f"rouge{n}": _metric(lambda a, t, n=n: lexical.rouge_n(a, t, n)) for n in (1, 2)},
    "rouge_stemmed": rouge_stemmed,
    "normalize_answer": _text(lambda: {"normalized": X.normalize_answer(F.col("answer"))}),
    "normalize_text": _text(lambda: {"normalized": X.normalize_text(F.col("answer"))}),
    "count_tokens": _text(lambda: {"n_tokens": X.count_tokens(F.col("answer"))}),
    "sentence_split": _text(lambda: {"sentences": X.sentences(F.col("answer"))}),
    "word_overlap": _text(lambda: {"overlap": F.round(X.word_overlap(F.array_join("contexts", " "), F.col("answer")), 8)}),
    "context_block": _text(lambda: {"block": X.context_block(F.col("contexts"))}),
    "html_escape": _text(lambda: {"escaped": X.html_escape(F.col("answer"))}),
    "qa_quality_filter": lambda spark, sf_dir: _samples(spark, sf_dir)
    .where(synthetic.accepted(F.col("question"), F.col("answer")))
    .select("sample_index"),
    "fixed_chunks": fixed_chunks,
    "document_sentences": document_sentences,
}

ORACLE = {
    "exact_match": f"""SELECT sample_index, CASE WHEN answer = '' OR ground_truth = '' THEN 0.0::DOUBLE WHEN {Q.tokens("answer")} = {Q.tokens("ground_truth")} THEN 1.0 ELSE 0.0 END AS score,
 CASE WHEN answer = '' OR ground_truth = '' THEN 'Missing answer or ground truth.' WHEN {Q.tokens("answer")} = {Q.tokens("ground_truth")} THEN 'Matched exactly after normalization.' ELSE 'Did not match exactly.' END AS reason FROM {Q.SAMPLES}""",
    "token_f1": f"""WITH x AS (SELECT sample_index, answer, ground_truth, {Q.tokens("answer")} AS a, {Q.tokens("ground_truth")} AS t FROM {Q.SAMPLES}),
 h AS (SELECT *, answer = '' OR ground_truth = '' AS miss, {Q.overlap("a", "t")} AS hit FROM x),
 p AS (SELECT *, CASE WHEN miss OR len(a) = 0 THEN 0.0 ELSE hit::DOUBLE / len(a) END AS p, CASE WHEN miss OR len(t) = 0 THEN 0.0 ELSE hit::DOUBLE / len(t) END AS r FROM h)
 SELECT sample_index, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 8) AS score,
 CASE WHEN miss THEN 'Missing answer or ground truth.' WHEN len(a) = 0 OR len(t) = 0 THEN 'Empty after normalization.' WHEN hit = 0 THEN 'No common tokens.' ELSE 'Computed token-level F1' END AS reason,
 round(p, 8) AS precision, round(r, 8) AS recall FROM p""",
    **{f"bleu{n}": _bleu_sql(n) for n in (1, 2, 3, 4)},
    **{f"rouge{n}": _rouge_sql(n) for n in (1, 2)},
    "normalize_answer": f"SELECT sample_index, array_to_string({Q.tokens('answer')}, ' ') AS normalized FROM {Q.SAMPLES}",
    "normalize_text": rf"SELECT sample_index, trim(regexp_replace(regexp_replace(regexp_replace(lower(answer), '{_ART}', '\1 \2', 'g'), '{_ART}', '\1 \2', 'g'), '{Q.SPACE}+', ' ', 'g')) AS normalized FROM {Q.SAMPLES}",
    "count_tokens": f"SELECT sample_index, floor(len({Q.words('answer')}) * 1.3)::INT AS n_tokens FROM {Q.SAMPLES}",
    "sentence_split": f"SELECT sample_index, {_SENT.replace('__TEXT__', 'answer')} AS sentences FROM {Q.SAMPLES}",
    "word_overlap": rf"""WITH x AS (SELECT sample_index, list_transform(list_filter({Q.words("array_to_string(contexts, ' ')")}, lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+')), lambda w: lower(w)) AS s,
 list_transform(list_filter({Q.words("answer")}, lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+')), lambda w: lower(w)) AS t FROM {Q.SAMPLES})
 SELECT sample_index, round(CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_filter(s, lambda w: list_contains(t, w)))::DOUBLE / len(s) END, 8) AS overlap FROM x""",
    "context_block": f"SELECT sample_index, array_to_string(list_transform(contexts, lambda c, i: '[' || (i - 1)::VARCHAR || '] ' || c), chr(10)) AS block FROM {Q.SAMPLES}",
    "html_escape": f"SELECT sample_index, replace(replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM {Q.SAMPLES}",
    "qa_quality_filter": f"SELECT sample_index FROM {Q.SAMPLES} WHERE length(trim(question)) >= 10 AND length(trim(answer)) >= 2 AND lower(trim(question)) <> lower(trim(answer))",
    "document_sentences": f"SELECT doc_id, len({_SENT.replace('__TEXT__', 'text')})::INT AS n_sentences, CASE WHEN len(got) > 0 THEN len(got) WHEN len(lines) > 0 THEN len(lines) ELSE 1 END::INT AS n_chunk_sentences FROM (SELECT *, {_PER} AS got, {_LINES} AS lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "fixed_chunks": "SELECT doc_id, (i // 800)::INT AS chunk_no, substring(text, i + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents WHERE text <> '')",
}
