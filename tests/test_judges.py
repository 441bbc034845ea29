import json
import math

import pytest
from pyspark.sql import functions as F

from gradeloom import evaluator
from gradeloom.functions import jsontext, scoring as K
from gradeloom.operators import ablation, capture, judges, synthetic, usage
from gradeloom.registry import REGISTRY


def parsed(spark, f, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"t{i} string" for i in range(len(texts))))
    return df.select(f(*[F.col(f"t{i}") for i in range(len(texts))]).alias("m")).first()["m"]


def test_judge_parsing(spark):
    f = parsed(spark, judges.faithfulness, '{"claims": [{"supported": true}, {"supported": "false"}, {"supported": 0}, {}], "reason": "r"}')
    assert f["score"] == 0.5 and f["reason"] == "r"
    assert parsed(spark, judges.faithfulness, '{"claims": []}')["score"] == 1.0
    bad = parsed(spark, judges.faithfulness, "no json")
    assert bad["score"] == 0.0 and bad["reason"].startswith("Failed to evaluate")
    assert parsed(spark, judges.faithfulness, None)["score"] == 0.0
    assert parsed(spark, judges.context_recall, '{"statements": []}')["score"] == 0.0
    assert parsed(spark, judges.context_precision, '{"evaluations": []}')["score"] == 1.0
    assert parsed(spark, judges.answer_relevance, '```json\n{"score": "1.7"}\n```')["score"] == 1.0
    assert parsed(spark, judges.answer_relevance, '{"score": "high"}')["error"] is not None
    s = parsed(spark, judges.state, 'Sure: {"state": "State B", "confidence": "x"}')
    assert s["state"] == "A" and s["score"] == 0.0


def test_disclosure(spark):
    cases = {('{"score": 1.0}', '{"score": 5}'): 1.0, ('{"score": 0.0}', '{"score": 2}'): 0.125, ('{"score": 1.0}', '{"score": 4}'): 0.875, ('{"score": 2.5}', '{"score": "not_a_number"}'): 0.5, ('{"score": 1}', '{"score": 3.7}'): 0.75, ('{"score": 1}', '{"score": "3.7"}'): 0.5}
    for (a, b), want in cases.items():
        assert parsed(spark, judges.disclosure, a, b)["score"] == want
    assert math.isclose(parsed(spark, lambda a, b: judges.disclosure(a, b, (0.8, 0.2)), '{"score": 1.0}', '{"score": 3}')["score"], 0.9)
    assert parsed(spark, judges.disclosure, "x", '{"score": 5}')["reason"].startswith("Failed to evaluate")


def test_composite(spark):
    def pes(m, state, faith=1.0, tau=0.5):
        return spark.range(1).select(K.composite(*[F.lit(float(x)) for x in m], F.lit(state), F.lit(faith), tau).alias("c")).first()["c"]

    assert abs(pes((1, 1, 0.1), "B", 0.9)["score"] - 0.1995) < 1e-4
    assert pes((1, 1, 1), "A")["score"] == 1.0
    low = pes((0.8, 0.7, 0.6), "A", 0.3)
    assert low["score"] == 0.0 and low["gate_failed"] and low["score_before_gate"] > 0
    assert pes((0.8, 0.7, 0.6), "A", 0.5)["score"] > 0
    assert 0 < pes((0, 1, 1), "")["score"] < 0.02
    zero = spark.range(1).select(K.geometric_mean((F.lit(1.0),) * 3, (F.lit(0.0),) * 3).alias("x")).first()["x"]
    assert zero == 0.0
    assert spark.range(1).select(K.clamp(F.lit(None).cast("double")).alias("x")).first()["x"] is None


def test_json_extraction():
    assert jsontext.find_json('{"a": 1}') == '{"a": 1}'
    assert json.loads(jsontext.find_json('x {"a": {"b": 2}} y')) == {"a": {"b": 2}}
    assert jsontext.find_json("see [1, 2] there") == "[1, 2]"
    assert jsontext.find_json("none") is None and jsontext.find_json(None) is None


def test_cosine(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(K.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert abs(f([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]) - 32 / math.sqrt(14 * 77)) < 1e-12 and f([0.0, 0.0], [1.0, 1.0]) == 0.0 and f(None, [1.0]) is None
    with pytest.raises(Exception, match="unequal"):
        f([1.0], [1.0, 2.0])


SAMPLES = "sample_index long, question string, answer string, ground_truth string, contexts array<string>"


def test_evaluation_with_cache_judge_and_failures(spark):
    s = spark.createDataFrame([(1, "Why does it work so well?", "Because.", "It does.", ["c"]), (2, "q", "", "", [])], SAMPLES)
    asked = judges.requests(s, ["answer_relevance"], "m")
    key = asked.first()["key"]
    cache = spark.createDataFrame([(key, '{"score": 0.75, "reason": "ok"}', 1.0), (key, '{"score": 0.1}', 0.5)], "cache_key string, text string, cached_at double")
    got = {(r["sample_index"], r["metric_name"]): r for r in evaluator.evaluate(s, ["answer_relevance", "exact_match", "Token-F1"], cache, model="m").collect()}
    assert got[1, "answer_relevance"]["score"] == 0.75 and got[2, "answer_relevance"]["reason"] == judges.NO_ANSWER
    assert got[2, "token_f1"]["score"] == 0.0 and len(got) == 6

    def judge(system, prompt):
        if "Rate from 1 to 5" in prompt:
            return '{"score": 5}'
        if "withholds" in prompt:
            return '{"score": 1.0}'
        if "List every claim" in prompt:
            raise RuntimeError("down")
        return '{"state": "A", "confidence": 1}'

    fast = lambda m: judges.ask(m, judge, attempts=2, wait=0.0)
    errors = fast(judges.requests(s, ["faithfulness"], "m")).first()
    assert errors["text"] is None and errors["error"] == "down"
    d = evaluator.disclosure_results(s, cache, judge, "m").orderBy("sample_index").collect()
    assert [r["score"] for r in d] == [1.0, 0.0]
    with pytest.raises(ValueError):
        REGISTRY.get("nope")


def test_prompts_are_sent_once_and_answers_are_kept(spark, tmp_path):
    from gradeloom.providers import Reply

    s = spark.createDataFrame([(i, "How do I start?", "Look at the sign.", "", ["c"]) for i in range(4)], SAMPLES)
    log = tmp_path / "calls"

    def judge(system, prompt):
        with open(log, "a") as f:
            f.write("x")
        if "List every claim" in prompt:
            return Reply.of('Well: {"claims": [{"supported": true}]} and {"claims": []}', 10, 5)
        return Reply.of('{"state": "A", "confidence": 0.5, "score": 4, "reason": "r"}', 10, 5)

    told = []
    args = dict(judge=judge, model="gpt-4o", cache_path=str(tmp_path / "cache"), on_answers=lambda a: told.append(usage.totals(usage.priced(a, "gpt-4o", "openai"))), at_once=3)
    one = evaluator.evaluate(s, ["pes", "faithfulness", "state", "no_immediate_disclosure"], **args)
    rows = {(r["sample_index"], r["metric_name"]): r["score"] for r in one.collect()}
    assert len(rows) == 16 and rows[0, "faithfulness"] == 1.0 and rows[0, "state"] == 0.5
    # Four equal samples, four prompts; nothing is asked for two metrics' sake or again by a later action.
    assert len(log.read_text()) == 4
    assert told == [{"total_input_tokens": 40, "total_output_tokens": 20, "total_estimated_cost": 0.0003}]
    two = evaluator.evaluate(s, ["pes"], **args)
    assert two.count() == 4 and len(log.read_text()) == 4 and told[1]["total_input_tokens"] == 0
    expired = evaluator.evaluate(s, ["state"], **(args | {"ttl": -1.0}))
    assert expired.count() == 4 and len(log.read_text()) == 5


def test_first_balanced_object(spark):
    texts = ['{"a": 1}', 'x {"a": {"b": 2}} y {"a": 3}', "```json\n{\"a\": 4}\n```", "no", "{ open", None, "} {}"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.to_json(jsontext.payload(F.col("t"))).alias("p")).collect()
    assert [r["p"] for r in got] == ['{"a":1}', '{"a":{"b":2}}', '{"a":4}', None, None, None, "{}"]


def test_roots_of_deep_chains_and_cycles(spark):
    n = 10_000
    rows = [(f"r{i}", f"r{i - 1}" if i else None) for i in range(n)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c4", "c1"), ("lost", "nowhere"), ("l2", "lost"), (None, "r1")]
    rows += [(f"s{i}", "big") for i in range(3000)] + [("big", None)]
    got = {r["run_id"]: r["root_id"] for r in capture.roots(spark.createDataFrame(rows, "run_id string, parent_run_id string")).collect()}
    assert got == {f"r{i}": "r0" for i in range(n)} | {f"s{i}": "big" for i in range(3000)} | {"big": "big"}
    assert capture.roots(spark.createDataFrame([], "run_id string, parent_run_id string")).count() == 0


def test_batches_resume(spark, tmp_path):
    s = spark.createDataFrame([(i, f"q{i}", "a", "a", ["c"]) for i in range(5)], SAMPLES)
    seen = []
    path = str(tmp_path / "out")
    one = evaluator.evaluate_batches(s.where("sample_index < 2"), ["exact_match"], path, 2, lambda df, n: seen.append((n, df.count())))
    assert one.count() == 2 and seen == [(0, 2)]

    def broken(df, n):
        raise RuntimeError

    two = evaluator.evaluate_batches(s, ["exact_match"], path, 2, broken)
    assert sorted(r["sample_index"] for r in two.collect()) == [0, 1, 2, 3, 4]


def test_usage_and_cache(spark):
    rows = spark.createDataFrame([("openai", "gpt-4o", 100, 50, 0.00075), ("ollama", "llama3.2", 30, 20, 0.0)], "provider string, model string, input_tokens long, output_tokens long, cost double")
    got = {r["model_key"]: r for r in usage.usage(rows).collect()}
    assert got[None]["total_tokens"] == 200 and got["openai/gpt-4o"]["cost"] == 0.00075 and got[None]["calls"] == 2
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    st = usage.cache_stats(asked, spark.createDataFrame([("a",)], "cache_key string")).first()
    assert (st["hits"], st["misses"], st["entries"]) == (1, 2, 1) and abs(st["hit_rate"] - 1 / 3) < 1e-12
    assert usage.cache_stats(asked.where("false"), asked.select(F.col("key").alias("cache_key")).where("false")).first()["hit_rate"] == 0.0


def test_grid(spark):
    assert ablation.weight_grid(spark).count() == 231
    frame = spark.createDataFrame([(i / 20, 1 - i / 20, 0.5, False, float(i)) for i in range(10)] + [(None, 0.1, 0.2, True, 3.0), (0.1, 0.1, 0.1, False, None)], "m1 double, m2 double, m3 double, gate_failed boolean, truth double")
    got = ablation.ablate(frame, ablation.named_grid(spark), "truth").collect()
    by = {r["config"]: r for r in got}
    assert by["M1-only"]["n"] == 11 and by["M1-only"]["rho"] > 0.7 > by["M2-only"]["rho"]


def test_roots_and_capture(spark):
    e = [("r", None, "chain_start", 1, '{"question": "Why?"}', "m"), ("c", "r", "chain_start", 2, "{}", None), ("d", "c", "documents", 3, '["one", "two"]', None), ("c", "r", "documents", 4, '["two"]', None), ("r", None, "chain_end", 5, '{"result": "So."}', None), ("x", "lost", "documents", 6, '["no"]', None), ("p", "q", "documents", 7, "[]", None), ("q", "p", "documents", 8, "[]", None), ("s", None, "chain_start", 9, "plain", None)]
    df = spark.createDataFrame(e, "run_id string, parent_run_id string, kind string, seq int, payload string, metadata string")
    got = {r["root_id"]: r for r in capture.captured_samples(df).collect()}
    assert set(got) == {"r", "s"} and got["r"]["question"] == "Why?" and got["r"]["answer"] == "So." and got["r"]["contexts"] == ["one", "two"]
    assert got["s"]["question"] == "plain" and got["s"]["answer"] == "" and got["s"]["contexts"] == []
    assert capture.roots(df.where("false")).count() == 0


def test_generation(spark):
    def judge(system, prompt):
        if system == synthetic.SYSTEM:
            return '{"question": "What is the capital?", "answer": "Paris"}' if "one" in prompt else '{"question": "What?", "answer": "Yes"}'
        return "an answer"

    got = synthetic.generate(spark.createDataFrame([("chunk one a",), ("chunk one b",), ("two",)], "chunk string"), judge).collect()
    assert len(got) == 1 and got[0]["ground_truth"] == "Paris" and got[0]["answer"] == "an answer" and len(got[0]["contexts"]) == 2


def test_study_runs_and_resumes(spark):
    from gradeloom.operators import study
    from gradeloom.sources import dialogues

    turns = "|EOM|".join(f"Teacher: ({m})Could you explain step {i} to me again?|EOM|Student: I would rather not say much." for i, m in enumerate(["probing", "focus", "telling", "generic"] * 3))
    d = spark.createDataFrame([("1", "P", "S", "W", "Yes", turns)], "qid string, question string, ground_truth string, student_incorrect_solution string, self_correctness string, conversation string")
    notes = study.study_samples(dialogues.dialogue_samples(d))

    def judge(system, prompt):
        return '{"state": "A", "confidence": 1, "claims": [{"supported": true}], "score": 1}'

    none = spark.createDataFrame([], "cache_key string, text string, cached_at double")
    keep = ["conversation_id", "teacher_move", "move_score"]
    first = study.run(notes, judge, "m", none, keep, limit=5)
    assert first.count() == 5 and {r["state_code"] for r in first.collect()} == {"A"}
    whole = study.run(notes, judge, "m", none, keep, earlier=first)
    rows = whole.collect()
    assert len(rows) == 12 and all(0 <= r["pes_score"] <= 1 for r in rows)
    assert {r["sample_index"] for r in study.sample_slice(notes, 3, 2).collect()} == {3, 4}
    tests = {r["test"] for r in study.validation(whole, "pes_before_gate", "teacher_move", "move_score", study.MOVES).collect()}
    assert {"spearman", "kruskal", "mannwhitney"} <= tests
    assert study.validation(whole.where("false"), "pes_before_gate", "teacher_move", "move_score", study.MOVES).count() == 0


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert usage.load(spark, path).count() == 0
    answers = spark.createDataFrame([("a", "one", None), ("b", None, "down")], "key string, text string, error string")
    usage.put(answers, path, 1.0)
    usage.put(answers.withColumn("text", F.lit("two")).where("key = 'a'"), path, 2.0)
    assert [tuple(r) for r in usage.load(spark, path).collect()] == [("a", "two", 2.0)]
    usage.clear(spark, path)
    assert usage.load(spark, path).count() == 0


def test_lemmas_reach_the_tentative_words(spark):
    from gradeloom.registry import Registry, install

    r = Registry()
    install(r)
    df = spark.createDataFrame([("It seems right. This appears fine.",)], "answer string")
    plain = df.select(r.create("linguistic_adaptation").alias("m")).first()["m"]["score"]
    lemmas = lambda texts: [t.replace("seems", "seem").replace("appears", "appear") for t in texts]
    assert df.select(r.create("linguistic_adaptation", lemmas=lemmas, scorer=None).alias("m")).first()["m"]["score"] > plain
