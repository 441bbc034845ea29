import json

import pytest

from gradeloom import cli, config
from gradeloom.functions import chunking
from gradeloom.operators import vectors
from gradeloom.sources import adapters, canonical, dialogues, loaders, sinks

ROWS = [{"question": "q1", "answer": "a1", "ground_truth": "g1", "contexts": ["x"]}, {"question": "q2", "answer": "a2", "ground_truth": "g2", "contexts": ["x", "y"]}]


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    (tmp_path / "d.json").write_text(json.dumps({"data": ROWS}))
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, ROWS)) + "\n")
    (tmp_path / "a.csv").write_text('question,answer,ground_truth,contexts\nq1,a1,g1,"[""x""]"\nq2,a2,,plain\n')
    for name in ("a.json", "d.json", "a.jsonl"):
        got = loaders.load_dataset(spark, str(tmp_path / name)).orderBy("sample_index").collect()
        assert [r["question"] for r in got] == ["q1", "q2"] and got[1]["contexts"] == ["x", "y"] and [r["sample_index"] for r in got] == [0, 1]
    got = loaders.load_dataset(spark, str(tmp_path / "a.csv")).orderBy("sample_index").collect()
    assert got[0]["contexts"] == ["x"] and got[1]["contexts"] == ["plain"] and got[1]["ground_truth"] == ""
    s = loaders.statistics(loaders.load_dataset(spark, str(tmp_path / "a.json"))).first()
    assert s["num_samples"] == 2 and s["avg_contexts_per_sample"] == 1.5 and s["missing_answers"] == 0
    with pytest.raises(ValueError):
        loaders.load_dataset(spark, "x.json", "xml")
    with pytest.raises(ValueError):
        loaders.canonical(spark.createDataFrame([(1,)], "a int"))


def test_mapping(spark):
    df = loaders.map_columns(spark.createDataFrame([("x", "old")], "q string, question string"), {"q": "question", "absent": "answer"})
    assert df.columns == ["question"] and df.first()[0] == "x"


def test_canonical_samples(spark):
    ddl = "sample_index long, question string, answer string, ground_truth string, contexts array<string>, ingested_at string, clash string"
    got = canonical.samples(spark.createDataFrame([(1, None, None, None, None, "1", "a"), (1, "q", "a", None, ["c"], "2", "b"), (None, "z", "z", "z", [], "3", "c")], ddl)).collect()
    assert len(got) == 1 and got[0]["question"] == "q" and got[0]["ground_truth"] == "" and got[0]["clash"] == "b"
    assert canonical.samples(spark.createDataFrame([], ddl)).count() == 0


def test_adapters(spark):
    h = adapters.load("HotpotQA", spark.createDataFrame([("q", "a", (["Math", "extra"], [["2+2", " is 4."]]), "easy", "bridge")], "question string, answer string, context struct<title: array<string>, sentences: array<array<string>>>, level string, type string"))
    assert h.first()["contexts"] == ["Title: Math\n2+2 is 4."]
    assert adapters.load("nq", spark.createDataFrame([("q", ["x", "y"]), ("r", [])], "question string, answer array<string>"), 1).first()["ground_truth"] == "x"
    t = adapters.load("triviaqa", spark.createDataFrame([("q", ("v", ["w"]), (["", "c"],))], "question string, answer struct<value: string, aliases: array<string>>, search_results struct<search_context: array<string>>")).first()
    assert t["ground_truth"] == "v" and t["contexts"] == ["c"]
    sq = adapters.load("squad2", spark.createDataFrame([("n", ([],), "c"), ("q", (["a"],), "c")], "question string, answers struct<text: array<string>>, context string"), 1).collect()
    assert len(sq) == 1 and sq[0]["question"] == "q"
    r = adapters.load("rgb", spark.createDataFrame([("q", "a", [("d1",)], 7)], "query string, answer string, docs array<struct<text: string>>, extra int")).first()
    assert r["contexts"] == ["d1"] and json.loads(r["metadata"]) == {"extra": 7}
    assert adapters.load("recall", spark.createDataFrame([("q", "g", "c")], "question string, ground_truth string, context string")).first()["contexts"] == ["c"]
    with pytest.raises(ValueError):
        adapters.get_adapter("other")


def test_dialogues(spark):
    conv = "Teacher: (generic)Hi, walk me through it please.|EOM|Student: I did 2+2.|EOM|noise|EOM|Teacher: (Probing) Why did you add these two numbers?|EOM|Teacher: short|EOM||EOM|Teacher: no move but a long enough turn"
    df = spark.createDataFrame([("7", "P", "S", "W", None, conv), (None, None, None, None, "x", None)], "qid string, question string, ground_truth string, student_incorrect_solution string, self_correctness string, conversation string")
    got = dialogues.dialogue_samples(df).orderBy("turn_index").collect()
    assert [(r["conversation_id"], r["question"], r["move_score"]) for r in got] == [("mathdial-7-t0", "P", 0.5), ("mathdial-7-t2", "Teacher: Hi, walk me through it please.\nStudent: I did 2+2.", 1.0)]
    assert got[0]["self_correctness"] == "N/A" and got[0]["total_turns"] == 5


def test_responses(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"conversation_id": "c", "conversation_history": "Tutor: Hi. The question is: 2+2? \\n Student: 5", "tutor_responses": {"b": {"response": "r", "annotation": {"Providing_Guidance": "Yes", "Actionability": "To some extent"}}, "a": {"response": "s", "annotation": {}}}}]))
    got = dialogues.read_responses(spark, str(tmp_path / "m.json")).orderBy("position").collect()
    assert [(r["model_name"], r["combined_score"], r["contexts"]) for r in got] == [("b", 0.8, ["2+2?"]), ("a", 0.0, ["2+2?"])]


def test_chunking(spark):
    enc = vectors.hashing_encoder
    assert chunking.chunk_text("", enc) == [] and chunking.chunk_text("short", enc) == ["short"]
    assert len(chunking.py_sentences("Hello world. This is a test! Is it working? Mr. Smith says yes. Yes, he does.")) == 5
    text = " ".join(f"Sentence number {i} speaks about topic {i // 9} in many words." for i in range(90))
    got = chunking.chunk_text(text, enc)
    assert len(got) > 2 and max(map(len, got)) <= 1700 and got[0].startswith("Sentence number 0")

    def broken(texts):
        raise RuntimeError

    assert chunking.chunk_text("A" * 2000, broken) == ["A" * 2000] or len(chunking.chunk_text("A" * 2000, broken)) == 3
    assert len(chunking.chunk_text(text, broken)) == -(-len(text) // 800)


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("A", 0, "faithfulness", 0.9, "Good"), ("A", 1, "faithfulness", 0.5, "<b>"), ("B", 0, "relevance", 0.7, None)], "run_id string, sample_index long, metric_name string, score double, reason string")
    w = sinks.csv_wide(r.where("run_id = 'A'")).orderBy("Sample_Index").collect()
    assert w[0].asDict() == {"Sample_Index": 0, "faithfulness_Score": "0.9", "faithfulness_Reason": "Good"}
    assert "mean 0.700" in sinks.console(r.where("run_id = 'A'"))
    page = sinks.to_html(r)
    assert "&lt;b&gt;" in page and "<b>" not in page
    assert "0.9000" not in sinks.to_html_comparative(r, ["B"]) and "color:red" in sinks.to_html_comparative(r, ["A", "B"])
    sinks.write_json(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "results")).count() == 3


def test_splits_and_limits_of_benchmarks(spark, tmp_path):
    from gradeloom.sources import adapters

    def hub(spark, path, split):
        if split != "train":
            raise ValueError("no such split")
        return spark.createDataFrame([(i, f"q{i}", "a", "c") for i in range(5)], "seq int, question string, ground_truth string, context string")

    assert adapters.load_split(spark, "recall", "some/set", max_samples=3, reader=hub).count() == 3
    with pytest.raises(ValueError):
        adapters.load_split(spark, "rgb", "some/set", reader=hub)
    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"query": f"q{i}", "answer": "a"}) + "\n" for i in range(4)))
    assert [r["question"] for r in adapters.load_split(spark, "rgb", str(tmp_path / "r.jsonl"), max_samples=2).orderBy("seq").collect()] == ["q0", "q1"]


def test_reports_come_back(spark, tmp_path):
    r = spark.createDataFrame([(i, "faithfulness", i / 40, f"r{i} <i>") for i in range(25)], "sample_index long, metric_name string, score double, reason string")
    rows = sorted(map(tuple, r.collect()))
    sinks.write_report(r, str(tmp_path / "report.json"), {"a": 1}, {"total_input_tokens": 7})
    doc = json.load(open(tmp_path / "report.json"))
    assert doc["report"]["summary"] == {"faithfulness": 0.3, "total_input_tokens": 7} and len(doc["report"]["results"]) == 25
    sinks.write_json(r, str(tmp_path / "folder"))
    for saved in ("report.json", "folder"):
        got = loaders.read_report(spark, str(tmp_path / saved))
        assert sorted(map(tuple, got.select("sample_index", "metric_name", "score", "reason").collect())) == rows
        assert sorted(x["seq"] for x in got.collect()) == list(range(25))
    (tmp_path / "other.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        loaders.read_report(spark, str(tmp_path / "other.json"))
    sinks.write_report(r.where("false"), str(tmp_path / "none.json"))
    assert loaders.read_report(spark, str(tmp_path / "none.json")).count() == 0
    assert sinks.write_html(r, str(tmp_path / "report.html"), page_rows=10) == 3
    pages = [(tmp_path / n).read_text() for n in ("report.html", "report-2.html", "report-3.html")]
    assert all(sum(p.count(f"r{i} &lt;i&gt;") for p in pages) == 1 for i in range(25)) and "report-3.html" in pages[0]
    assert all(f"r{i} &lt;i&gt;" in sinks.to_html(r) for i in range(25))
    assert cli.main(["report", "-i", str(tmp_path / "report.json"), "-o", str(tmp_path / "again"), "-f", "json,html,csv"]) == 0
    assert loaders.read_report(spark, str(tmp_path / "again" / "report.json")).count() == 25


def test_evaluate_command(spark, tmp_path, capsys):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"question": f"q{i}", "answer": "a b", "ground_truth": "a b"}) + "\n" for i in range(5)))
    (tmp_path / "c.yaml").write_text("llm:\n  provider: azure\n  api_base: http://x\n  unknown: 1\nmetrics: [exact_match]\nmore: 2\n")
    assert cli.main(["evaluate", "-d", str(tmp_path / "d.jsonl"), "-c", str(tmp_path / "c.yaml"), "--reasoning-effort", "low", "--max-concurrency", "7", "--dry-run"]) == 0
    shown = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert shown["llm"]["reasoning_effort"] == "low" and shown["max_concurrency"] == 7 and shown["llm"]["api_base"] == "http://x" and shown["llm"]["max_tokens"] == 1024
    assert cli.main(["evaluate", "-d", str(tmp_path / "d.jsonl"), "-m", "exact_match,token_f1", "-o", str(tmp_path / "out"), "-f", "json,console"]) == 0
    assert loaders.read_report(spark, str(tmp_path / "out" / "report.json")).count() == 10
    assert loaders.load_dataset(spark, str(tmp_path / "d.jsonl"), limit=2).count() == 2


def test_study_command(spark, tmp_path, monkeypatch):
    from gradeloom import providers

    replies = '{"claims": [{"supported": true}], "state": "A", "confidence": 1, "score": 1, "reason": "r"}'
    monkeypatch.setattr(providers, "get_judge", lambda c: lambda system, prompt: replies)
    talk = "Teacher: (probing)What could you try first here?|EOM|Student: I do not know.|EOM|Teacher: (telling)The answer to the question is twelve."
    rows = [{"qid": f"{i}", "question": "q", "ground_truth": "g", "student_incorrect_solution": "s", "self-correctness": "Yes", "conversation": talk} for i in range(4)]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = str(tmp_path / "study")
    assert cli.main(["study-dialogues", "-d", str(tmp_path / "m.jsonl"), "-o", out, "--limit", "5"]) == 0
    assert spark.read.parquet(out + "/frame").count() == 5
    assert cli.main(["study-dialogues", "-d", str(tmp_path / "m.jsonl"), "-o", out, "--append"]) == 0
    assert spark.read.parquet(out + "/frame").count() == 8
    assert cli.main(["study-dialogues", "-d", str(tmp_path / "m.jsonl"), "-o", out, "--analyse-only"]) == 0
    assert json.load(open(out + "/statistics.json"))["spearman"]["move_score"]["n"] == 8


def test_registry_discovery_and_injection(spark, tmp_path, monkeypatch):
    from gradeloom.registry import Registry, install
    from pyspark.sql import functions as F

    (tmp_path / "mypack").mkdir()
    (tmp_path / "mypack" / "__init__.py").write_text("")
    (tmp_path / "mypack" / "good.py").write_text("from pyspark.sql import functions as F\ndef install_metrics(r):\n    r.register('length', lambda: F.struct(F.lit(1.0).alias('score'), F.lit('').alias('reason')))\n")
    (tmp_path / "mypack" / "bad.py").write_text("raise RuntimeError\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    r = Registry()
    install(r)
    assert r.discover("mypack") == ["mypack.good"] and r.get("Length").name == "length"
    df = spark.createDataFrame([("Why does it work so well?", "a", ["c"])], "question string, answer string, contexts array<string>")
    assert df.select(r.create("uptake", scorer=lambda a, b: [0.75] * len(a), encoder=None).alias("m")).first()["m"]["score"] == 0.75
    with pytest.raises(ValueError):
        r.create("faithfulness")


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from gradeloom import session

    class Conf:
        def get(self, k, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_csv_of_all_runs(spark, tmp_path, monkeypatch):
    from gradeloom.operators import wide
    from gradeloom.plans import stream_queries

    monkeypatch.setattr(wide, "MAX_ATTRIBUTES", 2)
    at = "timestamp'2024-01-01'"
    rows = [(1, "run-00-00000", "m1", 0, 0.5), (2, "run-00-00001", "m1", 0, 0.25), (3, "run-00-00001", "m2", 1, 1.0)]
    df = spark.createDataFrame(rows, "result_id long, run_id string, metric_name string, sample_index long, score double").selectExpr("*", "'r' AS reason", "cast(null AS string) AS metadata", f"{at} AS scored_at", f"{at} AS ingested_at")
    df.write.parquet(str(tmp_path / "eval_results.parquet"))
    got = {(r["Run_Id"], r["Sample_Index"], r["m1_Score"], r["m2_Score"]) for r in stream_queries.csv_wide(spark, str(tmp_path)).collect()}
    assert got == {("run-00-00000", 0, "0.5", ""), ("run-00-00001", 0, "0.25", ""), ("run-00-00001", 1, "", "1.0")}
    more = df.withColumn("metric_name", df["result_id"].cast("string"))
    with pytest.raises(ValueError):
        sinks.csv_wide(more)


def test_config_and_cli(tmp_path, capsys):
    with pytest.raises(ValueError):
        config.LLMConfig(provider="x")
    with pytest.raises(ValueError):
        config.LLMConfig(temperature=3)
    p = tmp_path / "c.yaml"
    p.write_text("llm:\n  provider: openai\n  model: gpt-4o\nmetrics: [token_f1]\n")
    c = config.EvalConfig.from_yaml(str(p))
    assert c.llm.model == "gpt-4o" and c.metrics == ["token_f1"] and config.EvalConfig.from_dict({}).batch_size == 10
    assert cli.main(["metrics"]) == 0 and "token_f1\tstandalone" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["report", "-i", "nowhere.json"])
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "-d", str(p), "-f", "pdf"])
