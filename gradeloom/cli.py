"""Command line: evaluate, generate, report, metrics, and the two tutoring studies."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from dataclasses import asdict, replace

from gradeloom import __version__
from gradeloom.config import EFFORTS, EvalConfig, LLMConfig
from gradeloom.session import cut, get_spark, ship

FORMATS = ("json", "html", "csv", "console")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gradeloom")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true", help="wins over --verbose")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("-d", "--dataset", required=True)
    e.add_argument("-c", "--config")
    e.add_argument("-o", "--output", default="output")
    e.add_argument("-m", "--metrics", default="")
    e.add_argument("-f", "--format", default=",".join(FORMATS))
    e.add_argument("-p", "--provider")
    e.add_argument("--model")
    e.add_argument("--reasoning-effort", choices=EFFORTS)
    e.add_argument("--max-concurrency", type=int, help="judge calls in flight; default: the configuration's")
    e.add_argument("--dry-run", action="store_true")
    g = sub.add_parser("generate")
    g.add_argument("-d", "--documents", required=True)
    g.add_argument("-o", "--output", default="synthetic")
    g.add_argument("-n", "--num-samples", type=int, default=1)
    g.add_argument("-q", "--question-types", default="factual")
    g.add_argument("--difficulty", default="medium")
    g.add_argument("-p", "--provider", default="ollama")
    g.add_argument("-m", "--model", default="qwen2.5:7b")
    g.add_argument("--max-chunks", type=int, default=10, help="0: all")
    g.add_argument("--max-concurrency", type=int, default=3)
    r = sub.add_parser("report")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output-dir", default="output_regenerated")
    r.add_argument("-f", "--format", default="html,csv,console")
    sub.add_parser("metrics")
    for corpus in ("study-dialogues", "study-responses"):
        t = sub.add_parser(corpus, help="score a tutoring corpus and validate the scores against its annotations")
        t.add_argument("-d", "--data", required=True)
        t.add_argument("-o", "--output", default=corpus)
        t.add_argument("-c", "--config")
        t.add_argument("-p", "--provider")
        t.add_argument("--model")
        t.add_argument("--limit", type=int)
        t.add_argument("--offset", type=int, default=0)
        t.add_argument("--append", action="store_true", help="continue the frame in the output folder")
        t.add_argument("--no-gate", action="store_true", help="leave out faithfulness")
        t.add_argument("--analyse-only", action="store_true", help="validate the frame in the output folder")
        t.add_argument("--max-concurrency", type=int)
    return p


def _formats(text: str) -> list[str]:
    out = [f.strip() for f in text.split(",") if f.strip()]
    if bad := [f for f in out if f not in FORMATS]:
        sys.exit(f"unknown format: {', '.join(bad)}")
    return out


def _write(results, out: str, formats: list[str], config: dict | None = None, totals: dict | None = None) -> None:  # type: ignore[no-untyped-def]
    from gradeloom.sources import sinks

    os.makedirs(out, exist_ok=True)
    if "json" in formats:
        sinks.write_report(results, f"{out}/report.json", config, totals)
    if "csv" in formats:
        sinks.write_csv(results, f"{out}/csv")
    if "html" in formats:
        sinks.write_html(results, f"{out}/report.html")
    if "console" in formats:
        print(sinks.console(results, totals))


def _settings(a: argparse.Namespace) -> EvalConfig:
    """The configuration file with what the command line overrides."""
    config = EvalConfig.from_yaml(a.config) if a.config else EvalConfig()
    over = {k: v for k, v in (("provider", a.provider), ("model", a.model), ("reasoning_effort", getattr(a, "reasoning_effort", None))) if v}
    config.llm = replace(config.llm, **over)
    if a.max_concurrency:
        config.max_concurrency = a.max_concurrency
    return config


def _study(a: argparse.Namespace, spark) -> int:  # type: ignore[no-untyped-def]
    from gradeloom.operators import study
    from gradeloom.operators import usage
    from gradeloom.providers import get_judge, json_only
    from gradeloom.sources import dialogues, sinks

    target = f"{a.output}/frame"
    dialogue = a.command == "study-dialogues"
    if dialogue:
        annotated = dialogues.dialogue_samples(dialogues.read_dialogues(spark, a.data))
        keep, label, truth, order = ["conversation_id", "qid", "teacher_move", "move_score", "self_correctness", "turn_index"], "teacher_move", "move_score", study.MOVES
    else:
        annotated = dialogues.read_responses(spark, a.data)
        keep, label, truth, order = ["conversation_id", "model_name", "providing_guidance_label", "actionability_label", "providing_guidance", "actionability", "combined_score"], "providing_guidance_label", "combined_score", study.LABELS
    earlier = spark.read.parquet(target) if (a.append or a.analyse_only) and os.path.exists(target) else None
    if a.analyse_only:
        if earlier is None:
            sys.exit(f"no frame in {target}")
        frame = earlier
    else:
        c = _settings(a)
        cache = usage.alive(usage.load(spark, c.cache.directory), time.time(), c.cache.ttl_seconds) if c.cache.enabled else usage.empty(spark)
        frame = study.run(annotated, json_only(get_judge(c.llm)), c.llm.model, cache, keep, earlier, a.offset, a.limit, None if a.no_gate else study.GATE, at_once=c.max_concurrency, attempts=max(1, c.llm.max_retries))
        frame.write.mode("overwrite").parquet(target)  # ``run`` returns a finished frame
    found = study.validation(frame, "pes_score", label, truth, order)
    with open(f"{a.output}/statistics.json", "w", encoding="utf-8") as f:
        f.write(sinks.stats_json(found))
    for r in study.ranking(frame, label if dialogue else "model_name", "pes_score").collect():
        print(f"{r[0]}: mean {r['mean_score']:.4f} of {r['n']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    from gradeloom.registry import REGISTRY

    if a.command == "metrics":
        for m in REGISTRY.all():
            print(f"{m.name}\t{m.needs}")
        return 0
    formats = _formats(a.format) if a.command in ("evaluate", "report") else []
    path = {"evaluate": "dataset", "generate": "documents", "report": "input"}.get(a.command, "data")
    if not os.path.exists(getattr(a, path)):
        sys.exit(f"no such file: {getattr(a, path)}")
    from gradeloom.sources import loaders

    spark = ship(get_spark())
    if a.command.startswith("study-"):
        return _study(a, spark)
    if a.command == "report":
        try:
            rows = loaders.read_report(spark, a.input)
        except ValueError as e:
            sys.exit(str(e))
        _write(rows, a.output_dir, formats)
        return 0
    if a.command == "generate":
        from gradeloom.functions.chunking import chunks
        from gradeloom.operators import synthetic, vectors
        from gradeloom.providers import get_judge, json_only
        from pyspark.sql import functions as F

        docs = loaders.read_documents(spark, a.documents)
        c = docs.select(F.explode(chunks(F.col("text"), vectors.hashing_encoder)).alias("chunk"))
        c = c if a.max_chunks == 0 else c.orderBy(F.xxhash64("chunk")).limit(a.max_chunks)
        judge = get_judge(LLMConfig(provider=a.provider, model=a.model))
        synthetic.generate(c, json_only(judge), [t.strip() for t in a.question_types.split(",")], a.difficulty, a.num_samples, answerer=judge, at_once=a.max_concurrency).write.mode("overwrite").json(a.output)
        return 0
    config = _settings(a)
    metrics = [m.strip() for m in a.metrics.split(",") if m.strip()] or config.metrics
    for m in metrics:
        REGISTRY.get(m)
    samples = loaders.load_dataset(spark, a.dataset)
    loaders.validate(samples)
    if a.dry_run:
        shown = asdict(config)
        shown["llm"]["api_key"] = "set" if config.llm.key() else ""
        print(f"{samples.count()} samples, metrics: {', '.join(metrics)}")
        print(json.dumps(shown))
        return 0
    from gradeloom.evaluator import evaluate
    from gradeloom.operators import usage
    from gradeloom.providers import get_judge, json_only

    judge, totals = None, {}
    if any(REGISTRY.get(m).needs == "judge" for m in metrics):
        judge = json_only(get_judge(config.llm))
    store = {"cache_path": config.cache.directory, "ttl": config.cache.ttl_seconds} if config.cache.enabled else {}
    count = lambda answers: totals.update(usage.totals(usage.priced(answers, config.llm.model, config.llm.provider)))
    got = cut(evaluate(samples, metrics, judge=judge, model=config.llm.model, on_answers=count, at_once=config.max_concurrency, attempts=max(1, config.llm.max_retries), **store))
    shown = asdict(config) | {"metrics": metrics}
    shown["llm"].pop("api_key")
    _write(got, a.output, formats, shown, totals)
    return 0


if __name__ == "__main__":
    sys.exit(main())
