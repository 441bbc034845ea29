"""Reports: JSON, CSV, HTML and console. Aggregates are DataFrames; only report-sized rows reach the driver."""

from __future__ import annotations

import html
import json
import os
from datetime import datetime, timezone
from itertools import islice
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom import __version__
from gradeloom.operators import results as R
from gradeloom.operators import statistics as S
from gradeloom.operators import wide

#: Samples on one page of an HTML report.
PAGE_ROWS = 1000


def _head(results: DataFrame, config: dict | None, totals: dict | None) -> tuple[dict, dict]:
    summary = {r["metric_name"]: r["mean_score"] for r in R.mean_scores(results).orderBy("metric_name").collect()}
    return {"timestamp": datetime.now(timezone.utc).isoformat(), "framework_version": __version__}, {"config": config or {}, "summary": summary | (totals or {})}


def write_json(results: DataFrame, path: str, config: dict | None = None, totals: dict | None = None) -> None:
    """All rows as JSON lines in ``path``/results, and the header with the summary in ``path``/report.

    ``loaders.read_report`` reads the folder. ``totals``: what to add to the summary (tokens and costs).
    """
    results.write.mode("overwrite").json(f"{path}/results")
    metadata, report = _head(results, config, totals)
    head = json.dumps({"metadata": metadata, "report": report}, ensure_ascii=False)
    results.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_report(results: DataFrame, path: str, config: dict | None = None, totals: dict | None = None) -> None:
    """One JSON document ``{"metadata": ..., "report": {"config", "summary", "results"}}`` in a local file.

    The rows stream through the driver one partition at a time; for large results use ``write_json``.
    """
    metadata, report = _head(results, config, totals)
    rows = results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"metadata": ' + json.dumps(metadata) + ', "report": ' + json.dumps(report, ensure_ascii=False)[:-1] + ', "results": [')
        for i, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if i else "\n") + r[0])
        f.write("]}}\n")


def csv_wide(results: DataFrame, keys: tuple[str, ...] = ("sample_index",)) -> DataFrame:
    """The keys (Sample_Index; with ``run_id`` also Run_Id) and, per metric in order, ``<metric>_Score`` and ``<metric>_Reason``; the last delivery of a cell
    wins (by ``seq`` where there is one, then by score and reason); missing cells are empty. More than MAX_ATTRIBUTES
    metrics are an error."""
    row = F.struct(F.col("score").cast("string").alias("Score"), F.coalesce("reason", F.lit("")).alias("Reason"))
    order = F.struct(*([F.col("seq")] if "seq" in results.columns else []), F.col("score"), F.coalesce("reason", F.lit("")))
    cells = results.groupBy(*keys, F.col("metric_name").alias("attribute")).agg(F.max_by(row, order).alias("c"))
    got = wide.to_wide(cells.select(*keys, "attribute", "c.*"), list(keys), ["Score", "Reason"])
    return got.withColumnsRenamed({k: k.title() for k in keys}).na.fill("")


def write_csv(results: DataFrame, path: str) -> None:
    csv_wide(results).orderBy("Sample_Index").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def console(results: DataFrame, totals: dict | None = None) -> str:
    """Statistics and a sparkline per metric, the best and worst samples, and the totals of tokens and costs."""
    stats = {r["metric_name"]: r for r in R.summary(results).collect()}
    lines = {r["metric_name"]: r["sparkline"] for r in R.sparkline(R.histogram(results)).collect()}
    ends = {r["metric_name"]: r for r in R.extremes(results, order=["sample_index"]).collect()}
    out = []
    for m in sorted(stats):
        s, e = stats[m], ends[m]
        out.append(f"{m}: mean {s['mean']:.3f}  median {s['median']:.3f}  stdev {s['stdev']:.3f}  min {s['min']:.3f}  max {s['max']:.3f}  {lines[m]}")
        out.append(f"  best sample {e['best_sample_index']} ({e['best_score']:.3f}), worst sample {e['worst_sample_index']} ({e['worst_score']:.3f})")
    if totals:
        out.append(f"tokens in {totals['total_input_tokens']}, out {totals['total_output_tokens']}, estimated cost ${totals['total_estimated_cost']:.4f}")
    return "\n".join(out)


_PAGE = Template("""<!doctype html><html><head><meta charset="utf-8"><title>$title</title><style>body{font-family:sans-serif}td,th{padding:4px 8px;border-bottom:1px solid #ccc;text-align:left}</style></head>
<body><h1>$title</h1>$body</body></html>
""")


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in r) + "</tr>"
    return "<table>" + cells("th", head) + "".join(cells("td", r) for r in rows) + "</table>"


def _overview(results: DataFrame) -> str:
    means = sorted((r["metric_name"], r["mean_score"]) for r in R.mean_scores(results).collect())
    bins: dict[str, list[int]] = {}
    for r in R.histogram(results).collect():
        bins.setdefault(r["metric_name"], [0] * 10)[r["bin"]] = r["n"]
    return _table(["Metric", "Mean", "Distribution"], [[html.escape(m), f"{x:.4f}", " ".join(map(str, bins[m]))] for m, x in means])


def _samples(results: DataFrame) -> DataFrame:
    cell = F.struct("metric_name", "score", "reason")
    return results.groupBy("sample_index").agg(F.avg("score").alias("mean"), F.array_sort(F.collect_list(cell)).alias("cells")).orderBy("sample_index")


def _rows(rows: list) -> str:  # type: ignore[type-arg]
    show = lambda c: f"{html.escape(c['metric_name'])}: {c['score']:.4f} {html.escape(c['reason'] or '')}"
    return _table(["Sample", "Average", "Scores"], [[str(r["sample_index"]), f"{r['mean']:.4f}", "<br>".join(map(show, r["cells"]))] for r in rows])


def to_html(results: DataFrame, title: str = "Evaluation report") -> str:
    """One page: means, ten-bin distributions and every sample with its average; reasons are escaped."""
    return _PAGE.substitute(title=html.escape(title), body=_overview(results) + _rows(list(_samples(results).toLocalIterator())))


def write_html(results: DataFrame, path: str, title: str = "Evaluation report", page_rows: int = PAGE_ROWS) -> int:
    """The report as ``path`` and, for more than ``page_rows`` samples, numbered pages beside it; their number.

    Samples stream through the driver one partition at a time; every sample is on one of the pages.
    """
    stem, _, suffix = path.rpartition(".")
    rows = _samples(results).toLocalIterator()
    pages, links = 0, []
    first = ""
    while batch := list(islice(rows, page_rows)):
        pages += 1
        if pages == 1:
            first = _rows(batch)
            continue
        name = f"{stem}-{pages}.{suffix}"
        with open(name, "w", encoding="utf-8") as f:
            f.write(_PAGE.substitute(title=html.escape(f"{title}, page {pages}"), body=_rows(batch)))
        links.append(f'<a href="{html.escape(os.path.basename(name))}">{pages}</a>')
    more = f"<p>More samples: {' '.join(links)}</p>" if links else ""
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.substitute(title=html.escape(title), body=_overview(results) + more + first + more))
    return max(1, pages)


def to_html_comparative(results: DataFrame, configs: list[str]) -> str:
    """Means per metric and configuration (absent: 0) with their spread; below 0.05 green, else red."""
    rows = []
    for r in R.comparative(results, configs).orderBy("metric_name").collect():
        colour = "green" if r["delta"] < 0.05 else "red"
        rows.append([html.escape(r["metric_name"]), *[f"{r[c]:.4f}" for c in configs], f'<span style="color:{colour}">{r["delta"]:.4f}</span>'])
    return _PAGE.substitute(title="Comparison", body=_table(["Metric", *map(html.escape, configs), "Delta"], rows))


def plot_data(frame: DataFrame, label: str, score: str) -> DataFrame:
    """What a box plot needs per label: quartiles, extremes, mean and count."""
    got = frame.groupBy(label).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.count(score).alias("n"))
    return R.with_quantiles(got, frame, [label], score, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(label, "q1", "median", "q3", "low", "high", "mean", "n")


def stats_json(validation: DataFrame) -> str:
    """The tests of ``study.validation`` as one JSON object: test, name, then statistic, p_value, n and stars."""
    out: dict[str, dict] = {}
    for r in validation.withColumn("stars", S.stars(F.col("p_value"))).orderBy("test", "name").collect():
        out.setdefault(r["test"], {})[r["name"]] = {k: r[k] for k in ("statistic", "p_value", "n", "stars")}
    return json.dumps(out, ensure_ascii=False, indent=1)
