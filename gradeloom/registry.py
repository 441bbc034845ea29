"""Metrics by name. A metric is a function from a canonical sample's columns to a struct (score, reason, ...)."""

from __future__ import annotations

import importlib
import logging
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Metric:
    """``needs``: standalone, embedding, classifier or judge; ``takes``: what its column function can be given."""

    name: str
    needs: str
    column: Callable[..., Column] | None
    takes: tuple[str, ...] = ()


def _key(name: str) -> str:
    return re.sub(r"[-_ ]", "", name.strip().lower())


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Metric] = {}

    def register(self, name: str, column: Callable[..., Column] | None, needs: str = "standalone", takes: tuple[str, ...] = ()) -> None:
        """A later registration of a name replaces an earlier one."""
        self._known[_key(name)] = Metric(name, needs, column, takes)

    def create(self, name: str, **injected: object) -> Column:
        """The metric's column, with those of the injected encoders, scorers and the like that it takes."""
        m = self.get(name)
        if m.column is None:
            raise ValueError(f"{m.name} is scored by a judge, not by a column")
        return m.column(**{k: v for k, v in injected.items() if k in m.takes})

    def discover(self, package: str) -> list[str]:
        """Modules of ``package`` that were given the registry: each with a function ``install_metrics(registry)``.

        A module that fails to load is left out with a warning.
        """
        found = []
        for m in pkgutil.iter_modules(importlib.import_module(package).__path__, package + "."):
            try:
                module = importlib.import_module(m.name)
                if hasattr(module, "install_metrics"):
                    module.install_metrics(self)
                    found.append(m.name)
            except Exception:  # one broken module must not hide the others
                log.warning("metrics of %s could not be loaded", m.name, exc_info=True)
        return found

    def get(self, name: str) -> Metric:
        m = self._known.get(_key(name))
        if m is None:
            raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(x.name for x in self._known.values()))}")
        return m

    def all(self) -> list[Metric]:
        return sorted(self._known.values(), key=lambda m: m.name)

    def reset(self) -> None:
        self._known.clear()
        install(self)


def install(r: Registry) -> None:
    from gradeloom.operators import judges, lexical, tutoring, vectors

    a, t = (lambda: F.col("answer")), (lambda: F.col("ground_truth"))
    r.register("exact_match", lambda: lexical.exact_match(a(), t()))
    r.register("token_f1", lambda: lexical.token_f1(a(), t()))
    for n in (1, 2, 3, 4):
        r.register(f"bleu-{n}", lambda n=n: lexical.bleu(a(), t(), n))
    for v in ("rouge1", "rouge2", "rougeL"):
        r.register(v, lambda v=v: lexical.rouge(a(), t(), v))
    r.register("semantic_similarity", lambda **k: vectors.semantic_similarity(a(), t(), **k), "embedding", ("encoder",))
    r.register("bert_score", lambda **k: vectors.bert_score(a(), t(), **k), "embedding", ("encoder",))
    r.register("uptake", lambda **k: tutoring.uptake(F.col("question"), a(), F.col("contexts"), **k), "classifier", ("scorer", "stop"))
    r.register("linguistic_adaptation", lambda **k: tutoring.linguistic_adaptation(a(), **k), "classifier", ("sentiment", "lemmas"))
    for m in (*judges.SCORES, "no_immediate_disclosure", "pes"):
        r.register(m, None, "judge")


REGISTRY = Registry()
install(REGISTRY)
