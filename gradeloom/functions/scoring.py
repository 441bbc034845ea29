"""Numeric functions: vectors, clamps, costs, keys, judge values and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import let

EPSILON = 1e-6
# Weights of uptake, language and disclosure per dialogue state.
STATE_WEIGHTS = {"A": (0.35, 0.35, 0.30), "B": (0.00, 0.30, 0.70), "C": (0.00, 0.25, 0.75)}
OTHER_WEIGHTS = (0.33, 0.33, 0.34)
# Price per million input and output tokens in USD; models not listed are free.
PRICES = {
    "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4.1": (2.00, 8.00), "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40), "o3": (2.00, 8.00), "o3-mini": (1.10, 4.40), "o4-mini": (1.10, 4.40),
    "gpt-5-nano": (0.05, 0.20), "claude-sonnet-4-20250514": (3.00, 15.00), "claude-opus-4-20250514": (15.00, 75.00),
    "claude-3-5-haiku-20241022": (0.80, 4.00), "gemini-2.5-pro": (1.25, 10.00), "gemini-2.5-flash": (0.15, 0.60),
    "gemini-2.0-flash": (0.10, 0.40), "llama3.2": (0.0, 0.0), "llama3.1": (0.0, 0.0), "mistral": (0.0, 0.0),
    "phi3": (0.0, 0.0), "qwen2": (0.0, 0.0),
}
FREE_PROVIDERS = ("ollama", "vllm")


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Within lo..hi; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; 0 where a norm is 0, an error for unequal lengths."""
    dbl = lambda v: F.transform(v, lambda x: x.cast("double"))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    pair = F.struct(dbl(a).alias("a"), dbl(b).alias("b"))

    def body(p: Column) -> Column:
        dot = add(F.zip_with(p["a"], p["b"], lambda x, y: x * y))
        norms = F.sqrt(add(F.transform(p["a"], lambda x: x * x))) * F.sqrt(add(F.transform(p["b"], lambda x: x * x)))
        value = F.coalesce(F.try_divide(dot, F.nullif(norms, F.lit(0.0))), F.lit(0.0))
        return F.when(F.size(p["a"]) == F.size(p["b"]), value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))

    return F.when(a.isNotNull() & b.isNotNull(), let(pair, body))


def cache_key(model: Column, system: Column, prompt: Column) -> Column:
    t = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(t(model), F.lit("::"), t(system), F.lit("::"), t(prompt)), 256)


def cost(model: Column, input_tokens: Column, output_tokens: Column, provider: Column | None = None) -> Column:
    """Estimated cost in USD; unknown models and local providers cost nothing."""
    pin = pout = F.lit(0.0)
    for m, (i, o) in PRICES.items():
        pin, pout = F.when(model == m, F.lit(i)).otherwise(pin), F.when(model == m, F.lit(o)).otherwise(pout)
    out = F.coalesce(input_tokens, F.lit(0)) / 1e6 * pin + F.coalesce(output_tokens, F.lit(0)) / 1e6 * pout
    return out if provider is None else F.when(provider.isin(*FREE_PROVIDERS), 0.0).otherwise(out)


def state_letter(c: Column) -> Column:
    """The first A, B or C of the trimmed upper-case text, else empty."""
    return F.regexp_extract(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[ABC]", 0)


def state_weights(state: Column) -> Column:
    """(w1, w2, w3) per state."""
    row = lambda w: F.struct(*[F.lit(x).alias(n) for x, n in zip(w, ("w1", "w2", "w3"))])
    out = row(OTHER_WEIGHTS)
    for s, w in STATE_WEIGHTS.items():
        out = F.when(state == s, row(w)).otherwise(out)
    return out


def geometric_mean(m: tuple[Column, Column, Column], w: tuple[Column, Column, Column], upper: bool = True) -> Column:
    """Weighted geometric mean of values clamped to EPSILON..1 (only from below with ``upper=False``); 0 without weight."""
    lift = lambda x: F.greatest(F.lit(EPSILON), F.least(F.lit(1.0), x) if upper else x)
    total = w[0] + w[1] + w[2]
    logs = sum((wi * F.ln(lift(mi)) for wi, mi in zip(w, m)), F.lit(0.0))
    return F.coalesce(F.exp(F.try_divide(logs, F.nullif(total, F.lit(0.0)))), F.lit(0.0))


def composite(m1: Column, m2: Column, m3: Column, state: Column, faithfulness: Column | None = None, threshold: float = 0.5) -> Column:
    """(score, gate_failed, score_before_gate): below the faithfulness threshold the score is 0; null without a gate
    counts as passed."""
    w = state_weights(state)
    raw = clamp(F.round(geometric_mean((m1, m2, m3), (w["w1"], w["w2"], w["w3"])), 4))
    failed = F.coalesce(faithfulness < threshold, F.lit(False)) if faithfulness is not None else F.lit(False)
    return F.struct(F.when(failed, 0.0).otherwise(raw).alias("score"), failed.alias("gate_failed"), raw.alias("score_before_gate"))


def truthy(v: Column) -> Column:
    """Python's truth of a VARIANT: any non-empty text is true (``"false"`` too), zero and null are false."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
        .when(kind.isin("VOID"), F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def number(v: Column, path: str, default: float) -> Column:
    """A number or a text that reads as one, else ``default`` (also where the key is absent)."""
    as_text = F.try_variant_get(v, path, "string")
    return F.coalesce(as_text.try_cast("double"), F.lit(default))


def whole_number(v: Column, path: str, default: int) -> Column:
    """Numbers are cut to whole ones; texts must be whole numbers as written, else ``default``."""
    sub = F.try_variant_get(v, path, "variant")
    text = F.schema_of_variant(sub) == "STRING"
    as_text = F.try_variant_get(v, path, "string")
    whole = F.when(F.trim(as_text).rlike(r"^[+-]?\d+$"), as_text.try_cast("int"))
    cut = as_text.try_cast("double")
    return F.coalesce(F.when(text, whole).otherwise(F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)).cast("int")), F.lit(default))


def pairwise_cosine(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of the vectors of two tables paired by ``key``."""
    r = right.select(key, F.col(vector).alias("__other"))
    return left.join(r, key).select(key, cosine(F.col(vector), F.col("__other")).alias("similarity"))
