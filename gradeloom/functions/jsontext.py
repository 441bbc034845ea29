"""JSON inside text: fenced, surrounded by prose, or plain."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import let, strip_fence


def balanced(c: Column) -> Column:
    """The text from its first { to the brace that closes it; null where there is none."""
    at = F.instr(c, "{")
    pieces = F.regexp_extract_all(F.substr(c, F.greatest(at, F.lit(1))), F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(x: Column, piece: Column) -> Column:
        depth = x["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        return F.when(x["done"], x).otherwise(F.struct(depth.alias("depth"), (x["size"] + F.length(piece)).alias("size"), (depth == 0).alias("done")))

    got = F.aggregate(pieces, start, step)
    return let(got, lambda x: F.when((at > 0) & x["done"], F.substr(c, F.greatest(at, F.lit(1)), x["size"])))


def payload(c: Column) -> Column:
    """The JSON of a text as VARIANT: the whole text without its fence, else its first balanced {...}; else null."""
    bare = strip_fence(c)
    return F.coalesce(F.try_parse_json(F.nullif(bare, F.lit(""))), F.try_parse_json(balanced(bare)))


def find_json(text: str | None) -> str | None:
    """Exact extraction: the whole text, else the first balanced {...}, else the first balanced [...]; null if none.

    Brackets inside strings count for the balance.
    """
    if text is None:
        return None
    try:
        json.loads(text.strip())
        return text.strip()
    except ValueError:
        pass
    for a, b in ("{}", "[]"):
        start = text.find(a)
        depth = 0
        for i in range(start, len(text)) if start >= 0 else ():
            depth += (text[i] == a) - (text[i] == b)
            if depth == 0:
                try:
                    json.loads(text[start : i + 1])
                    return text[start : i + 1]
                except ValueError:
                    break
    return None


@F.pandas_udf(T.StringType())  # type: ignore[call-overload]
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(find_json)
