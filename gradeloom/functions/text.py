"""Text functions as column expressions. Strings follow the data model: null counts as the empty string."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from string import Template

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
#: Unicode white space, written so that Java and RE2 read it alike.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Tokens before a full stop that do not end a sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "corp", "dept", "univ", "govt",
    "approx", "assn", "bros", "co", "no", "vol", "rev", "gen", "gov", "sgt", "cpl", "pvt", "capt", "lt", "cmdr", "adm",
    "maj", "col", "brig", "fig", "figs", "eq", "eqs", "al", "e", "i",
)
# Stops, and what may begin the next sentence behind them.
SENTENCE_STOPS, SENTENCE_STARTS = r"[.!?]", r"[A-Z\d\"'\(\[]"
SENTENCE_START = rf"(?<={SENTENCE_STOPS})\s+(?={SENTENCE_STARTS})"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas an expression would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(c: Column) -> Column:
    """Whitespace-separated tokens; none for empty and blank texts."""
    return F.filter(F.split(text(c), f"{SPACE}+"), lambda t: t != "")


def answer_tokens(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split at white space, articles dropped."""
    bare = F.translate(F.lower(text(c)), PUNCTUATION, "")
    return F.filter(F.split(bare, f"{SPACE}+"), lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalize_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def normalize_text(c: Column) -> Column:
    """Lower case, articles removed as whole words, white space collapsed; punctuation stays."""
    low = F.regexp_replace(F.lower(text(c)), r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(low, f"{SPACE}+", " "))


def count_tokens(c: Column) -> Column:
    """Rough number of model tokens: 1.3 per word, rounded down."""
    return F.floor(F.size(split_words(c)) * F.lit(1.3)).cast("int")


#: How the byte-level vocabularies of public models cut text before they merge bytes.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def exact_tokens(c: Column, ranks: str, pattern: str = BYTE_LEVEL) -> Column:
    """Number of tokens by a byte-level vocabulary: ``ranks`` is its file of merge ranks, which all executors see."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for s in it:
            yield s.map(lambda t: len(encoding.encode_ordinary(t or ""))).astype("int32")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.IntegerType())(text(c))


def sentences(c: Column) -> Column:
    """Sentences, split after ., ! or ? before white space; stripped, empty ones dropped."""
    marked = F.regexp_replace(text(c), rf"([.!?]){SPACE}+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


#: Claims are sentences.
claims = sentences


def strip_fence(c: Column) -> Column:
    """Without a leading line of ``` and a trailing one."""
    t = F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n?```$", "")


def words_unstopped(c: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-case tokens of letters and digits only, without stop words."""
    toks = F.filter(split_words(c), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    low = F.transform(toks, F.lower)
    return F.filter(low, lambda t: ~t.isin(*stop)) if stop else low


def word_overlap(source: Column, target: Column, stop: Sequence[str] = ()) -> Column:
    """Share of the source's tokens that occur in the target; 0 without source tokens."""
    pair = F.struct(words_unstopped(source, stop).alias("s"), words_unstopped(target, stop).alias("t"))
    return let(pair, lambda p: F.coalesce(F.try_divide(F.size(F.filter(p["s"], lambda w: F.array_contains(p["t"], w))), F.size(p["s"])), F.lit(0.0)))


def numbered(tokens: Column) -> Column:
    """Tokens with their occurrence number, so that set operations treat repeated tokens as a multiset."""
    return let(F.sort_array(tokens), lambda o: F.transform(o, lambda t, i: F.concat_ws("\u0001", t, (i - F.array_position(o, t)).cast("string"))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection; linear after sorting, by the hash-based array_intersect."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens


    def slide(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, slide)


def context_block(contexts: Column) -> Column:
    """Numbered contexts, one a line; empty without contexts."""
    lines = F.transform(contexts, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), text(c)))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def render(template: str, **values: Column) -> Column:
    """A ``$name``/``${name}`` template with columns filled in; unknown names stay, values are not expanded again."""
    out: list[Column] = []
    at = 0
    for m in Template.pattern.finditer(template):
        name = m.group("named") or m.group("braced")
        piece = text(values[name]) if name in values else F.lit("$" if m.group("escaped") is not None else m.group())
        out += [F.lit(template[at : m.start()]), piece]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fixed_chunks(c: Column, size: int = 800) -> Column:
    """Consecutive slices of ``size`` characters; none for an empty text."""
    n = F.length(text(c))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(text(c), i * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def chunk_sentences(c: Column) -> Column:
    """Sentences for chunking: per paragraph, split after ., ! or ? before an upper-case letter, digit, quote or bracket.

    A piece that ends in an abbreviation or in a number and full stop is joined to the next. Where nothing remains the
    lines are taken, else the whole text.
    """
    marked = F.regexp_replace(text(c), rf"({SENTENCE_STOPS}){SPACE}+({SENTENCE_STARTS})", "$1\u0001$2")
    marked = F.regexp_replace(marked, rf"({SENTENCE_STOPS}){SPACE}+({SENTENCE_STARTS})", "$1\u0001$2")  # neighbours that shared a character
    glued = rf"(?i)((?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(ABBREVIATIONS)})\.|\d\.)\u0001"
    paragraphs = F.split(marked, r"\n\s*\n")
    per = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, glued, "$1 "), "\u0001")))
    strip = lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")
    got = F.filter(F.transform(per, strip), lambda s: s != "")
    lines = F.filter(F.transform(F.split(text(c), "\n"), strip), lambda s: s != "")
    return F.when(F.size(got) > 0, got).when(F.size(lines) > 0, lines).otherwise(F.array(text(c)))


def clean_sentences(s: Column) -> Column:
    """Sentences of more than 10 characters or with an upper-case first letter."""
    return F.filter(s, lambda x: (F.length(x) > 10) | x.rlike(r"^\p{Lu}"))
