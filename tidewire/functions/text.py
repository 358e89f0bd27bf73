"""Text functions as native column expressions; diffs and markup as Arrow functions."""

from __future__ import annotations

import difflib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import batches

#: Word, token, hashtag and sentence patterns.
WORD = r"(?U)\b[\w’'-]+\b"
TOKEN = r"[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё_-]{1,}"
HASHTAG = r"(?U)#(\w+)"
FIRST_SENTENCE = r"^\s*[^.!?\n]+[.!?]?"
DIFF_MAX_CHARS = 120_000


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def first_sentence(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, FIRST_SENTENCE, 0), r"^\s+|\s+$", "")), F.lit(""))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HASHTAG), F.lit(1)))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def clean_text(text: Column, limit: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.left(out, F.lit(limit)) if limit is not None else out


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def excerpt(given: Column, text: Column, limit: int = 160) -> Column:
    """The given excerpt, else the trimmed text cut at ``limit`` with an ellipsis."""
    t = F.trim(text)
    cut = F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("…"))).otherwise(t)
    return F.coalesce(F.nullif(given, F.lit("")), cut)


def like_pattern(term: str) -> str:
    """``%term%`` with LIKE's own wildcards neutralised."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ci(value: Column, term: str) -> Column:
    """Case-insensitive LIKE with the term taken literally."""
    return F.call_function("ilike", value, F.lit(like_pattern(term)))


def unfence_json(answer: Column) -> Column:
    """A model's JSON answer without its code fence, cut to the outer braces."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.regexp_extract(plain, r"(?s)\{.*\}", 0)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def _stripped(markup: str | None) -> str | None:
    if markup is None:
        return None
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return " ".join("".join(parser.found).split())


def strip_html(markup: Column) -> Column:
    batches.bound()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(_stripped)

    return run(markup)


def _diff(before: str | None, after: str | None, limit: int) -> str | None:
    lines = difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), fromfile="before", tofile="after", lineterm="", n=3)
    out = "\n".join(lines)
    return out if len(out) <= limit else None


def text_diff(before: Column, after: Column, limit: int = DIFF_MAX_CHARS) -> Column:
    """Unified diff with three lines of context; null where it is longer than ``limit``."""
    batches.bound()

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_diff(x, y, limit) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(before, after)
