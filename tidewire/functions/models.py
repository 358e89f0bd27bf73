"""Model calls as pluggable column functions, with deterministic stand-ins.

The stand-ins are no inference: they make every stage runnable and repeatable
without a network. A real model comes in through :func:`model_function`.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions.scoring import l2_normalize
from tidewire.functions.text import first_sentence, tokens

SUMMARY_CHARS, EVENT_TOKENS, DIMENSIONS, CALL_ITEMS = 200, 4, 64, 64


def summary(text: Column) -> Column:
    return F.left(F.coalesce(first_sentence(text), F.lit("")), F.lit(SUMMARY_CHARS))


def has_primary_event(text: Column) -> Column:
    return F.size(tokens(text)) >= EVENT_TOKENS


def embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of hashed tokens at length 1; null where there is no token."""
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)) == i)).cast("float")
    )
    return F.transform(l2_normalize(counts), lambda x: x.cast("float"))


def grade(key: Column, most: int = 3) -> Column:
    """A bounded hash, in place of a judged impact or urgency."""
    return F.pmod(F.xxhash64(key), F.lit(most + 1)).cast("int")


def model_function(call: Callable[[list[str]], list], returns: str, items: int = CALL_ITEMS, tries: int = 1, wait: float = 0.0) -> Callable[[Column], Column]:
    """A column function that sends texts to ``call``, ``items`` at a time, in order.

    An answer of another length is an error. A call that fails ``tries`` times,
    waiting ``wait`` seconds longer after each, answers null for its texts.
    """

    def ask(texts: list[str]) -> list:
        for k in range(1, tries + 1):
            try:
                answers = call(texts)
            except Exception:  # the border to a service: a failed call is no answer, never a failed job
                time.sleep(wait * k)
                continue
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            return answers
        return [None] * len(texts)

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([a for at in range(0, len(texts), items) for a in ask(texts[at : at + items])], dtype=object)

    return run


class Indexed(tuple):
    """``Indexed((index, answer))``: an answer that says which input it belongs to."""


def ordered(answers: list, expected: int, what: str = "answer") -> list:
    """Answers in the order of the inputs: ``Indexed`` ones by their index, others (and those with index null) where they stand.

    Another number of answers, an index twice or out of range is an error.
    """
    placed: dict[int, object] = {}
    for at, answer in enumerate(answers):
        index, value = answer if isinstance(answer, Indexed) else (at, answer)
        k = at if index is None else index
        if k in placed or not 0 <= k < expected:
            raise ValueError(f"{what} {k} comes twice or was not asked for")
        placed[k] = value
    if len(placed) != expected:
        raise ValueError(f"{len(placed)} {what}s to {expected} inputs")
    return [placed[k] for k in range(expected)]


def in_order(answers: list[tuple[int | None, list[float]]], expected: int, dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Vectors of an indexed answer in the order of the texts; a vector of another length is an error too."""
    vectors = ordered([Indexed(a) for a in answers], expected, "vector")
    for vector in vectors:
        if len(vector) != dimensions:
            raise ValueError(f"a vector has {len(vector)} parts, not {dimensions}")
    return vectors


def embedding_function(call: Callable[[list[str]], list[tuple[int | None, list[float]]]], dimensions: int = DIMENSIONS, items: int = CALL_ITEMS, tries: int = 1, wait: float = 0.0) -> Callable[[Column], Column]:
    """A column of unit vectors from a service whose answers carry the index of their text. A vector of length zero fails its call."""

    def unit(texts: list[str]) -> list[list[float]]:
        vectors = in_order(call(texts), len(texts), dimensions)
        lengths = [math.hypot(*v) for v in vectors]
        if not all(lengths):
            raise ValueError("a vector has length zero")
        return [[x / n for x in v] for v, n in zip(vectors, lengths, strict=True)]

    return model_function(unit, "array<float>", items, tries, wait)


def answers(rows: DataFrame, inputs: list[str], call: Callable[[list[dict]], list], returns: str, items: int = CALL_ITEMS, tries: int = 1, wait: float = 0.0, at_once: int = 1, must: bool = False) -> DataFrame:
    """``rows`` with ``answer`` (of type ``returns``), ``failed`` and ``attempts``.

    ``call`` gets up to ``items`` rows' ``inputs`` as dictionaries and returns their
    answers in order, or ``Indexed`` in any order; another number, or a wrong index, is an
    error of the job. ``at_once`` calls of a task run side by side. A call that raises is
    repeated up to ``tries`` times, after waiting ``wait`` seconds, then twice that, and so
    on; in the end its rows have no answer and ``failed`` set, or (``must``) the job fails.
    """
    schema = T.StructType([*rows.schema.fields])
    kind = T._parse_datatype_string(returns)
    for name, of in (("answer", kind), ("failed", T.BooleanType()), ("attempts", T.IntegerType())):
        schema = schema.add(name, of)
    count = len(rows.columns)

    def ask(some: list[dict]) -> tuple[list, bool, int]:
        for k in range(1, tries + 1):
            try:
                got = call(some)
            except Exception:  # the border to a service
                if k == tries and must:
                    raise
                if k < tries:
                    time.sleep(wait * k)
                continue
            return ordered(got, len(some)), False, k
        return [None] * len(some), True, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                given = batch.select(inputs).to_pylist()
                chunks = [given[a : a + items] for a in range(0, len(given), items)]
                values, failed, attempts = [], [], []
                for chunk, (got, lost, k) in zip(chunks, pool.map(ask, chunks), strict=True):
                    values += got
                    failed += [lost] * len(chunk)
                    attempts += [k] * len(chunk)
                made = [pa.array(values, to_arrow_type(kind)), pa.array(failed, pa.bool_()), pa.array(attempts, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(count)), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def company_context(profiles: DataFrame, facets: DataFrame) -> DataFrame:
    """``company_id, context``: what a judge is told of a company: name, description, a line per facet and its guidance.

    ``profiles``: company_id, name, description; ``facets``: company_id, facet_id, name, description, guidance (may be null or empty).
    """
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("description"), F.when(F.length("guidance") > 0, F.concat(F.lit("\n  Guidance: "), F.col("guidance"))).otherwise(F.lit("")))
    lists = facets.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("facet_id", line.alias("line")))).alias("lines"))
    said = F.transform(F.coalesce("lines", F.array().cast("array<struct<facet_id:bigint,line:string>>")), lambda x: x["line"])
    head = F.array(F.concat(F.lit("Company: "), F.col("name")), F.col("description"), F.lit("Relevance facets:"))
    return profiles.join(lists.withColumn("lines", F.col("lines").cast("array<struct<facet_id:bigint,line:string>>")), "company_id", "left").select("company_id", F.array_join(F.concat(head, said), "\n").alias("context"))
