"""Substring dedup by sliding sentence spans (operator 8).

A text is cut into sentences: each ends after ``.!?`` and the blanks that follow,
or after a line end and the blanks that follow; blanks are ``[\\x20\\x09-\\x0D]``.
A span is a run of consecutive sentences with at least ``MIN_SENTENCES`` sentences
and ``MIN_WORDS`` words: from each sentence on the shortest such run, and up to
each sentence the shortest such run. So every sentence of a repeated passage of
that size lies in a span inside the passage, whatever stands around it. Both are
arguments: without the floor of words a span is a run of so many sentences, and
runs of one-word sentences and short license lines count (the README has figures).

Each document's spans are hashed to 128 bits and written once. Counting and the
first document per span combine on the map side; spans found in two documents or
more meet their occurrences again in a join that adaptive execution can split, so
a passage in a third of all documents is no hot task. A sentence goes if any span
that covers it is not the span's first occurrence (smallest ``doc_id``, then
smallest text hash, then earliest in the text).

A document is a ``doc_id`` with a text: rows that share an id, or have none, are
documents of their own if their texts differ; rows that repeat both are one
document, are treated alike and lose nothing to each other. Null, empty and blank
texts have no sentences; null comes back as the empty text. A null ``doc_id``
sorts below all others. Columns ``n_sentences, n_removed, removed`` of the input
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._store import materialise, release, ship, small_side
from tidewire.llm.words import BLANKS

MIN_SENTENCES, MIN_WORDS = 2, 20
NO_ID = -(1 << 63)
_B = r"[\x20\x09-\x0D]"
#: A sentence with the blanks before a text's first and after every one: the sentences of a text make up all of it.
SENTENCE = re.compile(rf"{_B}*+[^\x20\x09-\x0D](?:[^.!?\n]++|[.!?](?!{_B}))*+(?:[.!?]{_B}++|\n{_B}*+)?")


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text)


def runs(sizes: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first sentence, last + 1) of every span of sentences with these numbers of words."""
    n = len(sizes)
    total = np.cumsum([0, *sizes])
    at = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words, "left"), at + min_sentences)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, at + 1 - min_sentences)
    return sorted({(i, e) for i, e in enumerate(ends.tolist()) if e <= n} | {(s, k + 1) for k, s in enumerate(starts.tolist()) if s >= 0})


def spans(found: list[str], min_sentences: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, last + 1, 128-bit hash) of every span, by first sentence."""
    if len(found) < min_sentences:
        return []
    words = [s.encode("utf-8", "surrogatepass").split() for s in found]  # bytes.split() cuts at BLANKS
    data = b"".join(xxhash.xxh3_64_digest(b" ".join(w)) for w in words)
    return [(a, b, xxhash.xxh3_128_digest(data[8 * a : 8 * b])) for a, b in runs([len(w) for w in words], min_sentences, min_words)]


def removed_sentences(found: list[str], min_sentences: int, min_words: int, drop: set[bytes]) -> list[bool]:
    """Which sentences a span covers that is in ``drop`` or came earlier in this text."""
    gone = [False] * len(found)
    seen: set[bytes] = set()
    for a, b, h in spans(found, min_sentences, min_words):
        if h in drop or h in seen:
            gone[a:b] = [True] * (b - a)
        seen.add(h)
    return gone


def rebuilt(text: str, found: list[str], gone: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The text without its removed sentences, and the removed (start, end). Blanks before a removed end go, too."""
    if not any(gone):
        return text, []
    kept = "".join(s for s, g in zip(found, gone, strict=True) if not g)
    cut: list[tuple[int, int]] = []
    at = 0
    for s, g in zip(found, gone, strict=True):
        if g:
            if cut and cut[-1][1] == at:
                cut[-1] = (cut[-1][0], at + len(s))
            else:
                cut.append((at, at + len(s)))
        at += len(s)
    return (kept.rstrip(BLANKS) if gone[-1] else kept), cut


def _document() -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("__id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__key")]


def span_table(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """``(high, low, id, key)``, each span of a row once; a row without hash for a text that repeats a span of its own."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                data, take, again = [], [], []
                for k, text in enumerate(some.column(2).to_pylist()):
                    if text:
                        all_ = [h for _, _, h in spans(sentences(text), min_sentences, min_words)]
                        own = set(all_)
                        data += own
                        take += [k] * len(own)
                        if len(own) < len(all_):
                            again.append(k)
                pairs = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
                none = pa.nulls(len(again), pa.int64())
                rows = pa.array(take + again, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(pairs[:, k].copy()), none]) for k in (0, 1)] + [some.column(k).take(rows) for k in (0, 1)], names=["high", "low", "id", "key"]
                )
        release()

    return docs.select(*_document(), "text").mapInArrow(run, "high bigint, low bigint, id bigint, key bigint")


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated spans, and ``n_sentences, n_removed, removed``.

    ``removed``: array of ``(start, end)`` code point offsets into the given text.
    """
    ship(docs.sparkSession)
    found = materialise(span_table(docs, min_sentences, min_words), "spans")
    hashes = ["high", "low"]
    least = found.where("high IS NOT NULL").groupBy(*hashes).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("key").alias("least"), F.max("key").alias("most"))
    met = found.join(least.where("first != last OR least != most").select(*hashes, "first"), hashes)
    hits = met.where(F.col("id") != F.col("first")).select("id", "key", *hashes)
    # Ids that stand for several texts (null, as a rule): the smallest key is the first of a span's documents.
    several = materialise(found.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select(F.col("id").alias("first")), "several")
    if several.limit(1).count():
        ties = materialise(met.where(F.col("id") == F.col("first")).join(small_side(several), "first", "left_semi").select("id", "key", *hashes), "span-ties")
        first_key = ties.groupBy(*hashes).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key")).where("first_key != last_key").drop("last_key")
        hits = hits.unionByName(ties.join(first_key, hashes).where(F.col("key") != F.col("first_key")).select("id", "key", *hashes))
    hits = hits.unionByName(found.where("high IS NULL").select("id", "key", *hashes))
    # A document's own spans bound its list.
    drops = hits.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("high", "low")).alias("__drop"))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    marked = docs.select(*kept, *_document()).join(drops, ["__id", "__key"], "left").select(*kept, "__drop")
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(docs.select(*kept).schema.fields).add("n_sentences", T.LongType()).add("n_removed", T.LongType()).add("removed", T.ArrayType(pair))
    arrow_pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out = [batch.column(k) for k in range(len(kept))]
                texts, total, removed, cuts_out = [], [], [], []
                for text, drop in zip(out[kept.index("text")].to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                    text = text or ""
                    cuts = sentences(text)
                    new, ranges, gone = text, [], []
                    if drop:  # else no span is another's, or comes twice
                        gone = removed_sentences(cuts, min_sentences, min_words, {struct.pack("<qq", d["high"], d["low"]) for d in drop if d["high"] is not None})
                        new, ranges = rebuilt(text, cuts, gone)
                    texts.append(new)
                    total.append(len(cuts))
                    removed.append(sum(gone))
                    cuts_out.append([{"start": a, "end": b} for a, b in ranges])
                out[kept.index("text")] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*out, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts_out, arrow_pair)], names=schema.names)
        release()

    return marked.mapInArrow(run, schema)


def brute_force(rows: list[tuple[int | None, str | None]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int | None, str]]:
    """(doc_id, text after dedup) of every row, for small tests: spans compared as strings. Texts of one id sort by their hash."""

    def split(text: str | None) -> list[str]:
        out, at = [], 0
        text = text or ""
        for k in range(len(text) + 1):
            ends = k == len(text) or text[k] not in BLANKS and k and text[k - 1] in BLANKS and (text[:k].rstrip(BLANKS)[-1:] in (".", "!", "?") or "\n" in text[len(text[:k].rstrip(BLANKS)) : k])
            if ends and text[at:k].strip(BLANKS) and not (k < len(text) and len(text[at:k].strip(BLANKS)) == 1 and "\n" not in text[len(text[:k].rstrip(BLANKS)) : k]):
                out.append(text[at:k])
                at = k
        return out

    def every(cuts: list[str]):
        count = [len(re.findall(r"[^\x20\x09-\x0D]+", s)) for s in cuts]
        fits = lambda a, b: b - a >= min_sentences and sum(count[a:b]) >= min_words
        for a in range(len(cuts)):
            for b in range(a + 1, len(cuts) + 1):
                if fits(a, b) and (not fits(a, b - 1) or not fits(a + 1, b)):
                    yield a, b, tuple(" ".join(re.findall(r"[^\x20\x09-\x0D]+", s)) for s in cuts[a:b])

    first: dict[tuple, tuple] = {}
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, _spark_hash(r[1])))
    for i, text in ordered:
        for a, _, key in every(split(text)):
            first.setdefault(key, (i, text, a))
    out = []
    for i, text in rows:
        cuts = split(text)
        gone = [False] * len(cuts)
        for a, b, key in every(cuts):
            if first[key] != (i, text, a):
                gone[a:b] = [True] * (b - a)
        kept = "".join(s for s, g in zip(cuts, gone, strict=True) if not g)
        out.append((i, (text or "") if not any(gone) else kept.rstrip(BLANKS) if gone[-1] else kept))
    return out


def _spark_hash(text: str | None) -> int:
    """Spark's xxhash64 of a string, 0 for null."""
    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42) if text is not None else 0
    return h - (1 << 64) if h >= 1 << 63 else h


_WORDLIST = r"list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D].*?(?:[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|\z)') AS cuts FROM documents
), sentence AS (
  SELECT doc_id, i, s, {_WORDLIST} AS w FROM (SELECT doc_id, unnest(cuts) AS s, generate_subscripts(cuts, 1) AS i FROM split)
), counted AS (
  SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) AS before,
         sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM sentence
), bounds AS (
  SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.i >= a.i + {MIN_SENTENCES - 1} AND b.upto - a.before >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.i >= a.i + {MIN_SENTENCES - 1} AND b.upto - a.before >= {MIN_WORDS} GROUP BY b.doc_id, b.i
), lists AS (
  SELECT doc_id, list(array_to_string(w, ' ') ORDER BY i) AS all_ FROM counted GROUP BY doc_id
), spans AS (
  SELECT b.doc_id, a, b, all_[a:b] AS span FROM bounds b JOIN lists l ON l.doc_id = b.doc_id
), ranked AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY span ORDER BY doc_id, a) AS nth FROM spans
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE nth > 1
), marked AS (
  SELECT c.doc_id, c.i, c.s, c.ends - length(c.s) AS starts, c.ends, g.i IS NOT NULL AS gone, c.i - count(g.i) OVER (PARTITION BY c.doc_id ORDER BY c.i) AS island
  FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.i = c.i
), ranges AS (
  SELECT doc_id, string_agg(starts || '-' || ends, ';' ORDER BY starts) AS removed FROM (SELECT doc_id, min(starts) AS starts, max(ends) AS ends FROM marked WHERE gone GROUP BY doc_id, island) GROUP BY doc_id
), rebuilt AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT gone), '') AS kept, arg_max(gone, i) AS end_gone FROM marked GROUP BY doc_id
)
SELECT p.doc_id, coalesce(r.n_sentences, 0) AS n_sentences, coalesce(r.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed,
       CASE WHEN coalesce(r.n_removed, 0) = 0 THEN p.text WHEN r.end_gone THEN regexp_replace(r.kept, '[\x20\x09-\x0D]+\z', '') ELSE r.kept END AS text
FROM split p LEFT JOIN rebuilt r ON r.doc_id = p.doc_id LEFT JOIN ranges g ON g.doc_id = p.doc_id
"""
