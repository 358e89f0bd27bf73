"""Phrase collocation mining by pivot partitioning, as in MG-FSM (operator 11).

A phrase is a run of 2 to ``max_words`` words inside a piece of a text. It is owned
by its *pivot*, its rarest word (of two equally rare ones the later in the
dictionary; a word that a phrase holds twice owns it at its first place). Steps:

1. Words are counted per language. Those of at least ``least`` occurrences get
   numbers, the most frequent first: the dictionary. No other word can lie in a
   frequent phrase, so all others count as gaps, as borders of pieces do.
2. Every occurrence of a word is rewritten to a fragment: itself and up to
   ``max_words - 1`` words on either side, cut where a rarer word (or, on the left,
   the word itself) stands. So frequent words, which have few words above them,
   have short and few distinct fragments. Equal fragments of a task are one with a
   count. Fragments go to partitions by pivot.
3. A partition counts the phrases of its fragments that hold the pivot, and emits
   those of at least ``least`` occurrences. A pivot with more than ``HOT``
   occurrences is dealt to several partitions, whose counts are added afterwards.
4. Scores and the drop rule are joins of the frequent phrases among themselves.

Dictionary words are looked up in a broadcast of the ``HEAD`` most frequent ones
(bounded in rows and bytes). If there are more, every document first meets those
of its other words that are in the dictionary by a shuffled join, which a word of
the tail can't skew; the result is the same.

Null texts are empty, null languages are ``und``. A piece, a text or a word may be
of any length. Every row counts, repeated ones as often as they come; ids and
extra columns are not read. No rows, or none with frequent phrases, give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import materialise, numbered, release, ship

LEAST, MAX_WORDS, COVERED_PERCENT, TOP = 10, 3, 50, 2000
NO_LANG = "und"
#: Words of the broadcast dictionary, and their bytes.
HEAD, HEAD_BYTES = 500_000, 16 << 20
#: Fragments of one partition, and occurrences from which a pivot is dealt to several.
PARTITION, HOT = 600_000, 150_000
#: Words of a task that are rewritten together.
BLOCK = 1_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
#: Bytes of a text that are cut to words at a time.
SLICE = 4 << 20
GAP = -1
#: One pass over a text's bytes: A-Z to lower case, tabs to blanks, ends of pieces to line feeds.
BYTES = bytes(ord(c.lower()) if "A" <= (c := chr(b)) <= "Z" else 32 if b == 9 else 10 if c in ".,;:!?" or 10 <= b <= 13 else b for b in range(256))
END = b"\n"
ROWS_OF_A_TOP = 200_000


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's words in order, in slices; ends of pieces are words of their own (a line feed)."""
    text = text.translate(BYTES)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            end = text.find(b" ", at + SLICE) + 1 or end
        yield [w for w in text[at:end].replace(END, b" \n ").split(b" ") if w]
        at = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``texts`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items() if w != END]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in _texts(batch):
                for words in words_of(text):
                    found.setdefault(lang, Counter()).update(words)
                if sum(map(len, found.values())) > COUNTED:
                    yield out()
        yield out()
        release()

    return texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """``lang, word, n, id`` of the words with ``least`` occurrences; ids count from 0 by falling n over all languages."""
    order = [F.desc("n"), F.col("lang"), F.col("word")]
    ranged = counts.where(F.col("n") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "dictionary")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = laid.groupBy(part.alias("part")).count().collect()  # one row a partition
    before, start = 0, {}
    for r in sorted(sizes, key=lambda r: r.part):
        start[r.part], before = before, before + r["count"]
    first = F.element_at(F.create_map(*(F.lit(x) for kv in start.items() for x in kv)), part) if start else F.lit(0)
    return laid.select("lang", "word", "n", (first + inside).cast("bigint").alias("id"))


def fragments(ids: np.ndarray, reach: int) -> np.ndarray:
    """One row per word with company: ``reach`` words left of it, itself, ``reach`` words right; cut parts are gaps."""
    side = np.full(reach, GAP, ids.dtype)
    padded = np.concatenate([side, ids, side])
    at = np.flatnonzero(ids >= 0)
    out = np.full((len(at), 2 * reach + 1), GAP, ids.dtype)
    pivot = out[:, reach] = ids[at]
    for sign in (-1, 1):
        on = np.ones(len(at), bool)
        for k in range(1, reach + 1):
            word = padded[at + reach + sign * k]
            on &= (word >= 0) & ((word < pivot) if sign < 0 else (word <= pivot))
            out[on, reach + sign * k] = word[on]
    return out[(out[:, reach - 1] >= 0) | (out[:, reach + 1] >= 0)]


def merged(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with their count (or summed weights), ordered by a hash; rare clashes of it leave some apart."""
    if not len(rows):
        return rows, np.empty(0, np.int64)
    key = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        key = (key ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    rows = rows[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    counts = np.diff(np.append(new, len(rows))) if weights is None else np.add.reduceat(weights[order], new)
    return rows[new], counts.astype(np.int64)


def pack(rows: np.ndarray) -> bytes:
    """Numbers of 8 bytes, low bytes of all first: the high ones are mostly equal and vanish in compression."""
    return rows.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1, width)


def phrases(rows: np.ndarray, weights: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``size`` words around the pivots of fragments, and how often they occur."""
    found, often = [], []
    for start in range(reach - size + 1, reach + 1):
        some = rows[:, start : start + size]
        whole = (some >= 0).all(axis=1)
        found.append(some[whole])
        often.append(weights[whole])
    words, often = np.concatenate(found), np.concatenate(often)
    # Words are numbered one after the other, so that a phrase is one number, whatever its size.
    code = np.zeros(len(words), np.int64)
    for k in range(size):
        word, number = np.unique(words[:, k], return_inverse=True)
        _, code = np.unique(code * len(word) + number, return_inverse=True)
    order = np.argsort(code, kind="stable")
    new = np.flatnonzero(np.diff(code[order], prepend=-1))
    return words[order[new]], np.add.reduceat(often[order], new) if len(new) else often


def _partition(pivots: np.ndarray, salts: np.ndarray, partitions: int) -> np.ndarray:
    mixed = (pivots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (salts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed >> np.uint64(32)) % np.uint64(partitions)).astype(np.int64)


def phrase_counts(texts: DataFrame, words: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, head: int = HEAD, partition: int = PARTITION, hot: int = HOT) -> DataFrame:
    """``ids, a``: all phrases of dictionary words with at least ``least`` occurrences. ``texts``: lang, text; ``words``: as :func:`dictionary` returns."""
    spark = texts.sparkSession
    reach = max_words - 1
    known, occurrences = words.agg(F.count("*"), F.sum("n")).first()
    near = words.where(F.col("id") < head).select("lang", "word", "id", "n")
    size = near.agg(F.sum(F.octet_length("word") + F.octet_length("lang"))).first()[0] or 0
    while size > HEAD_BYTES:  # words are long: fewer of them are sent
        head = head * HEAD_BYTES // (2 * size)
        near = near.where(F.col("id") < head)
        size = near.agg(F.sum(F.octet_length("word") + F.octet_length("lang"))).first()[0] or 0
    tables: dict[str, dict[bytes, int]] = {}
    parts: dict[int, int] = {}  # of pivots with so many occurrences that one partition shouldn't have them all
    for r in near.toLocalIterator():  # at most ``head`` words of HEAD_BYTES in all
        tables.setdefault(r.lang, {})[r.word.encode()] = r.id
        if r.n > hot:
            parts[r.id] = -(-r.n // hot)
    partitions = max(1, -(-int(occurrences or 0) // partition))
    sent = spark.sparkContext.broadcast((tables, parts))
    given = texts.select("lang", "text", F.lit(None).cast("array<struct<word:string,id:bigint,parts:bigint>>").alias("own"))
    if known > head:
        tail = words.where(F.col("id") >= head).select("lang", "word", "id", F.ceil(F.col("n") / hot).alias("parts"))
        given = _with_own_words(texts, tail, sent)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts = sent.value
        own_parts: dict[int, int] = {}
        waiting: list[np.ndarray] = []
        turn = np.random.default_rng(0)

        def out() -> pa.RecordBatch:
            rows, weights = merged(fragments(np.concatenate(waiting), reach))
            waiting.clear()
            pivots = rows[:, reach]
            distinct, which = np.unique(pivots, return_inverse=True)
            shares = np.array([parts.get(k) or own_parts.get(k, 1) for k in distinct.tolist()], np.int64)[which]
            own_parts.clear()
            to = _partition(pivots, turn.integers(0, 1 << 40, len(rows)) % shares, partitions)
            order = np.argsort(to, kind="stable")
            rows, to = np.column_stack([rows, weights, shares > 1])[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            packed = [pack(x) for x in np.split(rows, cuts[1:])] if len(cuts) else []
            return pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int64()), pa.array(packed, pa.binary())], names=["part", "fragments"])

        some = 0
        for batch in batches:
            for (lang, text), own in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                table = tables.get(lang, {})
                if own:
                    table = Chain(table, {w["word"].encode(): w["id"] for w in own})
                    own_parts.update((w["id"], w["parts"]) for w in own if w["parts"] > 1)
                for found in words_of(text):
                    waiting.append(np.array([table.get(w, GAP) for w in found], np.int64))
                    some += len(found)
                waiting.append(np.array([GAP], np.int64))
                if some >= BLOCK:
                    yield out()
                    some = 0
        if waiting:
            yield out()
        release()

    def mine(key: tuple, group: pa.Table) -> pa.Table:
        width = 2 * reach + 1
        rows = np.concatenate([unpack(x, width + 2) for x in group["fragments"].to_pylist()])
        is_hot = rows[:, width + 1]  # goes with the pivot
        rows, weights = merged(np.column_stack([rows[:, :width], is_hot]), rows[:, width])
        is_hot, rows = rows[:, width] == 1, rows[:, :width]
        ids, often, open_ = [], [], []
        for some, still_open in ((~is_hot, False), (is_hot, True)):
            for m in range(2, max_words + 1):
                words, n = phrases(rows[some], weights[some], m, reach)
                stays = np.ones(len(n), bool) if still_open else n >= least
                ids += words[stays].tolist()
                often += n[stays].tolist()
                open_ += [still_open] * int(stays.sum())
        release()
        return pa.table({"ids": pa.array(ids, pa.list_(pa.int64())), "a": pa.array(often, pa.int64()), "open": pa.array(open_, pa.bool_())})

    # One row a task and partition; written, so that a lost executor costs its own tasks only.
    sent_out = given.mapInArrow(rewrite, "part bigint, fragments binary")
    mined = materialise(sent_out.groupBy("part").applyInArrow(mine, "ids array<bigint>, a bigint, open boolean"), "phrases-mined")
    added = mined.where("open").groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return mined.where("NOT open").select("ids", "a").unionByName(added)


class Chain:
    """A document's own words before those of its language."""

    def __init__(self, all_: dict[bytes, int], own: dict[bytes, int]):
        self.all, self.own = all_, own

    def get(self, word: bytes, default: int) -> int:
        found = self.own.get(word)
        return self.all.get(word, default) if found is None else found


def _with_own_words(texts: DataFrame, tail: DataFrame, sent) -> DataFrame:
    """``lang, text, own``: the words of each text that the broadcast lacks and the dictionary has."""
    rows = numbered(texts, "row")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, _ = sent.value
        for batch in batches:
            lang, word, row = [], [], []
            for k, (of, text) in enumerate(_texts(batch)):
                table = tables.get(of, {})
                own = {w for found in words_of(text) for w in found if w not in table and w != END}
                lang += [of] * len(own)
                word += own
                row += [k] * len(own)
            columns = [pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), batch.column(2).take(pa.array(row, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "row"])

    kind = rows.schema["row"].dataType.simpleString()
    met = rows.select("lang", "text", "row").mapInArrow(others, f"lang string, word string, row {kind}").join(tail, ["lang", "word"])
    lists = met.groupBy("row").agg(F.collect_list(F.struct("word", "id", "parts")).alias("own"))  # a text's own words
    return rows.join(lists, "row", "left").select("lang", "text", "own")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT, text: str = "text", lang: str = "lang", head: int = HEAD, partition: int = PARTITION, hot: int = HOT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    a: occurrences of the phrase; l, r: of the two parts of its lowest-scoring cut; n: words of the language; score: ``floor(10^6 a^2 / (l r))``.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialise(word_counts(texts), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = dictionary(counts, least)
    frequent = materialise(phrase_counts(texts, words, least, max_words, head, partition, hot), "phrases")
    # Longer phrases that hold a phrase and are nearly as frequent.
    inner = [(s, m) for m in range(2, max_words) for s in range(1, max_words - m + 2)]
    parts = [F.struct(F.slice("ids", s, m).alias("ids"), ((F.size("ids") > m) & (F.size("ids") >= s + m - 1)).alias("there")) for s, m in inner]
    kept = frequent
    if parts:
        held = frequent.select("a", F.explode(F.array(*parts)).alias("p")).where("p.there").groupBy("p.ids").agg(F.max("a").alias("longer"))
        kept = frequent.join(held, "ids", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered_percent, F.lit(True))).select("ids", "a")
    # Occurrences of the two sides of every cut: words from the dictionary, phrases from the frequent ones.
    sides = frequent.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(sides.select(F.col("ids").alias(side), F.col("a").alias(name)), side)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    named = _named(scored.select("ids", "a", "cut.l", "cut.r", "cut.score"), words)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Each share of a language keeps its own first phrases, so no task sorts a whole language.
    named = materialise(named, "phrases-named")
    shares = max(1, -(-named.count() // ROWS_OF_A_TOP))
    inside = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order))
    best = named.withColumn("rank", inside).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def _named(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``lang`` and ``phrase`` in place of ids."""
    # ids + a as decimals: a frequent phrase is met once per word.
    each = rows.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = each.groupBy("ids", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return spelled.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score")


ORACLE = """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS p FROM texts)),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda s: array_to_string(w[s:s + size - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size
),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
longer AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY lang, part
),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.phrase = longer.part AND c.size = 2 WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (SELECT kept.*, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM kept, (VALUES (1), (2)) k(k) WHERE k < size),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, ((1000000 * cuts.a::HUGEINT * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part AND x.size = k JOIN f y ON y.lang = cuts.lang AND y.phrase = rest AND y.size = cuts.size - k
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
"""
