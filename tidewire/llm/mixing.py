"""Mixing sources to target weights along a time-varying curriculum (operator 9, native).

Targets. Sources in code point order (null last) weigh 3, 1, 2, repeating, and
share ``budget`` times all words. A target stops at ``max_repeats`` times its
source's words; what is cut goes to the others by weight until none is above:
with sources sorted by cap over weight that is one level, the largest of
``(budget - caps before) / (weights from here on)``.

Demand. The documents of a source stand in the order of the MD5 of their id and
form one stream of words, read ``max_repeats`` times at most. The stream's first
``round(target)`` words are taken, so a copy of a document is taken whole, up to
the border, or not at all. Prefix sums are cut in two: the n documents of a
source are cut into about sqrt(n) MD5 ranges, offsets are summed over a source's
ranges, and windows over rows run inside one range each. No window holds more
than about sqrt(n) rows, and a source with a third of all rows is spread over
all tasks.

Positions. A source's weight follows a schedule over training time (piecewise
linear in 0..1, scaled so that its integral is the target). The word a copy has
in its middle is demanded when the integral reaches it; inverting the integral
(quadratic in each piece) gives the copy's training position; words that are not
demanded by time 1 have none and are not taken. ``training_order`` range-sorts
copies by position. ``training_set`` does so with whole rows: windows and joins
before it carry a row's number, source and size only, ranges are cut from a
histogram of the taken words over positions (so each holds about as many words),
and texts are joined to their positions once and move to their range once.

Null ``doc_id``: sorts by the MD5 of its text's hash (``tie``), or of the empty
string where no tie is given; either way after equal hashes. Null, empty and
blank texts have size 0 and nothing is taken of them. Repeated rows are documents
of their own. Columns of the input named like result columns are replaced. An
empty table gives no rows. Everything is DataFrame functions, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import materialise, numbered, small_side
from tidewire.llm.words import word_count

#: Weights in turn, share of all words, and the most copies of a document.
WEIGHTS, BUDGET, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: Schedules in turn: knots (time, relative weight). Heavy sources fade, light ones stay, others grow.
SCHEDULES = (
    ((0.0, 1.5), (0.7, 1.0), (1.0, 0.25)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Steps of the histogram over positions, and the words that one range of the training order aims at.
POSITION_STEPS, RANGE_WORDS = 4096, 4_000_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the word count of its text as ``size``, and a ``tie`` where the id is null."""
    return docs.withColumns({"size": word_count(F.col(text)), "tie": F.when(F.col("doc_id").isNull(), F.xxhash64(text))})


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_repeats=MAX_REPEATS) -> DataFrame:
    """``source, rank, weight, n_docs, source_size, target``, one row per source of a sized table."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row per source from here on: names are ranked in a single order, so these windows have one partition.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(named)).withColumn(
        "weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    from_here = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        ranked.withColumn("__caps", F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(from_here))
        .withColumn("__budget", budget * F.sum("source_size").over(everything))
        .withColumn("__level", F.max((F.col("__budget") - F.col("__caps")) / F.col("__weights")).over(everything))
        .withColumn("target", F.least(F.col("__level") * F.col("weight"), (max_repeats * F.col("source_size")).cast("double")))
        .select("source", "rank", "weight", "n_docs", "source_size", "target")
    )


def _pieces(knots) -> list[tuple[float, float, float, float, float]]:
    """(time from, time to, weight from, slope, share of demand before) of each piece, scaled to integral 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if not (knots[0][0] == 0 and knots[-1][0] == 1 and area > 0 and all(k[1] >= 0 for k in knots)):
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0, not all 0")
    out, done = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        if t1 > t0:
            out.append((t0, t1, m0 / area, (m1 - m0) / area / (t1 - t0), done))
            done += (t1 - t0) * (m0 + m1) / 2 / area
    return out


def training_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """When a source's schedule has demanded this share (0..1) of its words."""

    def inverse(knots) -> Column:
        value = None
        for t0, t1, m0, slope, done in _pieces(knots):
            rest = F.greatest(share - done, F.lit(0.0))
            root = m0 + F.sqrt(F.greatest(m0 * m0 + 2 * slope * rest, F.lit(0.0)))
            here = F.least(t0 + F.when(root > 0, 2 * rest / root).otherwise(0.0), F.lit(t1))
            value = here if value is None else F.when(share >= done, here).otherwise(value)
        return value

    out = inverse(schedules[-1])
    for k, knots in enumerate(schedules[:-1]):
        out = F.when(F.pmod(rank - 1, F.lit(len(schedules))) == k, inverse(knots)).otherwise(out)
    return out


def mix(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_repeats=MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """All columns of a sized table (``doc_id, source, size``; ``tie`` if there is one) and the plan of every document.

    Adds ``source_size, target, taken`` and ``copies``, an array of
    ``(copy, words, position)`` for the copies of which words are taken.
    """
    kept = [c for c in sizes.columns if c not in ("source_size", "target", "taken", "copies")]
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    targets = source_targets(sizes, weights, budget, max_repeats).withColumn("__key", key)
    targets = materialise(targets.select("__key", *(F.col(c).alias(f"__{c}") for c in ("rank", "n_docs", "source_size", "target"))), "mix-targets")
    tie = F.col("tie").cast("string") if "tie" in sizes.columns else F.lit(None).cast("string")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), tie, F.lit("")))
    rows = (
        sizes.select(*kept)
        .withColumn("__key", key)
        .withColumn("__order", order)
        .join(small_side(targets), "__key")
        .withColumn("__ranges", F.ceil(F.sqrt("__n_docs")))
        .withColumn("__range", F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("bigint") * F.col("__ranges") / float(1 << 32)))
    )
    sums = rows.groupBy("__key", "__range").agg(F.sum("size").alias("__sum"))
    ranges = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sums.select("__key", "__range", F.coalesce(F.sum("__sum").over(ranges), F.lit(0)).alias("__offset")), "mix-offsets")
    inside = Window.partitionBy("__key", "__range").orderBy("__order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.floor(F.col("__target") + 0.5).cast("bigint")

    def copy(k: int) -> Column:
        start = F.col("__start") + k * F.col("__source_size")
        words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("__goal") - start))
        share = F.try_divide(start + words / 2, F.col("__goal"))  # no goal, no words: the copy is dropped below
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), training_time(share, F.col("__rank"), schedules).alias("position"))

    return (
        rows.join(small_side(offsets), ["__key", "__range"])
        .withColumn("__start", F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("__goal", goal)
        .withColumn("copies", F.filter(F.array(*(copy(k) for k in range(max_repeats))), lambda c: c["words"] > 0))
        .withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"]))
        .select(*kept, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken", "copies")
    )


def copies_of(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with ``copy, words, position``."""
    rest = [c for c in mixed.columns if c not in ("copies", "copy", "words", "position")]
    return mixed.select(*rest, F.explode("copies").alias("__c")).select(*rest, "__c.copy", "__c.words", "__c.position")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with ``copy, words, position``, range-sorted by position."""
    return copies_of(mixed).orderBy("position", "doc_id", "copy")


def with_positions(mixed: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document with the training positions of its copies as ``position_1``, ``position_2`` ..., range-sorted by the first (documents of which nothing is taken last)."""
    rest = [c for c in mixed.columns if c not in ("copies", *(f"position_{k + 1}" for k in range(max_repeats)))]

    def at(k: int) -> Column:
        return F.get(F.filter("copies", lambda c: c["copy"] == k), F.lit(0))["position"].alias(f"position_{k + 1}")

    return mixed.select(*rest, *map(at, range(max_repeats))).orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def training_set(docs: DataFrame, text: str = "text", range_words: int = RANGE_WORDS, **how) -> DataFrame:
    """All columns of ``docs``, a row per whole copy in training order, with ``train_position`` and ``train_copy``.

    The copy at the border of a source's target stays, whole, if half of its words
    are taken. Columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("train_position", "train_copy")]
    rows = numbered(docs.select(*kept), "__row")
    sizes = sized(rows.select("__row", "doc_id", "source", F.col(text).alias("__text")), "__text").drop("__text")
    copies = copies_of(mix(materialise(sizes, "mix-sizes"), **how)).where(2 * F.col("words") >= F.col("size"))
    taken = materialise(copies.select("__row", "copy", "words", "position", F.least(F.floor(F.col("position") * POSITION_STEPS), F.lit(POSITION_STEPS - 1)).alias("step")), "mix-taken")
    steps = taken.groupBy("step").agg(F.sum("words").alias("words"))  # POSITION_STEPS rows at most: one task may see them all
    total = steps.agg(F.sum("words")).first()[0] or 0
    ranges = max(1, -(-total // range_words), min(total, docs.sparkSession.sparkContext.defaultParallelism))
    before = F.coalesce(F.sum("words").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = steps.select("step", F.least(F.floor(before * ranges / max(1, total)), F.lit(ranges - 1)).cast("int").alias("__range"))
    placed = materialise(taken.join(F.broadcast(cut), "step").select("__row", "__range", F.col("position").alias("train_position"), F.col("copy").alias("train_copy")), "mix-placed")
    joined = rows.join(small_side(placed), "__row").select(*kept, "train_position", "train_copy", "__range")
    return joined.repartitionById(ranges, "__range").sortWithinPartitions("train_position", "doc_id", "train_copy").drop("__range")


def _inverse_sql() -> str:
    """The training position of the word in a copy's middle, as SQL over ``share`` and ``rank``."""

    def inverse(knots) -> str:
        value = ""
        for t0, t1, m0, slope, done in _pieces(knots):
            rest = f"greatest(share - {done!r}, 0.0)"
            root = f"({m0!r} + sqrt(greatest({m0!r} * {m0!r} + 2 * {slope!r} * {rest}, 0.0)))"
            here = f"least({t0!r} + CASE WHEN {root} > 0 THEN 2 * {rest} / {root} ELSE 0.0 END, {t1!r})"
            value = f"CASE WHEN share >= {done!r} THEN {here} ELSE {value} END" if value else here
        return value

    turns = " ".join(f"WHEN {k} THEN {inverse(knots)}" for k, knots in enumerate(SCHEDULES))
    return f"CASE (rank - 1) % {len(SCHEDULES)} {turns} END"


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM totals
), levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(2 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, rank, source_size, least(max(level) OVER () * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, size, source_size, target, rank, goal, copy, start + copy * source_size AS begins, greatest(0, least(size, goal - (start + copy * source_size))) AS words
  FROM placed, (SELECT unnest([0, 1]) AS copy)
), timed AS (
  SELECT *, CASE WHEN words > 0 THEN {_inverse_sql()} END AS position FROM (SELECT *, (begins + words / 2) / nullif(CAST(goal AS DOUBLE), 0) AS share FROM copies)
)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken,
       round(max(CASE WHEN copy = 0 THEN position END), 9) AS position_1, round(max(CASE WHEN copy = 1 THEN position END), 9) AS position_2
FROM timed GROUP BY doc_id, size, source_size, target
"""
