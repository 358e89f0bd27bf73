"""Quality rules by robust multivariate outliers (operator 4, native).

Five counts of a text become a statistic vector. For every language and source,
and for all rows together, the minimum-covariance-determinant estimate of centre
and scatter is found by concentration steps from three starts: medians and median
deviations, and the moments of two fixed quarters of the rows. A step takes the
``H`` share of rows nearest to the centre; their mean and covariance are the next
estimate. An estimate is settled when a step changes the logarithm of its
determinant by less than ``SETTLED``; the others go on, for ``MAX_STEPS`` steps at
most, and the start that ends at the least determinant is chosen. Scatter is regularised
by ``FLOORS`` (many sources have columns that are all zero) and made consistent for
regular rows by ``CONSISTENCY``.

A group's centre and scatter are drawn towards those of all rows, as if ``SHRINK``
rows of the whole were added to its n rows. So groups of any size are judged by
one rule, large ones by themselves and single rows by the whole. (The distance
between the centres adds nothing to the scatter, else an outlier that is half of
a group would hide itself.) A row whose squared Mahalanobis distance exceeds
``CUT`` is rejected.

Order statistics come from counts of fixed bins, so no group is ever gathered or
sorted: a step is one aggregate by group, start and bin, which combines on the map
side; a source with a third of all rows costs a few rows per task, and reruns agree.

Rows that fail the base rule are no part of the estimates. Null text: no words,
all counts 0, base_failed. Null lang or source: groups of their own. Repeated
rows are judged alike; an empty table gives no rows. Everything is DataFrame
functions, and a document's words never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import materialise
from tidewire.llm.words import let, words

SYMBOLS = r"[^#*$%&|<>]+"
#: Share of rows that a concentration step keeps, and the factor that undoes its shrinking for
#: normal rows of five dimensions: 0.75 / P(chi2 with 7 < 6.626), 6.626 the 0.75 quantile with 5.
H, CONSISTENCY = 0.75, 1.41
#: Regular rows exceed this squared distance (chi2 with 5) once in a million.
CUT = 35.888
MAX_STEPS, SETTLED = 8, 0.01
#: Rows of the whole that a group's estimate is mixed with.
SHRINK = 50.0
#: Parts of the rows, two of which are starts. A part follows from the counts alone.
PARTS = 4
#: The group of all rows. (Other groups hold one \x1f.)
EVERYTHING = "\x1d"
#: Estimates (rows of about 200 bytes) that may be broadcast.
BROADCAST_ESTIMATES = 50_000
#: Scatter added to each dimension, as a standard deviation.
FLOORS = (0.5, 0.08, 0.05, 0.5, 0.1)
DIMENSIONS = range(len(FLOORS))
#: Bins per unit of a statistic, and of the logarithm of a distance.
VALUE_BINS, DISTANCE_BINS = 64, 32


def _repeated_words(terms: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    hashes = F.when(
        F.size(terms) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(terms) - 3), lambda i: F.xxhash64(F.get(terms, i), F.get(terms, i + 1), F.get(terms, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda at, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), at - F.get(p, k - 1))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, step: n + step)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(ordered, lambda s: let(starts(s), length)))

    return let(hashes, covered)


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")
        ),
    )
    counted = docs.select(
        *keep,
        of_words.alias("__w"),
        F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
    )
    return counted.select(
        *keep, "__w.n_words", "__w.word_chars", "n_symbols", "n_dup_lines", "__w.n_repeat_words",
        ((F.col("__w.n_words") < 50) | (100 * F.col("__w.n_repeat_words") > 50 * F.col("__w.n_words"))).alias("base_failed"),
    )


def statistics() -> list[Column]:
    """The transformed statistic vector of a row that passed the base rule."""
    n, chars = F.col("n_words"), F.col("word_chars")
    # Rows without words have no vector (and are never judged).
    return [F.log1p(n), F.log(F.try_divide(chars, n)), F.sqrt(F.try_divide(F.col("n_symbols"), chars)), F.log1p("n_dup_lines"), F.try_divide(F.col("n_repeat_words"), n)]


def _quantile(counts: DataFrame, keys: list[str], share: float, bins: int, name: str) -> DataFrame:
    """The bin (as a value) where the cumulated count of each key reaches the share of all. One row per key and bin comes in."""
    run = Window.partitionBy(*keys).orderBy("bin")
    total = Window.partitionBy(*keys)
    return (
        counts.withColumn("__run", F.sum("n").over(run)).withColumn("__all", F.sum("n").over(total))
        .where(F.col("__run") >= share * F.col("__all")).groupBy(*keys).agg((F.min("bin") / bins).alias(name))
    )


def _binned(rows: DataFrame, values: list[Column], share: float, name: str) -> DataFrame:
    """``g`` and an array column: the quantile of each value by group."""
    each = rows.select("g", F.posexplode(F.array(*values)).alias("d", "v"))
    counts = each.groupBy("g", "d", F.round(F.col("v") * VALUE_BINS).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    by_d = _quantile(counts, ["g", "d"], share, VALUE_BINS, "q")
    return by_d.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "q"))), lambda e: e["q"]).alias(name))  # five values a group


M = [f"m{i}" for i in DIMENSIONS]
L = [f"l{i}{j}" for i in DIMENSIONS for j in range(i + 1)]
X = [f"x{i}" for i in DIMENSIONS]
PAIRS = [(i, j) for i in DIMENSIONS for j in range(i + 1)]


def _factored(found: DataFrame, scatter: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """``keep`` columns, centre ``m0..``, Cholesky factor ``l00..`` of a scatter with its floors, and the logarithm of its determinant."""
    out = found.select(*keep, *M, *(scatter[p].alias(f"c{p[0]}{p[1]}") for p in PAIRS))
    for i, j in PAIRS:
        left = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return out.select(*keep, *M, *L, sum((2 * F.log(f"l{i}{i}") for i in DIMENSIONS), F.lit(0.0)).alias("det"))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS)]


def _from_moments(sums: DataFrame, consistency: float) -> DataFrame:
    """``g, k`` and the estimate from counts and sums."""
    with_means = sums.select("*", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in DIMENSIONS))
    scatter = {
        (i, j): consistency * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS
    }
    return _factored(with_means, scatter, ["g", "k"])


def _mahalanobis() -> Column:
    z: list[Column] = []
    for i in DIMENSIONS:
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * z[j] for j in range(i)), F.lit(0.0))
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _twice(rows: DataFrame) -> DataFrame:
    """Every row in its own group and in the group of all rows."""
    return rows.unionByName(rows.withColumn("g", F.lit(EVERYTHING)))


def _with(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """Rows in both groups with each start's estimate (``few``: their number is within the bound). The group of all rows has as many estimates as there are starts."""
    own, whole = estimate.where(F.col("g") != EVERYTHING), estimate.where(F.col("g") == EVERYTHING)
    both = rows.join(F.broadcast(own) if few else own, "g")
    # Not a literal, which would make a nested loop of the join with these few rows.
    return both.unionByName(rows.withColumn("g", F.when(F.col("part").isNotNull(), F.lit(EVERYTHING))).join(F.broadcast(whole), "g").select(*both.columns))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """``g, k`` and estimates: 0 medians and median deviations, 1 and 2 the moments of a part of the rows."""
    twice = _twice(rows)
    columns = [F.col(x) for x in X]
    medians = materialise(_binned(twice, columns, 0.5, "med"), "mcd-medians")
    off = [F.abs(F.col(f"x{i}") - F.col("med")[i]) for i in DIMENSIONS]
    spreads = _binned(_with(rows, medians, few), off, 0.5, "mad")
    diagonal = medians.join(spreads, "g").select(
        "g", F.lit(0).alias("k"), *(F.col("med")[i].alias(f"m{i}") for i in DIMENSIONS), *((1.4826 * F.col("mad")[i] + FLOORS[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS)
    ).withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in DIMENSIONS), F.lit(0.0)))
    parts = _from_moments(twice.where("part < 2").groupBy("g", (F.col("part") + 1).cast("int").alias("k")).agg(*_moments()), 1.0)
    return diagonal.unionByName(parts)


def _concentrated(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every group and start: bins of the distance, their moments, and those up to the border."""
    at = F.floor(F.log(_mahalanobis() + 1e-3) * DISTANCE_BINS).cast("bigint")
    bins = _with(rows, estimate, few).withColumn("bin", at).groupBy("g", "k", "bin").agg(*_moments())
    run = Window.partitionBy("g", "k").orderBy("bin")
    before = F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nearest = bins.withColumn("__before", before).withColumn("__all", F.sum("n").over(Window.partitionBy("g", "k"))).where(F.col("__before") < H * F.col("__all"))
    sums = nearest.groupBy("g", "k").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in DIMENSIONS), *(f"s{i}{j}" for i, j in PAIRS))))
    return _from_moments(sums, CONSISTENCY)


def _shrunk(best: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each group's estimate mixed with that of all rows, by rows of the group against ``SHRINK``."""
    whole = best.where(F.col("g") == EVERYTHING).select(F.col("g").alias("w"), *(F.col(c).alias(f"w{c}") for c in (*M, *L)))
    both = best.where(F.col("g") != EVERYTHING).join(sizes, "g").withColumn("w", F.when(F.col("n") > 0, F.lit(EVERYTHING))).join(F.broadcast(whole), "w")  # one row
    share = F.col("n") / (F.col("n") + SHRINK)

    def scatter(prefix: str, i: int, j: int) -> Column:
        return sum((F.col(f"{prefix}l{i}{k}") * F.col(f"{prefix}l{j}{k}") for k in range(j + 1)), F.lit(0.0))

    mixed = {(i, j): share * scatter("", i, j) + (1 - share) * scatter("w", i, j) for i, j in PAIRS}
    centre = [(share * F.col(f"m{i}") + (1 - share) * F.col(f"wm{i}")).alias(f"m{i}") for i in DIMENSIONS]
    return _factored(both.select("g", *centre, *(mixed[p].alias(f"c{p[0]}{p[1]}") for p in PAIRS)), {p: F.col(f"c{p[0]}{p[1]}") for p in PAIRS}, ["g"]).drop("det")


def judge(counts: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``counts`` (a materialised :func:`text_counts` table) with ``distance`` and ``kept``.

    ``distance`` is null where the base rule failed.
    """
    named = [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")) for c in group]
    own = F.concat_ws("\x1f", *named)
    vectors = [v.alias(f"x{i}") for i, v in enumerate(statistics())]
    part = F.pmod(31 * F.col("n_words") + F.col("word_chars"), F.lit(PARTS)).cast("int")
    rows = materialise(counts.where(~F.col("base_failed")).select(own.alias("g"), part.alias("part"), *vectors), "mcd-rows")
    sizes = materialise(rows.groupBy("g").agg(F.count("*").alias("n")), "mcd-sizes")
    few = sizes.count() * 3 <= BROADCAST_ESTIMATES
    estimate = materialise(_starts(rows, few).withColumn("settled", F.lit(False)), "mcd-start")
    for _ in range(MAX_STEPS):
        going = estimate.where(~F.col("settled"))
        last = going.select("g", "k", F.col("det").alias("__det"))
        after = _concentrated(rows, going.select("g", "k", *M, *L), few).join(F.broadcast(last) if few else last, ["g", "k"])
        after = after.withColumn("settled", F.abs(F.col("det") - F.col("__det")) < SETTLED).drop("__det")
        estimate = materialise(after.unionByName(estimate.where("settled")), "mcd-step")
        if not estimate.where(~F.col("settled")).limit(1).count():
            break
    best = estimate.groupBy("g").agg(F.min_by(F.struct(*M, *L), F.struct(F.round("det", 9), "k")).alias("e")).select("g", "e.*")
    final = materialise(_shrunk(best, sizes), "mcd-estimate")
    given = [c for c in counts.columns if c not in ("distance", "kept")]
    judged = (
        counts.select(*given, own.alias("g"), *vectors)
        .join(F.broadcast(final) if few else final, "g", "left")
        .withColumn("distance", F.when(~F.col("base_failed"), _mahalanobis()))
    )
    return judged.select(*given, "distance", (~F.col("base_failed") & (F.col("distance") <= CUT)).alias("kept"))


def reject_outliers(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(materialise(text_counts(docs), "text-counts"))


def _oracle() -> str:
    """The same counts, starts, steps and cut as SQL (steps after the last change change nothing)."""
    d = list(DIMENSIONS)
    xs, ms, ls = ", ".join(X), ", ".join(M), ", ".join(L)

    def spread(rows: str, values: list[str], name: str) -> str:
        long = " UNION ALL ".join(f"SELECT g, {i} AS d, CAST(round(({v}) * {VALUE_BINS}) AS BIGINT) AS bin FROM {rows}" for i, v in zip(d, values, strict=True))
        least = (
            "SELECT g, d, min(bin) AS bin FROM (SELECT g, d, bin, sum(count(*)) OVER (PARTITION BY g, d ORDER BY bin) AS run, sum(count(*)) OVER (PARTITION BY g, d) AS n "
            f"FROM ({long}) GROUP BY g, d, bin) WHERE run >= 0.5 * n GROUP BY g, d"
        )
        return f"SELECT g, {', '.join(f'max(CASE WHEN d = {i} THEN bin / {float(VALUE_BINS)} END) AS {name}{i}' for i in d)} FROM ({least}) GROUP BY g"

    def mahalanobis() -> str:
        z: list[str] = []
        for i in d:
            z.append(f"((x{i} - m{i}" + "".join(f" - l{i}{j} * {z[j]}" for j in range(i)) + f") / l{i}{i})")
        return " + ".join(f"{v} * {v}" for v in z)

    def factor(scatter: str) -> str:
        """Columns l00.. as aliases that build on each other."""
        out = []
        for i, j in PAIRS:
            left = scatter.format(i=i, j=j) + "".join(f" - l{i}{c} * l{j}{c}" for c in range(j))
            out.append(f"sqrt(greatest({left}, {FLOORS[i] ** 2 / 4})) AS l{i}{j}" if i == j else f"({left}) / l{j}{j} AS l{i}{j}")
        return ", ".join(out)

    means = ", ".join([f"sum(x{i}) / count(*) AS m{i}" for i in d] + [f"sum(x{i} * x{j}) / count(*) AS s{i}{j}" for i, j in PAIRS])

    det = " + ".join(f"2 * ln(l{i}{i})" for i in d)

    def estimate(rows: str, consistency: float) -> str:
        floored = ", ".join(f"{consistency} * (s{i}{j} - m{i} * m{j}) + {FLOORS[i] ** 2 if i == j else 0.0} AS c{i}{j}" for i, j in PAIRS)
        return f"SELECT *, {det} AS det FROM (SELECT g, k, {ms}, {factor('c{i}{j}')} FROM (SELECT g, k, {ms}, {floored} FROM (SELECT g, k, {means} FROM {rows} GROUP BY g, k)))"

    diagonal = ", ".join(f"1.4826 * mad{i} + {FLOORS[i]} AS l{i}{j}" if i == j else f"0.0 AS l{i}{j}" for i, j in PAIRS)
    steps = [
        f"est0 AS MATERIALIZED (SELECT *, {det} AS det, false AS settled FROM (SELECT g, 0 AS k, {', '.join(f'med{i} AS m{i}' for i in d)}, {diagonal} FROM med JOIN mad USING (g) "
        f"UNION ALL SELECT g, k, {ms}, {ls} FROM ({estimate('(SELECT *, part + 1 AS k FROM rows WHERE part < 2)', 1.0)})))"
    ]
    for t in range(1, MAX_STEPS + 1):
        far = f"SELECT r.g, e.k, {xs}, CAST(floor(ln({mahalanobis()} + 1e-3) * {DISTANCE_BINS}) AS BIGINT) AS bin FROM rows r JOIN est{t - 1} e ON r.g = e.g WHERE NOT e.settled"
        border = f"SELECT g, k, bin, sum(count(*)) OVER (PARTITION BY g, k ORDER BY bin) - count(*) AS before, sum(count(*)) OVER (PARTITION BY g, k) AS n FROM far{t} GROUP BY g, k, bin"
        steps.append(f"far{t} AS MATERIALIZED ({far})")
        steps.append(f"near{t} AS MATERIALIZED (SELECT f.* FROM far{t} f JOIN ({border}) b ON f.g = b.g AND f.k = b.k AND f.bin = b.bin WHERE b.before < {H} * b.n)")
        steps.append(
            f"est{t} AS MATERIALIZED (SELECT n.*, abs(n.det - e.det) < {SETTLED} AS settled FROM ({estimate(f'near{t}', CONSISTENCY)}) n JOIN est{t - 1} e ON e.g = n.g AND e.k = n.k "
            f"UNION ALL SELECT g, k, {ms}, {ls}, det, settled FROM est{t - 1} WHERE settled)"
        )
    ranked = f"SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(det, 9), k) AS nth FROM est{MAX_STEPS}"
    whole = ", ".join(f"w.{c} AS w{c}" for c in (*M, *L))
    product = lambda p, i, j: " + ".join(f"{p}l{i}{k} * {p}l{j}{k}" for k in range(j + 1))
    mixed = ", ".join([f"share * m{i} + (1 - share) * wm{i} AS z{i}" for i in d] + [f"share * ({product('', i, j)}) + (1 - share) * ({product('w', i, j)}) AS c{i}{j}" for i, j in PAIRS])
    return f"""WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c > 1) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN repeated r ON r.doc_id = s.doc_id LEFT JOIN dup d ON d.doc_id = s.doc_id
), judged AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('s' || lang, 'n') || chr(31) || coalesce('s' || source, 'n') AS own, (31 * n_words + word_chars) % {PARTS} AS part,
         ln(1 + n_words) AS x0, ln(word_chars / nullif(n_words, 0)) AS x1, sqrt(n_symbols / nullif(word_chars, 0)) AS x2, ln(1 + n_dup_lines) AS x3, n_repeat_words / nullif(n_words, 0) AS x4
  FROM counts
), rows AS MATERIALIZED (
  SELECT unnest([own, chr(29)]) AS g, part, {xs} FROM judged WHERE NOT base_failed
), med AS MATERIALIZED ({spread("rows", X, "med")}),
mad AS MATERIALIZED ({spread("(SELECT r.*, " + ", ".join(f"med{i}" for i in d) + " FROM rows r JOIN med USING (g))", [f"abs(x{i} - med{i})" for i in d], "mad")}),
{", ".join(steps)},
best AS (SELECT * FROM ({ranked}) WHERE nth = 1),
joint AS (SELECT b.g, {", ".join(f"b.{c}" for c in (*M, *L))}, {whole}, s.n / (s.n + {SHRINK}) AS share FROM best b JOIN (SELECT g, count(*) AS n FROM rows GROUP BY g) s ON s.g = b.g, best w WHERE w.g = chr(29) AND b.g <> chr(29)),
final AS MATERIALIZED (SELECT g, {", ".join(f"z{i} AS m{i}" for i in d)}, {factor("c{i}{j}")} FROM (SELECT g, {mixed} FROM joint))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {mahalanobis()} <= {CUT} AS kept
FROM judged j LEFT JOIN final e ON e.g = j.own"""


ORACLE = _oracle()
