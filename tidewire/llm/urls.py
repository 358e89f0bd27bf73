"""URL filters by host-suffix and path-prefix expressions (operator 7).

A rule is ``(host, path, verdict)``: it fits its host and all subdomains where
the url's path starts with the rule's; the longest fitting rule wins, at equal
length the one whose text sorts first, then ``allow``. Each url is expanded into
every dot-suffix of its host times every path prefix of a length that some rule
has. An expression's SHA-256 starts with a 32-bit prefix; urls and rules are
joined on that prefix alone, and a match counts only if the full digests agree.

Distinct urls are judged, not rows: a url that a third of the pages share is
expanded once. The rules are broadcast while their counted rows stay within
``max_rules``; beyond it the prefix join is shuffled.

Null urls and urls without ``://`` have an empty host and path; they fit no rule
and get the default verdict. A path of a rule that is empty fits every path.
Rules with a null host or path never fit. Repeated rows are judged alike.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import materialise, small_side

#: The rules of the contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the short hash that urls and rules are joined on.
PREFIX_HEX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of ``(host suffix, path prefix)`` structs: every dot-suffix times every listed length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    )
    wanted = F.array(*(F.lit(n) for n in lengths))
    prefixes = F.transform(F.filter(wanted, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("s"), p.alias("p")))))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """One row per distinct url: ``url, host, path, rule, verdict``. ``rules``: host, path, verdict."""
    known = materialise(
        rules.where("host is not null and path is not null")
        .select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.coalesce("verdict", F.lit(default)).alias("verdict"), _digest(F.col("host"), F.col("path")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)),
        "url-rules",
    )
    # Distinct path lengths of rules: bounded by the longest path, not by the number of rules or urls.
    lengths = sorted(r.n for r in known.select(F.length("rule_path").alias("n")).distinct().collect()) or [0]
    seen = urls.select(F.col(url).alias("url")).distinct()
    host, path = split_url(F.col("url"))
    seen = seen.withColumns({"host": host, "path": path})
    tried = (
        seen.where("host != ''")
        .select("url", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
        .select("url", _digest(F.col("e.s"), F.col("e.p")).alias("url_digest"))
        .withColumn("prefix", F.substring("url_digest", 1, PREFIX_HEX))
    )
    fits = tried.join(small_side(known, max_rules), "prefix").where("digest = url_digest")  # full digests confirm
    best = fits.groupBy("url").agg(
        F.min_by(
            F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"),
            F.struct(-(F.length("rule_host") + F.length("rule_path")), F.concat("rule_host", "rule_path"), F.col("verdict")),
        ).alias("best")
    )
    best = best.withColumnRenamed("url", "__fit")
    return seen.join(best, F.col("url").eqNullSafe(F.col("__fit")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """``key, host, path, rule, verdict`` of every page."""
    judged = judge_urls(pages, rules, url, default, max_rules)
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    return rows.join(judged, F.col("__url").eqNullSafe(F.col("url")), "left").select(key, "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""
