"""Legislative acts: pages, versions, change detection, the tracking state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.merge import first_by

#: The stage that means publication, and the message for an unchanged text.
PUBLISHED_STAGE = "arrh_d11"
NO_TEXT_CHANGE = "Этап рассмотрения изменился, но текст законопроекта не изменился."
PAGE_DEFAULT, PAGE_MAX = 50, 500


def page(registry: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX} and offset 0 or more")
    return registry.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def search(registry: DataFrame, term: str) -> DataFrame:
    """Acts whose title, number or stage holds the term, latest change first."""
    text = F.lower(F.concat_ws(" ", "title", "bill_number", "stage"))
    return registry.where(F.contains(text, F.lit(term.strip().lower()))).orderBy(F.desc(F.coalesce("source_updated_at", "updated_at")), "id")


def versions(acts: DataFrame, act_id) -> DataFrame:
    return acts.where(F.col("act_id") == act_id).orderBy(F.desc("source_updated_at"), "version_id")


def first_versions(acts: DataFrame) -> DataFrame:
    return first_by(acts, ["act_id"], F.col("source_updated_at"), F.col("version_id"))


def changes(acts: DataFrame) -> DataFrame:
    """Each version against the one before: first, unchanged, changed, and whether the text differs."""
    w = Window.partitionBy("act_id").orderBy("version_id")
    before = acts.withColumns({"__stage": F.lag("stage_code").over(w), "__document": F.lag("document_url").over(w), "__text": F.lag("text").over(w), "__n": F.row_number().over(w)})
    changed = ~(F.col("stage_code").eqNullSafe(F.col("__stage")) & F.col("document_url").eqNullSafe(F.col("__document")))
    kind = F.when(F.col("__n") == 1, "first").when(changed, "changed").otherwise("unchanged")
    message = F.when((kind == "changed") & F.col("text").eqNullSafe(F.col("__text")), NO_TEXT_CHANGE)
    return before.select("act_id", "version_id", kind.alias("kind"), ((kind == "changed") & ~F.col("text").eqNullSafe(F.col("__text"))).alias("needs_summary"), message.alias("message"))


def states(acts: DataFrame, published: Column) -> DataFrame:
    """The tracking status after each version; published is terminal, later versions are not checked."""
    w = Window.partitionBy("act_id").orderBy("version_id")
    reached = F.max(published.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.max(published.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return acts.select("act_id", "version_id", F.when(reached == 1, "published").otherwise("tracking").alias("status"), (earlier == 0).alias("checked"))


def detail(acts: DataFrame) -> DataFrame:
    """One row per act with its versions, latest first."""
    rows = F.sort_array(F.collect_list(F.struct("source_updated_at", "version_id", "stage_code")), asc=False)
    return acts.groupBy("act_id").agg(F.count("*").alias("n_versions"), F.transform(rows, lambda v: v["stage_code"]).alias("stages"))


def register(acts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """New acts only (a known url is a conflict), with the status their stage gives them."""
    status = F.when(F.col("stage_code") == PUBLISHED_STAGE, "published").otherwise("tracking")
    return snapshots.join(acts.select("url"), "url", "left_anti").withColumn("tracking_status", status)


def apply_updates(acts: DataFrame) -> DataFrame:
    """The current row of each act after all its versions: the last version's fields, the first one's id kept."""
    last = F.max_by(F.struct("version_id", "stage_code", "document_url", "text", "source_updated_at"), "version_id")
    return acts.groupBy("act_id").agg(last.alias("l"), F.count("*").alias("n_versions")).select("act_id", "l.version_id", "l.stage_code", "l.document_url", "l.text", "l.source_updated_at", "n_versions")


def initial_summaries(acts: DataFrame, summary: Column) -> DataFrame:
    """The first version of each act takes the initial summary; others keep theirs."""
    n = F.row_number().over(Window.partitionBy("act_id").orderBy("source_updated_at", "version_id"))
    return acts.withColumn("__n", n).select("act_id", "version_id", F.when(F.col("__n") == 1, summary).alias("summary"), F.when(F.col("__n") == 1, "initial").alias("summary_kind"))


def latest_document(documents: DataFrame) -> DataFrame:
    """Per act the document of the last stage and latest date; the first one listed wins a tie."""
    key = F.struct("stage_index", "event_date", -F.col("pos"))
    return documents.groupBy("act_id").agg(F.max_by("document_url", key).alias("document_url"))


def mark_checked(registry: DataFrame, snapshots: DataFrame, checked_at: Column) -> DataFrame:
    """Acts that a check found unchanged: only title, source date and the check's time are taken from ``(id, title, source_updated_at)``."""
    seen = snapshots.select("id", F.col("title").alias("__title"), F.col("source_updated_at").alias("__at"), F.lit(True).alias("__seen"))
    joined = registry.join(seen, "id", "left")

    def after(new: Column, old: str) -> Column:
        return F.when(F.col("__seen"), new).otherwise(F.col(old)).alias(old)

    own = {"title": after(F.col("__title"), "title"), "source_updated_at": after(F.col("__at"), "source_updated_at"), "last_checked_at": after(checked_at, "last_checked_at")}
    return joined.select(*(own.get(c, F.col(c)) for c in registry.columns))
