"""Writes as pure functions ``(current, incoming) -> next``, and the snapshot store that commits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key (the whole row, by the given order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_ignore(current: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """ON CONFLICT DO NOTHING: new keys are added, the first row of each."""
    new = first_by(incoming, [key], *order) if order else incoming.dropDuplicates([key])
    return current.unionByName(new.join(current.select(key), key, "left_anti"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, update: dict[str, Column], guard: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE: ``update`` maps columns to expressions over ``old.x`` and ``new.x``.

    Rows whose ``guard`` is not true stay as they are. ``incoming`` has a key once.
    """
    old, new = current.alias("old"), incoming.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_old, is_new = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    hit = is_old & is_new if guard is None else is_old & is_new & F.coalesce(guard, F.lit(False))

    def value(c: str) -> Column:
        fresh = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        changed = F.when(hit, update[c]).otherwise(F.col(f"old.{c}")) if c in update else F.col(f"old.{c}")
        return F.when(is_old, changed).otherwise(fresh).alias(c)

    return both.select(*(value(c) for c in current.columns))


def upsert_alert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored facts never change; the alert flag may turn on."""
    return upsert(current, incoming, "url", {"is_alert": F.col("old.is_alert") | F.col("new.is_alert")})


def upsert_state(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new summary replaces an incomplete one and resets what was derived from it."""
    nothing = F.lit(None)
    changes = {"summary": F.col("new.summary"), "primary_event_found": F.col("new.primary_event_found"), "embedding": nothing, "event_cluster_id": nothing}
    return upsert(current, incoming, "news_id", changes, F.col("old.summary").isNull() | F.col("old.primary_event_found").isNull())


def upsert_ranking(current: DataFrame, incoming: DataFrame, key: str = "cluster_id") -> DataFrame:
    return upsert(current, incoming, key, {c: F.col(f"new.{c}") for c in current.columns if c != key})


def set_where_null(current: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """A batch update that only fills what is still null; unknown keys change nothing."""
    given = incoming.select(key, F.col(column).alias("__given"))
    return current.join(given, key, "left").withColumn(column, F.coalesce(column, "__given")).select(*current.columns)


def patch(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: ``changes`` has ``key`` and ``fields``, a map of the columns that were sent (as strings, null allowed)."""
    joined = current.join(changes.select(key, "fields"), key, "left")
    types = dict(current.dtypes)

    def value(c: str) -> Column:
        sent = F.coalesce(F.map_contains_key("fields", F.lit(c)), F.lit(False))
        return F.when(sent, F.try_element_at("fields", F.lit(c)).cast(types[c])).otherwise(F.col(c)).alias(c)

    return joined.select(*(F.col(c) if c == key else value(c) for c in current.columns))


def dismiss(news: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The first dismissal's moment stays."""
    chosen = ids.select("id").distinct().withColumn("__chosen", F.lit(True))
    return news.join(chosen, "id", "left").withColumn("dismissed_at", F.when(F.col("__chosen"), F.coalesce("dismissed_at", now)).otherwise(F.col("dismissed_at"))).select(*news.columns)


def restore(news: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = ids.select("id").distinct().withColumn("__chosen", F.lit(True))
    return news.join(chosen, "id", "left").withColumn("dismissed_at", F.when(F.col("__chosen").isNull(), F.col("dismissed_at"))).select(*news.columns)


def cascade_delete(parents: DataFrame, gone: DataFrame, children: list[tuple[str, DataFrame, str, str]], key: str) -> dict[str, DataFrame]:
    """What is left of ``parents`` and of each child ``(name, frame, column, parent)`` after deleting ``gone`` keys.

    ``parent`` names the frame the column refers to: an earlier child or ``""`` for the parents.
    """
    lost = {"": gone.select(key).distinct()}
    left = {"": parents.join(lost[""], key, "left_anti")}
    for name, frame, column, parent in children:
        of = lost[parent].toDF(column)
        lost[name] = frame.join(of, column, "left_semi").select(frame.columns[0]).distinct()
        left[name] = frame.join(of, column, "left_anti")
    return left


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that were sent are deleted, then the sent ones inserted."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)
