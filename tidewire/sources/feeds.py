"""RSS and Atom bodies to entries, channel messages to records, office documents to text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import batches
from tidewire.functions.text import _stripped, hashtags
from tidewire.sources.pdf import pdf_text

ENTRY = "array<struct<url:string,title:string,summary:string,published_at:timestamp,updated_at:timestamp,tags:array<string>>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _moment(value: str | None) -> datetime | None:
    if not value or not value.strip():
        return None
    for read in (parsedate_to_datetime, lambda v: datetime.fromisoformat(v.replace("Z", "+00:00"))):
        try:
            found = read(value.strip())
            return found.astimezone(UTC) if found.tzinfo else found.replace(tzinfo=UTC)
        except (ValueError, TypeError):
            continue
    return None


def _link(entry: ElementTree.Element) -> str:
    links = [e for e in entry if _local(e.tag) == "link"]
    best = next((e for e in links if e.get("rel", "alternate") == "alternate"), links[0] if links else None)
    return ((best.get("href") or best.text or "") if best is not None else "").strip()


def read_feed(body: str | None) -> list[dict]:
    """Entries that have a link: published falls back to updated; updated stays only if it differs; tags once, in order."""
    if not body or not body.strip():
        return []
    try:
        root = ElementTree.fromstring(body.strip())
    except ElementTree.ParseError:
        return []
    out = []
    for entry in root.iter():
        if _local(entry.tag) not in ("item", "entry"):
            continue
        first: dict[str, str] = {}
        for e in entry:
            first.setdefault(_local(e.tag), "".join(e.itertext()))
        updated = _moment(first.get("updated") or first.get("modified"))
        published = _moment(first.get("pubdate") or first.get("published") or first.get("date") or first.get("issued")) or updated
        terms = [(e.get("term") or "".join(e.itertext())).strip() for e in entry if _local(e.tag) in ("category", "subject")]
        url = _link(entry)
        if url:
            out.append({
                "url": url, "title": _stripped(first.get("title", "")), "summary": _stripped(first.get("description") or first.get("summary") or first.get("content") or ""),
                "published_at": published, "updated_at": None if updated == published else updated, "tags": list(dict.fromkeys(t for t in terms if t)),
            })
    return out


def feed_entries(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of every feed body, with its place in the feed (``entry_pos``)."""
    batches.bound()

    @F.pandas_udf(ENTRY)
    def read(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield batch.map(read_feed)

    rest = [c for c in bodies.columns if c != body]
    return bodies.select(*rest, F.posexplode(read(F.col(body))).alias("entry_pos", "e")).select(*rest, "entry_pos", "e.*")


def merge_feeds(entries: DataFrame) -> DataFrame:
    """A url of several feeds of a source is kept once: the first feed's first entry."""
    from tidewire.operators.merge import first_by

    return first_by(entries, ["source_id", "url"], F.col("feed_pos"), F.col("entry_pos"))


def channel_messages(messages: DataFrame) -> DataFrame:
    """Channel messages ``(channel, channel_id, message_id, caption, text, date, edit_date)`` as flat records."""
    text = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    public = F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("message_id").cast("string"))
    private = F.concat(F.lit("https://t.me/c/"), F.regexp_replace(F.col("channel_id").cast("string"), "^-100", ""), F.lit("/"), F.col("message_id").cast("string"))
    return messages.select(
        F.when(F.col("channel").isNotNull(), public).otherwise(private).alias("url"),
        F.left(F.regexp_extract(F.trim(text), r"^[^\n]*", 0), F.lit(255)).alias("title"),
        text.alias("text"), hashtags(text).alias("tags"), F.col("date").alias("published_at"), F.col("edit_date").alias("updated_at"),
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs, then tables (cells joined by `` | ``), blanks dropped; None where there is no readable text."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return None
    top = root.find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    lines = [words(p) for p in (top.findall(f"{_W}p") if top is not None else [])]
    for row in (r for t in (top.findall(f"{_W}tbl") if top is not None else []) for r in t.findall(f"{_W}tr")):
        lines.append(" | ".join(c for c in ("\n".join(filter(None, map(words, cell.findall(f"{_W}p")))) for cell in row.findall(f"{_W}tc")) if c))
    return "\n".join(x for x in lines if x) or None


def document_kind(content: Column) -> Column:
    """``pdf`` by its first bytes, else ``docx``."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").otherwise("docx")


def documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Files (``binaryFile`` rows) with ``kind`` and their ``text``: Word files, and PDF files that aren't scans."""
    batches.bound()

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: pdf_text(v) if v is not None and v[:4] == b"%PDF" else docx_text(v))

    return files.withColumn("kind", document_kind(F.col(content))).withColumn("text", read(F.col(content)))
