from __future__ import annotations

import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import models
from tidewire.operators import acts
from tidewire.operators.feed import CARD
from tidewire.plans.api import ActDesk, ConflictError, NewsDesk, NotFoundError, SourceDesk, seed
from tidewire.sources import feeds
from tidewire.sources.pdf import pdf_text

SOURCES = "id bigint, name string, link string, type string, poll_interval_seconds int, is_enabled boolean, is_relevant boolean"


def source_desk(spark):
    rows = [(1, "Daily", "https://daily.test", "rss", 300, True, True), (2, "Old", "https://old.test", "web", 300, False, False)]
    return SourceDesk(spark.createDataFrame(rows, SOURCES), spark.createDataFrame([(1, 1, "https://daily.test/b"), (2, 1, "https://daily.test/a")], "id bigint, source_id bigint, url string"))


def test_sources(spark):
    desk = source_desk(spark)
    assert desk.get(1).first().feeds == ["https://daily.test/a", "https://daily.test/b"]
    new = lambda *links: spark.createDataFrame([(10 + k, f"n{k}", x, None, None, True, True, k == 0) for k, x in enumerate(links)], SOURCES + ", has_feed boolean")
    after = desk.create(new("https://new.test", "https://t.me/channel"))
    assert {(r.id, r.type, r.poll_interval_seconds) for r in after.sources.collect()} >= {(10, "rss", 300), (11, "telegram", None)}
    with pytest.raises(ConflictError):
        desk.create(new("HTTPS://WWW.Daily.test/"))
    with pytest.raises(ConflictError):
        desk.create(new("https://x.test", "https://www.x.test"))
    with pytest.raises(ValueError, match="address"):
        desk.create(new("mailto:a@b.test"))
    assert desk.update(1, {"name": "Renamed", "poll_interval_seconds": "60"}).get(1).select("name", "poll_interval_seconds", "link").first() == ("Renamed", 60, "https://daily.test")
    with pytest.raises(ConflictError):
        desk.update(2, {"is_enabled": "true"})
    for missing in (lambda: desk.get(9), lambda: desk.update(9, {}), lambda: desk.delete(9, desk.feeds)):
        with pytest.raises(NotFoundError):
            missing()
    news = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, source_id bigint")
    left, kept = desk.delete(1, news)
    assert [r.id for r in left.sources.collect()] == [2] and left.feeds.count() == 0 and [r.id for r in kept.collect()] == [2]
    assert sorted(r.id for r in seed(desk.sources, [(2, "Again", "u", "web", 1, True, True), (3, "Seed", "v", "web", 1, True, True)]).collect()) == [1, 2, 3]


def test_addresses_of_sources(spark):
    desk = source_desk(spark)
    one = lambda d, k=1: d.get(k).first()
    for taken in ("https://old.test", "HTTPS://WWW.Old.test/"):
        with pytest.raises(ConflictError):
            desk.update(1, {"link": taken})
    for wrong in ("mailto:x", "nothing"):
        with pytest.raises(ValueError, match="address"):
            desk.update(1, {"link": wrong})
    with pytest.raises(ValueError, match="can't be set"):
        desk.update(1, {"type": "web"})
    same = one(desk.update(1, {"link": "https://www.daily.test/"}))
    assert (same.link, same.type, same.feeds) == ("https://www.daily.test/", "rss", ["https://daily.test/a", "https://daily.test/b"])
    moved = desk.update(1, {"link": "https://next.test", "name": "Next"}, [f"https://next.test/{k % 12}" for k in range(24)])
    assert (one(moved).link, one(moved).type, one(moved).name, one(moved).poll_interval_seconds) == ("https://next.test", "rss", "Next", 300)
    assert one(moved).feeds == sorted(f"https://next.test/{k}" for k in range(10)) and moved.feeds.select("id").distinct().count() == 10
    assert (one(desk.update(1, {"link": "https://next.test"})).type, one(desk.update(1, {"link": "https://next.test"})).feeds) == ("web", [])
    channel = one(desk.update(1, {"link": "https://t.me/channel"}, ["https://t.me/feed"]))
    assert (channel.type, channel.poll_interval_seconds, channel.feeds) == ("telegram", None, [])
    # The verdict on an old address goes with it, and so does its switching off; a switch that was sent counts.
    back = one(desk.update(2, {"link": "https://better.test"}), 2)
    assert (back.is_relevant, back.is_enabled) == (True, True)
    assert one(desk.update(2, {"link": "https://better.test", "is_enabled": "false"}), 2).is_enabled is False
    for still in ({"is_enabled": "true"}, {"is_enabled": "true", "link": "https://www.old.test"}):
        with pytest.raises(ConflictError):
            desk.update(2, still)


def test_acts(spark):
    at = datetime(2024, 1, 2)
    registry = spark.createDataFrame([(1, "https://sozd.duma.gov.ru/bill/1-8", "T", at, None, at)], "id bigint, url string, title string, source_updated_at timestamp_ntz, last_checked_at timestamp_ntz, created_at timestamp_ntz")
    versions = spark.createDataFrame([(1, 1, at, "a"), (1, 2, datetime(2024, 2, 1), "b")], "act_id bigint, version_id bigint, source_updated_at timestamp_ntz, stage_code string")
    desk = ActDesk(registry, versions)
    assert [v.stage_code for v in desk.get(1).first().versions] == ["b", "a"] and desk.list().count() == 1
    with pytest.raises(NotFoundError):
        desk.get(5)
    bill = lambda u: spark.createDataFrame([(u, "arrh_d11")], "url string, stage_code string")
    assert desk.register(bill("https://sozd.duma.gov.ru/bill/2-8/")).select("url", "tracking_status").first() == ("https://sozd.duma.gov.ru/bill/2-8", "published")
    with pytest.raises(ConflictError):
        desk.register(bill("https://sozd.duma.gov.ru/bill/1-8/"))
    with pytest.raises(ValueError, match="bill"):
        desk.register(bill("https://x.test/bill/1-8"))
    seen = spark.createDataFrame([(1, "New", datetime(2024, 3, 1)), (7, "No", at)], "id bigint, title string, source_updated_at timestamp_ntz")
    got = acts.mark_checked(registry, seen, F.lit(datetime(2024, 4, 1)).cast("timestamp_ntz")).collect()
    assert [tuple(r) for r in got] == [(1, "https://sozd.duma.gov.ru/bill/1-8", "New", datetime(2024, 3, 1), datetime(2024, 4, 1), at)]


def test_news_cards_and_escalation(spark, sf):
    desk = NewsDesk.over_test_tables(spark, sf)
    cards = desk.cards()
    assert tuple(cards.columns) == CARD and cards.count() == desk.news.count()
    ranked = cards.where("relevance IS NOT NULL").first()
    assert ranked.relevance.cluster_id == (ranked.event_cluster_id if ranked.event_cluster_id is not None else ranked.id)
    with pytest.raises(NotFoundError):
        desk.get_news(-1)
    item, made = desk.news.where("NOT is_alert").first().id, []
    flagged = desk.escalate(item, lambda row: made.append(row.first().id))
    assert made == [item] and flagged.where(F.col("id") == item).first().is_alert and flagged.count() == desk.news.count()
    with pytest.raises(ConflictError):
        desk.escalate(desk.news.where("is_alert").first().id, made.append)

    def refuses(row):
        raise OSError("no")

    with pytest.raises(OSError, match="no"):
        desk.escalate(item, refuses)


def test_vectors_in_order():
    v = lambda x: [float(x)] * 3
    assert models.in_order([(1, v(1)), (0, v(0)), (None, v(2))], 3, 3) == [v(0), v(1), v(2)]
    for bad, n in (([(0, v(0)), (0, v(1))], 2), ([(0, v(0))], 2), ([(2, v(0))], 1), ([(0, [1.0])], 1)):
        with pytest.raises(ValueError, match="vector"):
            models.in_order(bad, n, 3)


def test_company_context(spark):
    profiles = spark.createDataFrame([(1, "Acme", "Makes things."), (2, "Solo", "Alone.")], "company_id bigint, name string, description string")
    told = spark.createDataFrame([(1, 2, "Tolls", "Fees.", None), (1, 1, "Bridges", "Steel.", "Only large ones.")], "company_id bigint, facet_id bigint, name string, description string, guidance string")
    got = {r.company_id: r.context for r in models.company_context(profiles, told).collect()}
    assert got[1] == "Company: Acme\nMakes things.\nRelevance facets:\n- Bridges: Steel.\n  Guidance: Only large ones.\n- Tolls: Fees."
    assert got[2] == "Company: Solo\nAlone.\nRelevance facets:"


def pdf(objects: dict[int, bytes]) -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + b"trailer << /Root 1 0 R >>"


def packed(data: bytes, more: bytes = b"") -> bytes:
    raw = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(raw), more, raw)


def test_pdf_text(spark):
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfrange <0001> <0003> <0410> <0010> <0011> [<0421> <0422>] endbfrange 1 beginbfchar <0020> <0020> endbfchar"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        4: packed(rb"BT /F1 12 Tf 72 700 Td (First \(line\) \101) Tj 0 -14 Td [(spl) 20 (it) -300 (words)] TJ T* /F2 9 Tf <000100020003002000100011> Tj ET % (no)"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        7: packed(cmap),
        8: packed(b"9 0 10 46 << /Type /Page /Parent 2 0 R /Contents 11 0 R >>".ljust(60) + b"<< /Nothing true >>", b"/Type /ObjStm /N 2 /First 10"),
        11: b"<< /Length 48 >>\nstream\n" + b"BT /F1 9 Tf 1 0 0 1 5 5 Tm (Second page) Tj ET".ljust(48) + b"\nendstream",
    }
    file = pdf(objects)
    want = "First (line) A\nsplit words\nАБВ СТ\nSecond page"
    assert pdf_text(file) == want
    assert pdf_text(file.replace(b"FlateDecode", b"DCTDecode  ")) is None  # its page tree has no text streams left
    for broken in (None, b"", b"%PDF-1.4", file[:300], b"%PDF" + bytes(range(256)) * 20):
        assert pdf_text(broken) is None
    rows = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(b"junk")), (3, None)], "id int, content binary")
    got = {r.id: (r.kind, r.text) for r in feeds.documents(rows).collect()}
    assert got[1] == ("pdf", want) and got[2] == ("docx", None) and got[3][1] is None
