from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, html, scoring, text, urls


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("HTTPS://Paper.Test/a/b/?gclid=1&q=two+words&fbclid=2", "https://paper.test/a/b?q=two+words"),
        ("ftp://paper.test/file", ""),
        ("javascript:void(0)", ""),
        ("http://paper.test//deep///path/;v=2?empty=&k=%C3%A9", "http://paper.test/deep/path?empty=&k=%C3%A9"),
        ("https://paper.test?x=1#part", "https://paper.test/?x=1"),
    ],
)
def test_normalize_url(spark, link, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=link) == want
    assert html.canonical(link) == want


def test_both_canonical_forms_agree(spark, sf):
    """The function that reads links inside pages and the column function, over all links of the pages."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    links = sorted({x for r in pages for x in [r.url, *re.findall(r'href="([^"]*)"', r.html)]}) + ["?utm_source=a&b=1", "//x.test/Y/", "a;b/c;d", "#top"]
    frame = spark.createDataFrame([(x,) for x in links], "u string")
    base = "https://base.test/dir/page?x=1"
    got = {r.u: r.n for r in frame.select("u", urls.normalize_url(urls.resolve_url(F.lit(base), F.col("u"))).alias("n")).collect()}
    assert got == {x: html.canonical(x, base) for x in links}


def test_identity_of_a_source(spark):
    same = {one(spark, urls.source_identity(F.col("u")), u=u) for u in ("http://WWW.Daily.test/", "http://daily.test", "http://www.daily.TEST/?utm_campaign=z")}
    assert len(same) == 1
    assert one(spark, urls.source_identity(F.col("u")), u="TG://resolve?domain=Some_Channel") == "tg://resolve?domain=some_channel"


def test_pages_of_one_listing(spark):
    listing = lambda u: one(spark, urls.listing_identity(F.col("u")), u=u)
    assert listing("https://daily.test/all?paged=7&tag=x") == listing("https://daily.test/all?tag=x&offset=20") == "https://daily.test/all?tag=x"
    assert one(spark, urls.is_pagination(F.col("u")), u="https://daily.test/all?p=4") and not one(spark, urls.is_pagination(F.col("u")), u="https://daily.test/all?tag=4")
    hosts = lambda u: one(spark, urls.host_matches(F.col("u"), ["daily.test"]), u=u)
    assert hosts("https://blogs.daily.test/1") and hosts("https://daily.test") and not hosts("https://notdaily.test/1") and not hosts("https://daily.test.evil.test/")


@pytest.mark.parametrize(("link", "want"), [("../b?x=1", "https://e.test/b?x=1"), ("/c", "https://e.test/c"), ("//f.test/d", "https://f.test/d"), ("g", "https://e.test/a/g"), ("https://h.test/", "https://h.test/")])
def test_resolve_url(spark, link, want):
    assert one(spark, urls.resolve_url(F.lit("https://e.test/a/i.html"), F.col("u")), u=link) == want


def test_bill_urls(spark):
    check = lambda u: one(spark, urls.bill_url(F.col("u")), u=u)
    assert check("https://sozd.duma.gov.ru/bill/77001-9/") == check("https://sozd.duma.gov.ru/bill/77001-9") == "https://sozd.duma.gov.ru/bill/77001-9"
    for bad in ("ftp://sozd.duma.gov.ru/bill/77001-9", "https://example.test/bill/77001-9", "https://sozd.duma.gov.ru.example.test/bill/77001-9", "https://sozd.duma.gov.ru/calendar"):
        assert check(bad) is None


def _score(spark, rules):
    got = spark.range(1).select(scoring.score(rules).alias("s")).first().s
    return round(got.value, 6), set(got.fired)


def test_article_and_hub_rules(spark):
    none = F.lit(None).cast("string")
    told = F.lit("https://daily.test/news/2025/11/07/river-bridge-reopens-after-two-years-of-repair")
    value, fired = _score(spark, scoring.article_rules(told, none))
    assert {"article_path", "date_in_path", "long_slug"} <= fired and value > 0.5
    value, fired = _score(spark, scoring.article_rules(F.lit("https://daily.test/contacts"), F.lit("")))
    assert value < 0.18
    assert _score(spark, scoring.hub_rules(told, F.lit(""), F.lit("")))[0] < _score(spark, scoring.hub_rules(F.lit("https://daily.test/news"), F.lit(""), F.lit("")))[0]
    assert "dated_cards" in _score(spark, scoring.hub_rules(F.lit("https://daily.test/q"), F.lit(""), F.lit("11.12.2023, then 12.12.2023, then 2022")))[1]


@pytest.mark.parametrize(("impact", "urgency", "want"), [(0, 0, scoring.LOW), (1, 0, "релевантно"), (2, 0, "важно"), (2, 3, "важно"), (3, 0, "требует внимания")])
def test_categories(spark, impact, urgency, want):
    value = scoring.relevance(F.lit(impact), F.lit(urgency), F.lit(2), F.lit(0.0))
    assert one(spark, scoring.category(value)) == want


def test_urgency_counts_from_impact_two(spark):
    value = lambda i, u: one(spark, scoring.relevance(F.lit(i), F.lit(u), F.lit(2), F.lit(0.0)))
    assert value(1, 3) == value(1, 0) and value(2, 3) > value(2, 0)


def test_text(spark):
    assert text.like_pattern("5_0%\\x") == "%5\\_0\\%\\\\x%"
    assert one(spark, text.hashtags(F.col("t")), t="#мост opens #tram_2 and #мост") == ["мост", "tram_2"]
    assert one(spark, text.word_count(F.col("t")), t="She’d seen a two-way street; да") == 6
    assert one(spark, text.first_sentence(F.col("t")), t="\n Is it so? Yes.") == "Is it so?"
    assert one(spark, text.strip_html(F.col("t")), t="<i>x</i> &lt; y<br>\n\tz") == "x < y z"
    assert one(spark, text.unfence_json(F.col("t")), t='Here: ```\n{"k": [1]}\n``` done') == '{"k": [1]}'
    assert {"-old", "+new"} <= set(one(spark, text.text_diff(F.lit("same\nold"), F.lit("same\nnew"))).split("\n"))


def test_printed_dates_match_a_general_parser():
    """What a general date parser reads of the same print, in many prints of many days."""
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    from dateutil import parser

    today = datetime(2025, 6, 1)
    for k in range(0, 800, 37):
        day = datetime(2023, 11, 5, 4, 6, 9) + timedelta(days=k, minutes=k * 11)
        for form in ("%Y-%m-%d", "%Y/%m/%d %H:%M", "%d %B %Y %H:%M:%S", "%B %d, %Y", "%b %d, %Y %I:%M %p", "%a, %d %b %Y %H:%M:%S GMT", "%Y-%m-%dT%H:%M:%S+05:00", "%Y-%m-%dT%H:%M:%SZ", "%H:%M"):
            print_ = day.strftime(form)
            want = parser.parse(print_, default=today)
            want = want if want.tzinfo else want.replace(tzinfo=ZoneInfo(dates.MOSCOW))
            assert dates.parse_printed(print_, today=today) == want, print_
        month = dates.RU_MONTH_NAMES[day.month - 1]
        for print_ in (f"Размещено {day.day} {month} {day.year} в {day:%H:%M}", f"{day.day} {month.upper()} {day.year}, {day:%H:%M} МСК", f"{day:%d.%m.%Y %H:%M}", f"{day:%d.%m.%Y} | {day:%H:%M} MSK"):
            assert dates.parse_printed(print_).replace(tzinfo=None) == day.replace(second=0), print_
    assert dates.parse_printed("7 июня", today=today).date() == datetime(2025, 6, 7).date() and dates.parse_printed("07.06", today=today).day == 7
    for nothing in (None, "", " \n", "no day at all", "99.99.2024", "31.04.2024"):
        assert dates.parse_printed(nothing) is None


def test_iso_dates_are_moscows(spark):
    got = lambda v: one(spark, dates.iso_date(F.col("v")).cast("timestamp_ntz"), v=v)
    assert got("2024-05-06T10:00:00") == datetime(2024, 5, 6, 7) and got("2024-05-06") == datetime(2024, 5, 5, 21)
    assert got("2024-05-06T10:00:00Z") == datetime(2024, 5, 6, 10) and got("2024-05-06T10:00:00+05:00") == datetime(2024, 5, 6, 5) and got("soon") is None


def signal(spark, page):
    return tuple(one(spark, html.publication_date(F.col("h")), h=page))


def test_date_cascade(spark):
    work = '<script type="application/ld+json">{"@graph": [{"@type": "Organization"}, {"@type": "BlogPosting", "datePublished": "2025-02-03", "name": "Named"}]}</script>'
    og, time = '<meta property="article:published_time" content="2025-02-04">', '<time datetime="2025-02-06">x</time>'
    meta = '<meta name="publish-date" content=" 2025-02-05 ">'
    assert signal(spark, time + meta + og + work) == ("2025-02-03", "json_ld", 0.99)
    assert signal(spark, time + meta + og) == ("2025-02-04", "open_graph", 0.98)
    assert signal(spark, time + meta) == ("2025-02-05", "meta", 0.93)
    assert signal(spark, "<time>2020-01-01</time>" + time) == ("2025-02-06", "time_element", 0.88)
    assert signal(spark, "<div><p class=x>as of 9 мая 2025 it was so</p></div>") == (None, None, 0.0)
    near = '<main><h1>Head</h1><p class="posted-on">9 мая 2025</p></main><div class="popular"><time class="published">1 мая 2019</time></div>'
    assert signal(spark, near) == ("9 мая 2025", "visible_dom", 0.94)
    assert one(spark, html.html_metadata(F.col("h")), h=work) == {"schema_type": "BlogPosting", "title": "Named", "jsonld_date_published": "2025-02-03"}
    first = '<html lang="de"><meta name="twitter:title" content="Tags win"><link rel="shortlink canonical" href=" https://x.test/c ">' + work
    assert one(spark, html.html_metadata(F.col("h")), h=first) == {"schema_type": "BlogPosting", "title": "Tags win", "jsonld_date_published": "2025-02-03", "language": "de", "canonical_url": "https://x.test/c"}
    assert one(spark, html.html_metadata(F.col("h")), h="<script type='application/ld+json'>{broken</script>") == {}


def test_listing_page(spark):
    page = (
        '<nav><a href="/menu/entry/with/a/long/label">A label of the menu, long enough</a></nav><ul><li><a href="story-1">The bridge is open again</a> <b>07.11.2025 08:15</b></li>'
        '<li><a href="story-2?utm_source=z">A town builds its first tram</a><time datetime="2025-11-06T10:00:00Z"></time></li><li><a href="story-1">The bridge, told twice over</a></li></ul><a href="?page=2">Older posts</a><a href="?page=2">2</a>'
    )
    base = F.lit("https://daily.test/all/")
    found = one(spark, html.listing_cards(F.col("h"), base, 0.0), h=page)
    assert [c.url for c in found] == ["https://daily.test/menu/entry/with/a/long/label", "https://daily.test/all/story-1", "https://daily.test/all/story-2"]
    assert [c.title for c in found][1:] == ["The bridge is open again", "A town builds its first tram"]
    assert (found[1].published_at.day, found[1].published_at.hour, found[2].published_at.hour) == (7, 5, 10)
    assert one(spark, html.next_listing_page(F.col("h"), base), h=page) == "https://daily.test/all?page=2"
    twice = '<a href="/x/promo-2024">Short label here</a><a href="/x/promo-2024">A much longer headline of the same page</a><a href="/x/promo-2024">And a third one that comes too late</a>'
    assert [(c.title, c.published_at) for c in one(spark, html.listing_cards(F.col("h"), base), h=twice)] == [("A much longer headline of the same page", None)]
    day = one(spark, html.listing_cards(F.col("h"), base, 0.0, today="2023-05-01"), h='<p>7 ноября <a href="/news/1">Dated without a year</a></p>')
    assert (day[0].published_at.year, day[0].published_at.month) == (2023, 11)
    for nothing in ("", "<a>", '<a href="mailto:x@y.test">A long enough label</a>'):
        assert one(spark, html.listing_cards(F.col("h"), base), h=nothing) == [] and one(spark, html.next_listing_page(F.col("h"), base), h=nothing) is None
    shot = one(spark, html.listing_snapshot(F.col("h"), F.lit("https://daily.test/all/")), h=page)
    assert [c.url for c in shot.cards] == ["https://daily.test/all/story-1", "https://daily.test/all/story-2", "https://daily.test/all/story-1"]
    assert [tuple(p) for p in shot.pagination] == [("https://daily.test/all?page=2", "Older posts")] and "menu" not in shot.page_text


def test_bill_card():
    file = lambda day, label, link: f'<div class="oz_event" data-eventdate="{day}"><a class="a_event_files" href="{link}">{label}<b class="format-msword"></b></a></div>'
    stage = lambda code, name, inside: f'<div id="{code}" class="x root-stage"><div class="ttl"><a class="lnk">{name}</a></div>{inside}</div>'
    head = '<b id="number_oz_id">Bill 77001-9</b><h2 id="oz_name">On bridges</h2><p id="oz_name_comment">(tolls)</p><div id="bh_histras"><div id="oz_stages">{}</div></div>'
    early = stage("arrh_d2", "Tabled", file("2025-03-01", "Текст внесенного законопроекта", "/f/1") + file("2025-03-09", "Справка", "/f/2"))
    late = stage("arrh_d5", "Second reading", file("2025-04-02T10:00:00", "Текст законопроекта ко второму чтению", "/f/3"))
    got = html.bill(head.format(early + late + stage("arrh_d6", "Next", "")), "https://bills.test/b/77001-9")
    assert (got["bill_number"], got["title"], got["stage"], got["stage_code"], got["document_url"]) == ("77001-9", "On bridges (tolls)", "Second reading", "arrh_d5", "https://bills.test/f/3")
    assert got["published_at"] is None and (got["updated_at"].month, got["updated_at"].day) == (4, 2)
    assert html.bill(head.format(stage("arrh_d2", "Tabled", "")), "u")["error"] == "no dated stage"
    assert html.bill(head.format(stage("arrh_d2", "Tabled", file("2025-03-09", "Справка", "/f/2"))), "u")["error"] == "no text document"
    assert html.bill(None, None)["error"] == "no bill card"


def test_containers():
    words = " ".join(["word"] * 100)
    page = f"<body><nav><a href=x>n</a></nav><article><p>{words}</p><aside>ad</aside></article></body>"
    assert html.choose_container(page)["selector"] == "article"
    assert html.body(page, "article", "", 80) == words
    assert html.body("<article>short</article>", "article", "fall\n\n\n\nback") == "fall\n\nback"


def test_words_of_every_document(spark, tmp_path):
    from tidewire.plans.catalog import QUERIES

    rows = [(1, "plain words here.", 3), (2, None, 0), (3, "", 0), (4, "don't stop; 24-hour e-mail\t№ 7", 5), (5, "cafe\u0301 ok (x_y)", 3), (6, "- ' #tag", 1)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["word_count"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.words for r in got} == {i: n for i, _, n in rows}
