"""URL identity as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that never name a page, and keys that name a page of a listing.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "yclid", "_ga", "ref", "source"]
PAGINATION_PARAMS = ["page", "p", "paged", "offset"]
TELEGRAM_HOSTS = ["t.me", "telegram.me"]
BILL_HOST = "sozd.duma.gov.ru"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _SCHEME, 1))


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), _SCHEME, "")


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(_rest(url), r"^//([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path without ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(_rest(url), r"^//[^/?#]*", ""), r"^[^?#]*", 0), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    # Form encoding that leaves ~ and escapes *.
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _key(pair: Column) -> Column:
    return _decoded(F.substring_index(pair, "=", 1))


def _pairs(q: Column) -> Column:
    return F.filter(F.split(q, "&", -1), lambda p: p != "")


def _value(pair: Column) -> Column:
    return F.when(F.contains(pair, F.lit("=")), _decoded(F.regexp_replace(pair, r"^[^=]*=", ""))).otherwise(F.lit(""))


def _rebuilt(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(_key(p)), F.lit("="), _encoded(_value(p)))), "&")


def _clean_path(p: Column) -> Column:
    one = F.regexp_replace(F.when(p == "", F.lit("/")).otherwise(p), r"/{2,}", "/")
    return F.when(one == "/", one).otherwise(F.regexp_replace(one, r"/+$", ""))


def _join(s: Column, n: Column, p: Column, q: Column) -> Column:
    return F.concat(s, F.lit("://"), n, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalize_url(url: Column) -> Column:
    """Canonical spelling of an absolute link; empty for anything but http(s); null stays null."""
    kept = F.filter(_pairs(query(url)), lambda p: ~F.lower(_key(p)).isin(TRACKING_PARAMS))
    return F.when(scheme(url).isin("http", "https"), _join(scheme(url), netloc(url), _clean_path(path(url)), _rebuilt(kept))).when(url.isNotNull(), F.lit(""))


def resolve_url(base: Column, link: Column) -> Column:
    """``link`` against ``base`` (dot segments of a relative path are resolved), natively."""
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(_rest(base), r"^//([^/?#]*)", 1))
    base_path = F.regexp_extract(F.regexp_replace(_rest(base), r"^//[^/?#]*", ""), r"^[^?#]*", 0)
    link = F.trim(link)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    tail = F.regexp_extract(link, r"[?#].*$", 0)
    raw = F.regexp_replace(link, r"[?#].*$", "")
    full = F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(folder, raw))
    parts = F.split(F.regexp_replace(full, r"^/", ""), "/", -1)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part)),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    resolved = F.regexp_replace(F.concat(F.lit("/"), F.array_join(walked, "/"), ends), r"/{2,}$", "/")
    return (
        F.when(link.rlike(_SCHEME), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("?")), F.concat(origin, base_path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(F.concat(origin, resolved, tail))
    )


def source_identity(link: Column) -> Column:
    """One identity per address whatever its case, ``www.``, slash or tracking keys; other schemes lower-cased."""
    known = normalize_url(link)
    return F.when(known != "", F.regexp_replace(known, r"^(https?://)www\.", "$1")).otherwise(F.lower(F.trim(link)))


def listing_identity(url: Column) -> Column:
    """Identity of a listing: page keys and blank values dropped."""
    known = normalize_url(url)
    kept = F.filter(_pairs(query(known)), lambda p: ~F.lower(_key(p)).isin(PAGINATION_PARAMS) & (_value(p) != ""))
    return F.when(known == "", F.lit("")).otherwise(_join(scheme(known), netloc(known), path(known), _rebuilt(kept)))


def is_pagination(url: Column) -> Column:
    return F.exists(_pairs(query(url)), lambda p: F.lower(_key(p)).isin(PAGINATION_PARAMS) & (_value(p) != ""))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/", -1), lambda x: x != ""))


def host_matches(url: Column, allowed: list[str], seed: Column | None = None) -> Column:
    """Same site: an allowed domain (default: the seed's host) or a subdomain of one."""
    own = bare_host(url)
    wanted = [F.lit(d.strip().lower().removeprefix("www.")) for d in allowed if d.strip()] or [bare_host(seed)]
    out = F.lit(False)
    for d in wanted:
        out = out | (own == d) | F.endswith(own, F.concat(F.lit("."), d))
    return out


def is_telegram(link: Column) -> Column:
    return (scheme(link) == "tg") | host(link).isin(TELEGRAM_HOSTS)


def source_link_valid(link: Column) -> Column:
    return F.coalesce((normalize_url(link) != "") | is_telegram(link), F.lit(False))


def bill_url(url: Column) -> Column:
    """Canonical address of a bill card; null where the address isn't allowed."""
    number = F.regexp_extract(F.trim(url), r"^(?i:https)://(?i:sozd\.duma\.gov\.ru)/bill/(\d+-\d+)/?$", 1)
    return F.when(number != "", F.concat(F.lit(f"https://{BILL_HOST}/bill/"), number))


def bill_download_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https)://(?i:sozd\.duma\.gov\.ru)/(download|s3files)/"), F.lit(False))
