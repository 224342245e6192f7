"""Links as column expressions: canonical form, looser keys, registrable domain, live marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters and families of them that only track a visit, those that ask for an AMP page,
# host prefixes of other layouts, and labels under which countries register names.
TRACKING = "cmpid fbclid ftag gclid icid igshid mbid mc_cid mc_eid ncid ocid partner smid srnd taid utm_brand utm_campaign utm_content utm_medium utm_name utm_source utm_term".split()
TRACKING_FAMILIES = ("at_", "utm_")
AMP_SWITCHES = "amp outputtype output amp_js_v usqp".split()
LAYOUTS = r"^(www|amp|m|mobile)\."
REGISTRIES = "com co net org gov ac edu ne or".split()
LIVE_PATH = r"(?i)/(live|liveblog)(/|$)"
LIVE_TITLE = r"(?i)(^|\s)live(\s+(updates|blog))?\s*[:|–—]"
MEDIA_TITLE = r"(?i)^\s*(watch|video|listen|live|podcast|in pictures|pictures|photos|gallery)\s*[:|–—-]"
MEDIA_PATH = r"(?i)/(videos?|av|live|podcasts?|audio|gallery)/"

HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.trim(url), HEAD + r"([^/?#]*)", 1), r"^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(authority(url), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), HEAD + r"[^/?#]*([^?#]*)", 1)


def pairs(query: Column) -> Column:
    """Decoded (key, value) of a query string, blank values kept."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("k"), decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")),
    )


def joined(pairs_: Column) -> Column:
    """Form encoding as web forms do it."""
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(pairs_, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def with_query(base: Column, query: Column) -> Column:
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def normalised(url: Column) -> Column:
    """A link in the one form in which equal articles are equal: lower-case host, no default port, user, fragment or tracking, sorted query."""
    port = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    netloc = F.when((port == "") | default, host(url)).otherwise(F.concat(host(url), F.lit(":"), port))
    trimmed = F.when(F.length(path(url)) > 1, F.regexp_replace(path(url), "/+$", "")).otherwise(path(url))
    key = lambda p: F.lower(p["k"])
    family = lambda p: F.exists(F.array(*map(F.lit, TRACKING_FAMILIES)), lambda f: F.startswith(key(p), f))
    kept = F.filter(pairs(F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)), lambda p: ~key(p).isin(TRACKING) & ~family(p))
    return with_query(F.concat(scheme(url), F.lit("://"), netloc, trimmed), joined(F.array_sort(kept)))


def site(host_: Column) -> Column:
    """Registrable domain: three labels under a country's registry label, else two."""
    labels = F.split(F.regexp_replace(F.lower(host_), r"^www\.", ""), r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(REGISTRIES)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(three, 2).otherwise(1)), 3), ".")


def match_key(url: Column) -> Column:
    """A looser key: one article under another scheme, layout host or AMP form."""
    whole = normalised(url)
    netloc = F.regexp_extract(whole, HEAD + r"([^/?#]*)", 1)
    dots = F.length(netloc) - F.length(F.replace(netloc, F.lit(".")))
    bare = F.when(dots > 1, F.regexp_replace(netloc, LAYOUTS, "")).otherwise(netloc)
    segments = F.filter(F.split(F.regexp_replace(path(whole), "/{2,}", "/"), "/"), lambda s: s != "amp")
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.array_join(segments, "/"), r"\.amp$", ""), "/+$", ""), "^/+", "")
    kept = F.filter(pairs(F.regexp_extract(whole, r"\?(.*)$", 1)), lambda p: ~F.lower(p["k"]).isin(AMP_SWITCHES))
    return with_query(F.concat(bare, F.lit("/"), trimmed), joined(kept))


def brand_key(url: Column) -> Column:
    """The looser key with the host reduced to its brand; for links of one publisher."""
    key = match_key(url)
    brand = F.substring_index(site(F.regexp_replace(F.substring_index(key, "/", 1), ":.*$", "")), ".", 1)
    return F.concat(brand, F.lit("/"), F.regexp_replace(key, "^[^/]*/", ""))


def looks_live(url: Column, title: Column, pattern: str | None = None) -> Column:
    live = path(url).rlike(LIVE_PATH) | title.rlike(LIVE_TITLE)
    return live | url.rlike("(?i)" + pattern) if pattern else live


def is_media(url: Column, title: Column, live: Column) -> Column:
    return live | title.rlike(MEDIA_TITLE) | url.rlike(MEDIA_PATH)
