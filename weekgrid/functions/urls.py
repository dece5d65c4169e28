"""URL forms of feeds: canonical form, candidates, host guesses, public-address policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null, extract, let
from weekgrid.functions.text import slugify

# Query keys kept on a search endpoint, besides the switcher.
SEARCH_KEYS = ("lat_val", "long_val", "geo_width_km", "venue_types")
SEARCH_QUERY = "client_interface/json/?switcher=GetSearchResults"
ROOT_HINT = "(?i)bmlt|main_server"
INFO_QUERY = "client_interface/json/?switcher=GetServerInfo"
# Endpoint paths tried on a host, in order.
FEED_PATHS = (
    "/wp-admin/admin-ajax.php?action=meetings",
    "/?tsml-feed=1",
    "/?post_type=tsml_meeting&feed=tsml",
    "/wp-json/tsml/v1/meetings",
    "/api/meetingguide",
    "/api/meetingguide/",
    "/api/meetingguide.json",
    "/meetings.json",
)
# Host hints of region and fellowship.
GB_HOSTS = ("london", "glasgow", "edinburgh")
CA_HOSTS = ("toronto", "vancouver", "calgary", "ottawa", "montreal", "edmonton", "winnipeg", "victoriaaa")
NA_HOST = r"\bna[-.]|narcotics|bmlt"
CA_HOST = r"\bca[-.]|cocaineanonymous|ca4la|cauk|georgiaca"
# Blocked host suffixes.
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost")

URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]+)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?\s*$"


def url_parts(url: Column) -> Column:
    """{scheme, user, host, port, path, query}; null for text that is no absolute URL.

    Scheme and host are lower-cased, default ports dropped, an empty path is '/'.
    """

    def group(at: int) -> Column:
        return F.regexp_extract(url, URL, at)

    scheme = F.lower(group(1))
    default = ((scheme == "https") & (group(4) == "443")) | ((scheme == "http") & (group(4) == "80"))
    return F.when(
        url.rlike(URL),
        F.struct(
            scheme.alias("scheme"),
            group(2).alias("user"),
            F.lower(group(3)).alias("host"),
            F.when(~default, group(4)).otherwise("").alias("port"),
            F.when(group(5) == "", "/").otherwise(group(5)).alias("path"),
            group(6).alias("query"),
        ),
    )


def _origin(parts: Column, host: Column) -> Column:
    user = F.when(parts["user"] != "", F.concat(parts["user"], F.lit("@"))).otherwise("")
    port = F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise("")
    return F.concat(parts["scheme"], F.lit("://"), user, host, port)


def query_value(query: Column, key: str) -> Column:
    return extract(query, rf"[?&]{key}=([^&#]*)")


def canonical_url(url: Column) -> Column:
    """One spelling per feed: no www., fragment or trailing slash, only the known query keys."""

    def rebuild(parts: Column) -> Column:
        host = F.regexp_replace(parts["host"], r"^www\.", "")
        trims = (
            parts["path"].endswith("/")
            & (parts["path"] != "/")
            & ~F.contains(parts["path"], F.lit("/client_interface/"))
        )
        path = F.when(trims, F.regexp_replace(parts["path"], "/$", "")).otherwise(parts["path"])
        is_ajax = path.endswith("/wp-admin/admin-ajax.php") & (query_value(parts["query"], "action") == "meetings")
        is_search = F.contains(path, F.lit("/client_interface/json")) & (
            query_value(parts["query"], "switcher") == "GetSearchResults"
        )
        kept = [
            F.concat(F.lit(f"&{key}="), query_value(parts["query"], key)) for key in SEARCH_KEYS
        ]
        query = (
            F.when(is_ajax, F.lit("?action=meetings"))
            .when(is_search, F.concat_ws("", F.lit("?switcher=GetSearchResults"), *kept))
            .otherwise(parts["query"])
        )
        return F.concat(_origin(parts, host), path, query)

    return F.coalesce(let(url_parts(url), rebuild), url)


def _with_slash(root: Column) -> Column:
    return F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))


def search_url(root: Column) -> Column:
    return F.concat(_with_slash(root), F.lit(SEARCH_QUERY))


def info_url(root: Column) -> Column:
    return F.concat(_with_slash(root), F.lit(INFO_QUERY))


def host_candidates(host: Column) -> Column:
    """The endpoint URLs worth trying on a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^https?://", ""), "/.*$", "")
    return F.array(*[F.concat(F.lit("https://"), bare, F.lit(path)) for path in FEED_PATHS])


def fallback_urls(url: Column) -> Column:
    """Other addresses of a failing feed, canonical, without the address itself."""

    def build(parts: Column) -> Column:
        origin = _origin(parts, parts["host"])
        folder = _with_slash(parts["path"])
        query = F.when(parts["query"] == "", "?switcher=GetSearchResults").otherwise(parts["query"])
        served = F.array(F.concat(origin, folder, F.lit("index.php"), query))
        rooted = F.array(F.concat(origin, folder, F.lit(SEARCH_QUERY)))
        urls = (
            F.when(F.contains(parts["path"], F.lit("/client_interface/")), served)
            .when(F.concat(parts["host"], parts["path"]).rlike(ROOT_HINT), rooted)
            .otherwise(host_candidates(parts["host"]))
        )
        return F.array_distinct(F.transform(urls, canonical_url))

    parts = url_parts(url)
    served = F.contains(parts["path"], F.lit("/client_interface/"))
    rooted = ~served & F.concat(parts["host"], parts["path"]).rlike(ROOT_HINT)
    others = F.filter(let(parts, build), lambda u: rooted | (u != canonical_url(url)))
    return F.when(parts.isNotNull(), others).otherwise(F.array().cast("array<string>"))


def guess_region(host: Column) -> Column:
    def has(*names: str) -> Column:
        return host.rlike("|".join(names))

    return (
        F.when(host.endswith(".uk") | has(*GB_HOSTS), "GB")
        .when(host.endswith(".ie"), "IE")
        .when(host.endswith(".eu"), "EU")
        .when(host.endswith(".au"), "AU")
        .when(host.endswith(".nz"), "NZ")
        .when(host.endswith(".za"), "ZA")
        .when(has(*CA_HOSTS), "CA")
        .otherwise("US")
    )


def guess_fellowship(host: Column, hinted: Column | None = None) -> Column:
    hint = F.lit(None).cast("string") if hinted is None else hinted
    return (
        F.when(hint.isin("aa", "na", "ca"), hint)
        .when(host.rlike(NA_HOST), "na")
        .when(host.rlike(CA_HOST), "ca")
        .otherwise("aa")
    )


def host_slug(url: Column) -> Column:
    return slugify(F.regexp_replace(url_parts(url)["host"], r"^www\.", ""))


# --- public-address policy -----------------------------------------------------------------


def is_private_ipv4(address: Column) -> Column:
    octets = F.transform(F.split(address, r"\."), lambda o: o.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    reserved = (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | (a >= 224)
    )
    malformed = (F.size(octets) != 4) | F.exists(octets, lambda o: o.isNull())
    return F.coalesce(malformed | reserved, F.lit(True))


def is_private_address(address: Column) -> Column:
    """Private or reserved IP literal; IPv4 inside IPv6 is judged as IPv4."""
    text = F.lower(address)
    dotted = extract(text, r":ffff:(\d+\.\d+\.\d+\.\d+)$")
    pattern = r":ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    high = F.conv(extract(text, pattern, 1), 16, 10).try_cast("int")
    low = F.conv(extract(text, pattern, 2), 16, 10).try_cast("int")
    mapped = F.when(
        high.isNotNull() & low.isNotNull(),
        F.format_string(
            "%d.%d.%d.%d",
            F.shiftright(high, 8),
            high.bitwiseAND(F.lit(255)),
            F.shiftright(low, 8),
            low.bitwiseAND(F.lit(255)),
        ),
    )
    inner = F.coalesce(dotted, mapped)
    v6 = text.isin("::", "::1") | text.rlike("^(fc|fd|fe[89ab])")
    return (
        F.when(F.contains(text, F.lit(":")) & inner.isNotNull(), is_private_ipv4(inner))
        .when(F.contains(text, F.lit(":")), v6)
        .otherwise(is_private_ipv4(text))
    )


def url_problem(url: Column) -> Column:
    """Why a feed URL is refused; null when it may be fetched (names are not resolved here)."""

    def judge(parts: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(parts["host"], r"\.$", ""), r"^\[|\]$", "")
        suffixed = host.rlike("(" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + ")$")
        is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(host, F.lit(":"))
        return (
            F.when((parts["scheme"] != "https") | (parts["user"] != "") | (parts["port"] != ""), "not public https")
            .when((host == "localhost") | suffixed, "private host")
            .when(is_ip & is_private_address(host), "private address")
        )

    return (
        F.when(F.length(url) > 2048, "too long")
        .when(url_parts(url).isNull(), "invalid")
        .otherwise(let(url_parts(url), judge))
    )


def path_of(url: Column) -> Column:
    return blank_null(url_parts(url)["path"])


def resolve(href: Column, page: Column) -> Column:
    """Absolute form of a link found on a page; null when the page itself has no URL."""

    def build(parts: Column) -> Column:
        origin = _origin(parts, parts["host"])
        folder = F.regexp_replace(parts["path"], "[^/]*$", "")
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(parts["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("#") | href.startswith("?"), F.concat(origin, parts["path"], href))
            .otherwise(F.concat(origin, folder, F.regexp_replace(href, r"^(\./)+", "")))
        )

    return F.when(url_parts(page).isNotNull(), let(url_parts(page), build))
