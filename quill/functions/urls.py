"""URL column functions: canonical keys, scope predicates and link resolution, all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PARAMETERS = ("sid", "session", "utm_source", "utm_medium", "utm_campaign", "ref", "source")
INDEX_DOCUMENTS = (
    "index.html", "index.htm", "index.php", "index.aspx", "index.jsp",
    "index.shtml", "default.html", "default.htm", "default.aspx", "default.php",
)
SECOND_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au",
    "co.jp", "or.jp", "ne.jp", "com.br", "com.mx", "co.nz", "co.in",
    "co.kr", "com.tr", "com.ar", "com.cn", "com.sg", "co.za",
)
SHARED_HOST_SUFFIXES = (
    "github.io", "gitlab.io", "readthedocs.io", "netlify.app", "vercel.app",
    "pages.dev", "web.app", "firebaseapp.com", "appspot.com", "herokuapp.com",
    "azurewebsites.net", "azurestaticapps.net", "cloudfront.net", "blogspot.com",
    "gitbook.io", "onrender.com", "fly.dev", "surge.sh", "bitbucket.io",
)
BINARY_EXTENSIONS = (
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".mp4", ".mp3", ".avi", ".mov", ".mkv", ".webm",
    ".exe", ".dmg", ".pkg", ".deb", ".rpm",
    ".xls", ".xlsx", ".ppt", ".pptx", ".doc", ".docx",
)
NON_PAGE_SCHEMES = ("mailto:", "tel:", "javascript:", "#", "data:")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HAS_EXTENSION = r"[^/]*[^./][^/]*\.[^./]*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def strip_www(host: Column) -> Column:
    """One leading ``www.`` folded away."""
    return F.regexp_replace(host, r"^www\.", "")


def extension(p: Column) -> Column:
    """Lower-case extension of a path with its dot, '' without one; leading dots of a name don't count."""
    return F.lower(F.regexp_extract(p, r"[^/]*[^./][^/]*(\.[^./]*)$", 1))


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(q: Column) -> Column:
    """The query without tracking parameters: blanks kept, values encoded anew, repeated names together where the first stood."""
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda x: x != ""),
        lambda x: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1)).alias("k"),
            F.when(F.instr(x, "=") > 0, F.coalesce(F.try_url_decode(F.substring(x, F.instr(x, "=") + 1, F.length(x))), F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise("").alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*TRACKING_PARAMETERS))
    names = F.array_distinct(F.transform(kept, lambda x: x["k"]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda x: x["k"] == n)))
    return F.array_join(F.transform(grouped, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")


def canonical_path(p: Column) -> Column:
    """A slash after a path without extension, and index documents folded into their directory."""
    p = F.when((p == "") | (~p.rlike(_HAS_EXTENSION) & ~p.endswith("/")), F.concat(p, F.lit("/"))).otherwise(p)
    last = F.lower(F.substring_index(p, "/", -1))
    return F.when(last.isin(*INDEX_DOCUMENTS), F.regexp_replace(p, r"[^/]*$", "")).otherwise(p)


def canonical(url: Column) -> Column:
    """The key under which a crawl visits a URL. Null stays null."""
    s, q = scheme(url), clean_query(query(url))
    head = F.when(s != "", F.concat(s, F.lit(":"))).otherwise("")
    host = strip_www(netloc(url))
    return F.concat(head, F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), canonical_path(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def registrable_root(host: Column) -> Column:
    """The domain that a site may widen to: two labels, three below a listed suffix; an address is its own root."""
    name = F.regexp_replace(host, r":\d*$", "")
    labels, tail = F.split(host, r"\."), F.substring_index(name, ".", -2)
    keep = F.when((F.size(labels) > 2) & tail.isin(*SECOND_LEVEL_SUFFIXES, *SHARED_HOST_SUFFIXES), 3).otherwise(2)
    root = F.array_join(F.slice(labels, -F.least(keep, F.size(labels)), keep), ".")
    return F.when(name.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | name.startswith("["), host).otherwise(root)


def domain_ok(host: Column, base: str, scope: str = "same", allowed: tuple[str, ...] = ()) -> Column:
    """Scope rule of hosts: same site, its subdomains, or a custom list; custom without a list is same."""
    same = strip_www(host) == strip_www(F.lit(base))
    if scope == "subdomains":
        root = registrable_root(F.lit(base))
        return (host == base) | (host == root) | host.endswith(F.concat(F.lit("."), root))
    if scope == "custom" and allowed:
        ok = F.lit(False)
        for d in allowed:
            ok = ok | (host == d) | host.endswith("." + d)
        return ok
    return same


def path_prefixes(values: tuple[str, ...]) -> tuple[str, ...]:
    """Prefixes with a leading slash; blank ones are dropped."""
    return tuple(v if v.startswith("/") else "/" + v for v in map(str.strip, values) if v)


def path_ok(p: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Case-sensitive prefixes; exclusion wins, no inclusion means every path."""
    some = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda x: p.startswith(x))
    inc, exc = path_prefixes(include), path_prefixes(exclude)
    ok = ~some(exc) if exc else F.lit(True)
    return ok & some(inc) if inc else ok


def scope_reason(url: Column, base: str, scope: str = "same", allowed: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Why a URL is refused (scheme, domain, binary, path), or null where it is in scope; checks in that order."""
    host = netloc(url)
    return (
        F.when(~scheme(url).isin("http", "https") | (host == ""), "scheme")
        .when(~domain_ok(host, base, scope, allowed), "domain")
        .when(extension(path(url)).isin(*BINARY_EXTENSIONS), "binary")
        .when(~path_ok(path(canonical(url)), include, exclude), "path")
    )


def is_page_link(href: Column) -> Column:
    """Whether a link leads to a page or file, not to a place on the page or another program."""
    low = F.lower(F.trim(href))
    bad = F.lit(False)
    for s in NON_PAGE_SCHEMES:
        bad = bad | low.startswith(s)
    return ~bad & (low != "")


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a link: absolute, protocol-relative, root-relative, query-only and path-relative forms; dot segments stay."""
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, _PARTS, 2))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def is_internal_ipv4(host: Column) -> Column:
    """Whether a literal IPv4 address isn't a public unicast one. Names and IPv6 give false."""
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b, c = octets[0], octets[1], octets[2]
    literal = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    private = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    return literal & F.coalesce(private, F.lit(False))
