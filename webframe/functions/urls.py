"""URL functions: a full parser for any input, and native columns for canonical URLs.

``url_info`` is an Arrow-batched UDF for any text. :func:`canonical` and :func:`resolved` make canonical URLs: natively
where :func:`is_plain` accepts the URL, on which both agree, and by the full parser elsewhere; workers get nothing but
nulls for plain rows. The other native functions take canonical URLs apart, userinfo and IPv6 addresses included.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from urllib.parse import unquote, urljoin as std_urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default ports, and the bytes that each part of a URL percent-encodes besides those outside 0x20-0x7E.
DEFAULT_PORTS = {"ftp": 21, "gopher": 70, "http": 80, "https": 443, "ws": 80, "wss": 443}
PATH_SET = b' "#<>?`'
PASSWORD_SET = b' "#<>?`/@\\'
USERNAME_SET = b' "#<>?`/@\\:'
QUERY_SET = b'"#<>`'
FRAGMENT_SET = b' "<>`'
QUERY_VALUE_SET = b'"#<>`&+%'
FORBIDDEN_IN_HOST = set("#%/:?@[\\] ")

_PARTS = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
_TABLES: dict[bytes, list[str]] = {}

URL_INFO = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "port" else T.StringType()) for n in ("raw", "scheme", "authority", "path", "query", "fragment", "userinfo", "username", "password", "host", "hostname", "port", "resource", "url", "hostname_with_port")]
)


def percent_encode(text: str, encode_set: bytes = PATH_SET, encoding: str = "utf-8") -> str:
    """Escapes control bytes, bytes beyond ASCII and those of ``encode_set``; existing escapes stay."""
    table = _TABLES.setdefault(encode_set, [])
    if not table:
        table += [f"%{b:02X}" if not 0x20 <= b <= 0x7E or b in encode_set else chr(b) for b in range(256)]
    return "".join(table[b] for b in text.encode(encoding))


def percent_encode_plus(text: str, encode_set: bytes = QUERY_SET, encoding: str = "utf-8") -> str:
    return percent_encode(text, encode_set, encoding).replace(" ", "+")


def percent_decode(text: str, encoding: str = "utf-8") -> str:
    return unquote(text, encoding)


def percent_decode_plus(text: str, encoding: str = "utf-8") -> str:
    return unquote(text.replace("+", " "), encoding)


def uppercase_escapes(text: str) -> str:
    """Upper-cases escapes of two lower-case or decimal digits; mixed-case ones stay as they are."""
    return re.sub("%[a-f0-9]{2}", lambda m: m[0].upper(), text)


def flatten_path(path: str, flatten_slashes: bool = False) -> str:
    """An absolute path without ``.`` and ``..`` segments."""
    kept: list[str] = []
    segments = path.removeprefix("/").split("/")
    for s in segments:
        if s == "..":
            del kept[-1:]
        elif s != "." and (s or not flatten_slashes):
            kept.append(s)
    if not kept or flatten_slashes and not segments[-1]:
        kept.append("")
    return "/" + "/".join(kept)


def _ipv4(host: str) -> str | None:
    number = lambda x: int(x, 16 if x.startswith("0x") else 8 if x.startswith("0") else 10)
    try:
        parts = [number(x) for x in host.split(".")]
        if len(parts) not in (1, 4):
            return None
        value = parts[0] if len(parts) == 1 else sum(p * 256 ** (3 - i) for i, p in enumerate(parts))
        return str(ipaddress.IPv4Address(value))
    except ValueError:
        return None


@lru_cache(4096)
def normalize_hostname(host: str) -> str:
    if host.startswith("["):
        if not host.endswith("]"):
            raise ValueError("bracket isn't closed")
        address = ipaddress.IPv6Address(host[1:-1])
        if address.ipv4_mapped:  # in groups of hexadecimal digits, as all others
            return "::ffff:{:x}:{:x}".format(*divmod(int(address.ipv4_mapped), 1 << 16))
        return address.compressed
    name = (_ipv4(host) or host).encode("idna").decode("ascii").lower()
    name.encode("idna")
    if FORBIDDEN_IN_HOST & set(name):
        raise ValueError("forbidden character in host")
    return name


@lru_cache(4096)
def parse_url(url: str | None, default_scheme: str | None = "http", encoding: str = "utf-8") -> dict | None:
    """The parts of a URL as a dict, path and query in the bytes of ``encoding``; raises ValueError where it can't be one. Other schemes than those with a default
    port are opaque: only raw, scheme and path are set."""
    if url is None:
        return None
    url = url.strip()
    if any(c < " " for c in url):
        raise ValueError("control character")
    scheme, colon, rest = url.partition(":")
    scheme = scheme.lower()
    if not scheme or not (colon or default_scheme):
        raise ValueError("no scheme")
    if not colon:
        scheme, rest = default_scheme, url
    elif default_scheme and ("." in scheme or scheme == "localhost"):
        scheme, rest = default_scheme, f"{scheme}:{rest}"  # a host and port
    out = dict.fromkeys(URL_INFO.names)
    if scheme not in DEFAULT_PORTS:
        return out | {"raw": url, "scheme": scheme, "path": rest, "url": url}
    rest = rest.removeprefix("//")
    authority, path, query, fragment = (x or "" for x in _PARTS.fullmatch(rest).groups())
    userinfo, at, host = authority.partition("@")
    if not at:
        userinfo, host = "", authority
    username, _, password = userinfo.partition(":")
    name, colon, port = (host, "", "") if host.endswith("]") or ":" not in host else host.rpartition(":")
    number = int(port) if colon else 0
    if not 0 <= number <= 65535:
        raise ValueError("port out of range")
    hostname = normalize_hostname(name)
    if not hostname:
        raise ValueError("no host")
    number = number or DEFAULT_PORTS[scheme]
    path = uppercase_escapes(percent_encode(flatten_path("/" + path.removeprefix("/"), True), encoding=encoding))
    query = uppercase_escapes(percent_encode_plus(query, encoding=encoding))
    fragment = uppercase_escapes(percent_encode(fragment, FRAGMENT_SET, encoding))
    username, password = unquote(username), unquote(password)
    user = uppercase_escapes(percent_encode(username, USERNAME_SET)) + (":" + uppercase_escapes(percent_encode(password, PASSWORD_SET)) if password else "")
    shown = f"[{hostname}]" if ":" in hostname else hostname
    with_port = shown if number == DEFAULT_PORTS[scheme] else f"{shown}:{number}"
    full = f"{scheme}://{user + '@' if user else ''}{with_port}{path}{'?' + query if query else ''}"
    return out | dict(
        raw=url, scheme=scheme, authority=authority, path=path, query=query, fragment=fragment, userinfo=userinfo, username=username, password=password,
        host=host, hostname=hostname, port=number, resource=rest[len(authority) :], url=full, hostname_with_port=with_port,
    )


def try_parse_url(url: str | None) -> dict | None:
    try:
        return parse_url(url)
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(URL_INFO)
def url_info(urls: pd.Series) -> pd.DataFrame:
    """The parts of each URL; all null where it is invalid."""
    rows = [try_parse_url(u) or {} for u in urls]
    out = pd.DataFrame(rows, columns=URL_INFO.names, dtype=object)
    out["port"] = out["port"].astype("Int32")
    return out


def with_url_info(df: DataFrame, url_col: str = "url", name: str = "info") -> DataFrame:
    """Adds the parts of each URL: a narrow map, as shuffling URLs to parse each but once would cost more."""
    return df.withColumn(name, url_info(F.col(url_col)))


def to_map(info: Column) -> Column:
    """The parts of a URL (:func:`url_info`) by name, without those it does not have; null of what is no URL."""
    parts = F.array(*[F.struct(F.lit(f.name).alias("key"), info[f.name].cast("string").alias("value")) for f in URL_INFO.fields])
    return F.when(info["url"].isNotNull(), F.map_from_entries(F.filter(parts, lambda p: p["value"].isNotNull())))


@F.pandas_udf(T.StringType())
def _canonical_of_any(urls: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else (try_parse_url(u) or {}).get("url") for u in urls], dtype=object)


@F.pandas_udf(T.StringType())
def _resolved_of_any(pairs: pd.DataFrame) -> pd.Series:
    text = lambda x: x if isinstance(x, str) else None
    joined = (join_url(text(b), text(x)) for b, x in zip(pairs["base"], pairs["link"], strict=True))
    return pd.Series([None if u is None else (try_parse_url(u) or {}).get("url") for u in joined], dtype=object)


@F.pandas_udf(T.StringType())
def urljoin(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([join_url(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def join_url(base: str | None, link: str | None) -> str | None:
    """The link resolved against its base; null where that isn't possible."""
    if base is None or link is None:
        return None
    if link.startswith("//") and len(link) > 2 and base.partition(":")[0]:
        link = f"{base.partition(':')[0]}:{link}"
    try:
        return std_urljoin(base, link)
    except ValueError:
        return None


def str_udf(f):
    """A string function as an Arrow-batched UDF that keeps nulls."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else f(x) for x in s], dtype=object), T.StringType())


# --- native columns -----------------------------------------------------------------------------------------------


_SAFE = r"!$&-;=@-\[\]^_a-z|~"
_LABEL = "[a-z0-9-]{1,63}"
_PLAIN = rf"^https?://(?:{_LABEL}\.)*(?={_LABEL}(?:[:/?#]|$))[0-9-]*[a-z][a-z0-9-]*(:[1-9][0-9]{{0,3}})?(/[{_SAFE}]*)?(\?[{_SAFE}?/]*)?(#[{_SAFE}?/]*)?$"
_DOTS_OR_SLASHES = r"^[^?#]*://[^?#]*(//|/\.\.?(/|[?#]|$))"
_HEXADECIMAL = r"^https?://(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*(?:[:/?#]|$)"


def is_plain(url: Column) -> Column:
    """Whether the URL is canonical but for its fragment, a default port and a missing path, so that native functions
    make it canonical: a name in lower case of labels that aren't all numbers, and only characters that are never escaped."""
    return url.rlike(_PLAIN) & ~url.rlike(_DOTS_OR_SLASHES) & ~url.rlike(_HEXADECIMAL)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tail(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; empty without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise("")


def scheme(url: Column) -> Column:
    return F.when(url.contains(":"), F.lower(F.substring_index(url, ":", 1))).otherwise("")


def _authority(url: Column) -> Column:
    rest = _tail(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "://")
    return F.substring_index(rest, "/", 1)


def _host_and_port(url: Column) -> Column:
    return F.substring_index(_authority(url), "@", -1)


def hostname(url: Column) -> Column:
    return F.lower(let(_host_and_port(url), lambda h: F.when(h.startswith("["), F.substring_index(F.substr(h, F.lit(2)), "]", 1)).otherwise(F.substring_index(h, ":", 1))))


def _given_port(host: Column) -> Column:
    """The port of ``host:port``; null without one."""
    after = F.when(host.startswith("["), _tail(host, "]")).otherwise(host)
    return F.nullif(_tail(after, ":"), F.lit("")).try_cast("int")


def _default_port(name: Column) -> Column:
    default = F.lit(None).cast("int")
    for known, number in DEFAULT_PORTS.items():
        default = F.when(name == known, number).otherwise(default)
    return default


def port(url: Column) -> Column:
    return F.coalesce(_given_port(_host_and_port(url)), _default_port(scheme(url)))


def path(url: Column) -> Column:
    rest = _tail(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "://")
    return let(rest, lambda r: let(F.substr(r, F.length(F.substring_index(r, "/", 1)) + 1), lambda p: F.when(p == "", "/").otherwise(p)))


def query(url: Column) -> Column:
    return _tail(F.substring_index(url, "#", 1), "?")


def fragment(url: Column) -> Column:
    return _tail(url, "#")


def hostname_with_port(url: Column) -> Column:
    """The host, an IPv6 address in brackets, and the port unless it is the scheme's."""

    defaults = [f"{name}:{number}" for name, number in DEFAULT_PORTS.items()]

    def shown(h: Column) -> Column:
        bare = F.lower(F.when(h.startswith("["), F.concat(F.substring_index(h, "]", 1), F.lit("]"))).otherwise(F.substring_index(h, ":", 1)))
        return let(_given_port(h).cast("string"), lambda p: F.when(p.isNull() | F.concat_ws(":", scheme(url), p).isin(*defaults), bare).otherwise(F.concat_ws(":", bare, p)))

    return let(_host_and_port(url), shown)


def _canonical_of_plain(url: Column) -> Column:
    """The URL without its fragment, an empty query and a default port; a missing path is ``/``."""
    asked = F.regexp_replace(F.substring_index(url, "#", 1), r"^([^?]*)\?$", "$1")
    bare = F.regexp_replace(asked, r"^(http://[^/?]*):80(?=[/?]|$)|^(https://[^/?]*):443(?=[/?]|$)", "$1$2")
    return F.regexp_replace(bare, r"^(https?://[^/?]*)(?=\?|$)", "$1/")


def _if_plain(url: Column) -> Column:
    """The canonical URL of a plain one, null of others; ``url`` is evaluated once."""
    return let(url, lambda u: F.when(is_plain(u), _canonical_of_plain(u)))


def canonical(url: Column) -> Column:
    """The canonical URL of any text; null where it can't be one."""
    native = _if_plain(url)
    return F.coalesce(native, _canonical_of_any(F.when(native.isNull(), url)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), hostname_with_port(url))


_ABSOLUTE = "^[a-zA-Z][a-zA-Z0-9+.-]*:"


def join_plain(base: Column, link: Column) -> Column:
    """A root-relative, scheme-relative or absolute link against a plain base; null for other links. A default port of the
    base stays."""
    root = F.substring_index(F.substring_index(F.substring_index(base, "#", 1), "?", 1), "/", 3)
    return F.when(F.rlike(link, F.lit(_ABSOLUTE)), link).when(link.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))


def resolved(base: Column, link: Column) -> Column:
    """The canonical URL of a link in a document at ``base``; null where there is none."""
    native = F.when(is_plain(base), _if_plain(join_plain(base, link)))
    return F.coalesce(native, _resolved_of_any(F.when(native.isNull(), F.struct(base.alias("base"), link.alias("link")))))


def split_path(p: Column) -> Column:
    """struct(dirname, basename)"""
    name = F.substring_index(p, "/", -1)
    return F.struct(F.substr(p, F.lit(1), F.greatest(F.length(p) - F.length(name) - 1, F.lit(0))).alias("dirname"), name.alias("basename"))


def split_query(q: Column, keep_blank: bool = False) -> Column:
    """array<struct<name, value>>; a value is null if there's no equals sign."""
    pair = lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("name"), F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(?s)(.*)$", 1)).alias("value"))
    pairs = F.transform(F.split(q, "&"), pair)
    return pairs if keep_blank else F.filter(pairs, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def query_map(q: Column) -> Column:
    """map<name, array<value>> with plus signs as spaces; names in order of appearance."""
    pairs = split_query(q, True)
    names = F.array_distinct(F.transform(pairs, lambda x: x["name"]))
    values = lambda n: F.transform(F.filter(pairs, lambda x: x["name"] == n), lambda x: F.replace(F.coalesce(x["value"], F.lit("")), F.lit("+"), F.lit(" ")))
    return F.map_from_arrays(names, F.transform(names, values))


def schemes_similar(a: Column, b: Column) -> Column:
    web = ("http", "https")
    return (a == b) | (a.isin(*web) & b.isin(*web))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regex; ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "/_-" else "\\" + c)
        i += 1
    return out


def is_subdir(base: str | Column, test: Column, trailing_slash: bool = False, wildcards: bool = False) -> Column:
    """Whether ``test`` is ``base`` or below. With wildcards, ``base`` is a literal pattern for the whole path."""
    full = lambda x: F.regexp_replace(x, "[^/]*$", "") if trailing_slash else F.when(x.endswith("/"), x).otherwise(F.concat(x, F.lit("/")))
    if wildcards:
        base = base.rpartition("/")[0] + "/" if trailing_slash else base if base.endswith("/") else base + "/"
        return full(test).rlike("(?s)^" + glob_regex(base) + "$")
    return full(test).startswith(full(base if isinstance(base, Column) else F.lit(base)))


# Session identifiers in paths and queries.
PATH_SESSIONS = (r"(?is)^(.*/)\((?:[a-z]\([0-9a-z]{24}\))+\)/([^?]+\.aspx.*)$", r"(?is)^(.*/)\([0-9a-z]{24}\)/([^?]+\.aspx.*)$")
QUERY_SESSIONS = ("jsessionid=[0-9a-zA-Z]{32}", "phpsessid=[0-9a-zA-Z]{32}", "sid=[0-9a-zA-Z]{32}", "ASPSESSIONID[a-zA-Z]{8}=[a-zA-Z]{24}", "cfid=[^&]+&cftoken=[^&]+")


def strip_path_session(p: Column) -> Column:
    for pattern in PATH_SESSIONS:
        p = F.regexp_replace(p, pattern, "$1$2")
    return p


def strip_query_session(q: Column) -> Column:
    for pattern in QUERY_SESSIONS:
        q = F.regexp_replace(q, f"(?is)^(.*){pattern}(?:&(.*))?$", "$1$2")
    return q


def escaped_fragment(url: Column) -> Column:
    """``#!x`` as a query parameter; other URLs without their fragment."""
    f = fragment(url)
    plain = canonical(url)
    glue = F.when(query(url) == "", "?").otherwise("&")
    return F.when(f.startswith("!"), F.concat(plain, glue, F.lit("_escaped_fragment_="), F.substr(f, F.lit(2)))).otherwise(plain)


def rewrite(url: Column, hash_fragment: bool = False, session_id: bool = False) -> Column:
    """Canonical URL after the chosen rewrites; other schemes than http and https stay."""
    out = url
    if session_id:
        q, f = strip_query_session(query(out)), fragment(out)
        out = F.concat(origin(out), strip_path_session(path(out)), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)), F.when(f == "", "").otherwise(F.concat(F.lit("#"), f)))
    out = escaped_fragment(out) if hash_fragment else canonical(out)
    return F.when(scheme(url).isin("http", "https"), out).otherwise(url)
