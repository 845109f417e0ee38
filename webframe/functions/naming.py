"""File names and directories for URLs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions import urls as U


def filename(url: Column, index: str = "index.html", alt_char: bool = False) -> Column:
    """Last path part, or ``index``, and the query after ``?`` (``@`` with ``alt_char``)."""
    last = F.regexp_extract(U.path(url), "([^/]*)$", 1)
    q = U.query(url)
    return F.concat(F.when(last == "", index).otherwise(last), F.when(q == "", "").otherwise(F.concat(F.lit("@" if alt_char else "?"), q)))


def dir_parts(url: Column, protocol: bool = False, host: bool = False, alt_char: bool = False) -> Column:
    """array of directories. As the last part goes unless the URL ends with a slash, a URL with a query loses one."""
    parts = F.filter(F.split(U.path(url), "/"), lambda x: x != "")
    head = []
    if protocol:
        head.append(U.scheme(url))
    if host:
        given = F.regexp_extract(url, r"^[^:]+://[^/?#:]*:([0-9]+)", 1)
        head.append(F.when(given == "", U.hostname(url)).otherwise(F.concat(U.hostname(url), F.lit("+" if alt_char else ":"), given)))
    whole = F.concat(F.array(*head), parts) if head else parts
    return F.when(url.endswith("/") | (F.size(whole) == 0), whole).otherwise(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))))


def safe_name(name: str, os_type: str = "unix", no_control: bool = True, ascii_only: bool = True, case: str | None = None, max_length: int | None = None) -> str:
    """A name that is safe on the system: reserved bytes escaped, long names cut and ended by eight digits of SHA-1."""
    reserved = {"unix": b"/", "windows": b'\\|/:?"*<>'}.get(os_type, b"")

    def escape(b: int) -> bool:
        return b in reserved or no_control and (b < 32 or ascii_only and 128 <= b <= 159) or ascii_only and b > 127

    if name in (".", ".."):
        out = "%2E" * len(name)
    else:
        out = b"".join(b"%%%02X" % b if escape(b) else bytes([b]) for b in name.encode()).decode()
    if os_type == "windows" and out[-1:] in (" ", "."):
        out = f"{out[:-1]}%{ord(out[-1]):02X}"
    if max_length and len(out) > max_length:
        out = out[: max(0, max_length - 8)] + hashlib.sha1(out.encode()).hexdigest()[:8]
    return {"lower": out.lower(), "upper": out.upper()}.get(case, out)


def safe_filename(name: Column, **options) -> Column:
    return U.str_udf(lambda x: safe_name(x, **options))(name)


def cap_ascii(name: Column, max_length: int) -> Column:
    """The length cap of safe names in native functions, for names that need no escape."""
    return F.when(F.length(name) > max_length, F.concat(F.substring(name, 1, max(0, max_length - 8)), F.substring(F.sha1(name), 1, 8))).otherwise(name)


def file_path(url: Column, root: str = ".", use_dir: bool = True, cut: int = 0, protocol: bool = False, host: bool = False, index: str = "index.html") -> Column:
    """Root, directories after the first ``cut``, and file name (unescaped)."""
    parts = dir_parts(url, protocol, host)
    dirs = F.slice(parts, cut + 1, F.greatest(F.size(parts) - cut, F.lit(0))) if use_dir else F.array().cast("array<string>")
    name = F.when(U.scheme(url) == "ftp", filename(url, ".listing")).otherwise(filename(url, index))
    return F.array_join(F.concat(F.array(F.lit(root)), dirs, F.array(name)), "/")


def content_disposition(header: Column) -> Column:
    """The file name of a Content-Disposition header; null without one."""
    raw = F.regexp_extract(header, r"(?i)filename\s*=\s*(.+)", 1)
    quoted = F.replace(F.regexp_extract(raw, r"""^(["'])(.+)(?<!\\)\1""", 2), F.lit('\\"'), F.lit('"'))
    return F.when(raw == "", None).when(raw.rlike("""^["']"""), F.nullif(quoted, F.lit(""))).otherwise(F.trim(F.regexp_extract(raw, "^([^;]*)", 1)))


def adjust_extension(path: Column, is_html: Column, is_css: Column) -> Column:
    return F.when(is_html & ~path.rlike(r"(?i)\.html?$"), F.concat(path, F.lit(".html"))).when(is_css & ~is_html & ~path.rlike(r"(?i)\.css$"), F.concat(path, F.lit(".css"))).otherwise(path)
