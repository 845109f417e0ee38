"""Directory listings: UNIX, MS-DOS, name lists and machine listings, and FTP replies, all as native columns.

A listing is one row, an array of its lines. A line is matched with the grammar of its listing's type: columns, then a
date, with or without a time, then a name. The type, and the order of numbers in dates, are what most of the first lines
speak for; these counts are taken inside the row, so that nothing is shuffled.
"""

from __future__ import annotations

import datetime as dt
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.urls import glob_regex, let

# Names of months and of halves of the day in the languages of common servers, by month.
MONTHS = {
    "jan": 1, "janv": 1, "ene": 1, "sty": 1, "янв": 1, "يناير": 1, "जन": 1, "1月": 1,
    "feb": 2, "fev": 2, "févr": 2, "lut": 2, "февр": 2, "فبراير": 2, "फ़र": 2, "2月": 2,
    "mar": 3, "mars": 3, "märz": 3, "марта": 3, "مارس": 3, "मार्च": 3, "3月": 3,
    "apr": 4, "abr": 4, "avr": 4, "kwi": 4, "апр": 4, "أبريل": 4, "अप्रै": 4, "4月": 4,
    "may": 5, "mai": 5, "maj": 5, "мая": 5, "مايو": 5, "मई": 5, "5月": 5,
    "jun": 6, "juni": 6, "juin": 6, "cze": 6, "июня": 6, "يونيو": 6, "जून": 6, "6月": 6,
    "jul": 7, "juli": 7, "juil": 7, "lip": 7, "июля": 7, "يوليو": 7, "जुला": 7, "7月": 7,
    "aug": 8, "ago": 8, "août": 8, "sie": 8, "авг": 8, "أغسطس": 8, "अग": 8, "8月": 8,
    "sep": 9, "sept": 9, "set": 9, "wrz": 9, "сент": 9, "سبتمبر": 9, "सितं": 9, "9月": 9,
    "oct": 10, "okt": 10, "out": 10, "paź": 10, "окт": 10, "أكتوبر": 10, "अक्टू": 10, "10月": 10,
    "nov": 11, "lis": 11, "нояб": 11, "نوفمبر": 11, "नवं": 11, "11月": 11,
    "dec": 12, "dez": 12, "dic": 12, "déc": 12, "gru": 12, "дек": 12, "ديسمبر": 12, "दिसं": 12, "12月": 12,
}
MORNING = ("am", "a. m", "vorm", "上午", "午前", "पूर्व", "ص")
EVENING = ("pm", "p. m", "nachm", "下午", "午後", "अपर", "م")
#: What the lines of each type of listing look like.
SIGNS = {"unix": "---|r--|rw-|rwx", "msdos": r"<DIR>|^.{0,4}\d\d", "nlst": "^[^ ]+$"}
SAMPLE_LINES = 101

# --- the grammar of dates -----------------------------------------------------------------------------------------


def _spellings(names) -> dict[str, str]:
    """Each name in composed and in decomposed characters."""
    return {unicodedata.normalize(form, n): n for n in names for form in ("NFC", "NFD")} | {n: n for n in names}


def _any_of(names) -> str:
    return "|".join(sorted((n.replace(".", r"\.") for n in _spellings(names)), key=len, reverse=True))


_FLAGS = "(?iu)"
_NAMED = rf"(?:{_any_of(MONTHS)})\p{{L}}*\.?\s{{0,4}}\d{{1,2}}日?(?:\s{{1,4}}\d{{4}}(?![\d:]))?"
_YEAR_FIRST = r"\d{4}[^\d\s]\d{1,2}[^\d\s]\d{1,2}(?!\d)日?"
_NUMBERS = r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?!\d)"
_HALF = _any_of((*MORNING, *EVENING))
_TIME = rf"\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s?(?:{_HALF})(?!\p{{L}}))?"
_DATE = f"(?:{_NAMED}|{_YEAR_FIRST}|{_NUMBERS})"
WHEN = rf"(?:{_DATE}(?:\s+{_TIME})?|{_TIME}\s+{_DATE})"
_UNIX = rf"{_FLAGS}^(?:.* )??([bcdlps-])(\S*)\s.*?(\d+)\s+({WHEN})\s(.*)$"
_MSDOS = r"^\s*(\S+\s+\S+)\s+(<DIR>|[\d,]+)\s+(.*)$"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, _FLAGS + pattern, group), F.lit("")).cast("int")


def _month(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for n, plain in _spellings(MONTHS).items() for x in (n, MONTHS[plain])])
    return F.try_element_at(known, F.lower(name))


def _full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year >= 69, year + 1900).otherwise(year + 2000)


def date_time(text: Column, now: dt.datetime, day_first: Column | bool = True, half_days: Column | bool = True) -> Column:
    """The timestamp of a date with or without a time; null where there is none. A named date without a year is in the
    year that ends ``now``. Of two numbers the first is the day if ``day_first``, or if the second can't be a month;
    halves of the day count if ``half_days``."""
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    iso = lambda k: _number(text, r"(\d{4})[^\d\s](\d{1,2})[^\d\s](\d{1,2})", k)
    num = lambda k: _number(text, r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?!\d)", k)
    named = rf"({_any_of(MONTHS)})\p{{L}}*\.?\s{{0,4}}(\d{{1,2}})日?(?:\s{{1,4}}(\d{{4}})(?![\d:]))?"
    clock = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:\s?({_HALF})(?!\p{{L}}))?"
    month = _month(F.regexp_extract(text, _FLAGS + named, 1))
    half = F.lower(F.regexp_extract(text, _FLAGS + clock, 4))
    hour = F.coalesce(_number(text, clock, 1), F.lit(0))
    late = half.isin(*_spellings(EVENING))
    hour = F.when((half != "") & flag(half_days) & (hour < 13), hour % 12 + F.when(late, 12).otherwise(0)).otherwise(hour)
    at = (hour, F.coalesce(_number(text, clock, 2), F.lit(0)), F.coalesce(_number(text, clock, 3), F.lit(0)))
    make = lambda y, m, d: F.try_make_timestamp(y, m, d, *at)
    this_year = make(F.lit(now.year), month, _number(text, named, 2))
    past = F.when(this_year > F.lit(now).cast("timestamp"), make(F.lit(now.year - 1), month, _number(text, named, 2))).otherwise(this_year)
    swap = flag(day_first) & (num(2) <= 12) | (num(1) > 12)
    numeric = make(_full_year(num(3)), F.when(swap, num(2)).otherwise(num(1)), F.when(swap, num(1)).otherwise(num(2)))
    by_name = F.coalesce(make(_number(text, named, 3), month, _number(text, named, 2)), F.when(_number(text, named, 3).isNull(), past))
    return F.when(iso(1).isNotNull(), make(iso(1), iso(2), iso(3))).when(month.isNotNull(), by_name).otherwise(numeric)


# --- listings -----------------------------------------------------------------------------------------------------


def perm_bits(text: Column) -> Column:
    """``rwxr-x---`` as an integer; 0 if it isn't nine characters."""
    bits = F.lit(0)
    for i, want in enumerate(("r", "w", "xs") * 3):
        bits = bits + F.when(F.substring(text, i + 1, 1).isin(*want), 1 << (8 - i)).otherwise(0)
    return F.when(F.length(text) == 9, bits).otherwise(0)


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: x != "")


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def listing_type(lines: Column) -> Column:
    """unix, msdos, nlst or unknown: what most lines look like; of equal counts the first of these."""
    like = lambda sign: _count(lines, lambda x: x.rlike(sign))
    votes = F.array(*[F.struct(like(sign).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, sign) in enumerate(SIGNS.items())])
    return let(F.array_max(votes), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("unknown"))


def listing_format(lines: Column) -> Column:
    """struct(day_first, half_days): day_first unless more lines have a second number over 12 than a first one."""
    number = lambda x, k: F.coalesce(_number(x, r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](?:\d{4}|\d{2})(?!\d)", k), F.lit(0))
    month_first = _count(lines, lambda x: (number(x, 2) > 12) & (number(x, 1) <= 12)) > _count(lines, lambda x: number(x, 1) > 12)
    halves = _count(lines, lambda x: x.rlike(rf"{_FLAGS}(?:{_HALF})(?!\p{{L}})"))
    return F.struct((~month_first).alias("day_first"), (2 * halves > F.size(lines)).alias("half_days"))


ENTRY = "name string, type string, size long, date timestamp, dest string, perm int"


def _entry(name: Column, kind: Column, size: Column, date: Column, dest: Column, perm: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), size.cast("long").alias("size"), date.alias("date"), dest.cast("string").alias("dest"), perm.cast("int").alias("perm"))


def unix_entry(line: Column, form: Column, now: dt.datetime) -> Column:
    """The entry of a line of ``ls -l``; null where it isn't one."""
    part = lambda k: F.regexp_extract(line, _UNIX, k)
    kind = F.when(part(1) == "d", "dir").when(part(1) == "-", "file").when(part(1) == "l", "symlink").otherwise("other")
    date = date_time(part(4), now, form["day_first"], form["half_days"])

    def named(p: Column) -> Column:
        name, link = F.trim(part(5)), (p["kind"] == "symlink") & part(5).contains(" -> ")
        own = F.when(link, F.substring_index(name, " -> ", 1)).otherwise(name)
        target = F.when(link, F.substr(name, F.length(F.substring_index(name, " -> ", 1)) + 5))
        return F.when(p["date"].isNotNull(), _entry(own, p["kind"], part(3), p["date"], target, perm_bits(part(2))))

    return F.when(line.rlike(_UNIX), let(F.struct(kind.alias("kind"), date.alias("date")), named))


def msdos_entry(line: Column, form: Column, now: dt.datetime) -> Column:
    part = lambda k: F.regexp_extract(line, _MSDOS, k)
    folder, none = part(2) == "<DIR>", F.lit(None)
    date = date_time(part(1), now, form["day_first"], form["half_days"])
    size = F.when(~folder, F.replace(part(2), F.lit(","), F.lit("")))
    return let(date, lambda d: F.when(line.rlike(_MSDOS) & d.isNotNull(), _entry(part(3), F.when(folder, "dir").otherwise("file"), size, d, none, none)))


def entries(text: Column, now: dt.datetime) -> Column:
    """array of ENTRY; null where the type isn't known or a line isn't of it."""
    none = F.lit(None)

    def read(x: Column) -> Column:
        every = lambda f: let(F.transform(x["lines"], lambda line: f(line, x["form"], now)), lambda es: F.when(~F.exists(es, lambda e: e.isNull()), es))
        names = F.transform(x["lines"], lambda line: _entry(line, none.cast("string"), none, none.cast("timestamp"), none, none))
        return F.when(x["kind"] == "unix", every(unix_entry)).when(x["kind"] == "msdos", every(msdos_entry)).when(x["kind"] == "nlst", names)

    def sampled(lines: Column) -> Column:
        return let(F.slice(lines, 1, SAMPLE_LINES), lambda s: F.struct(lines.alias("lines"), listing_type(s).alias("kind"), listing_format(s).alias("form")))

    return let(let(lines_of(text), sampled), read)


def listings(files: DataFrame, key: str, text_col: str, now: dt.datetime) -> DataFrame:
    """The key and ENTRY of each entry of each listing; one that can't be parsed has none."""
    return files.select(key, F.inline(entries(F.col(text_col), now)))


def machine_listing(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds name, type, size and date of a line of facts; lines without a name are dropped."""
    line = F.col(line_col)
    facts = F.transform(F.split(F.substring_index(line, "; ", 1), ";"), lambda f: F.transform(F.split(f, "=", 2), lambda x: F.lower(F.trim(x))))
    get = lambda fs, n: F.get(F.get(F.filter(fs, lambda f: F.get(f, F.lit(0)) == n), F.lit(0)), F.lit(1))
    told = let(facts, lambda fs: F.struct(get(fs, "type").alias("type"), get(fs, "size").cast("long").alias("size"), get(fs, "modify").alias("modify")))
    out = lines.withColumn("name", F.nullif(F.regexp_extract(line, "^.*?; (.*)$", 1), F.lit(""))).filter(F.col("name").isNotNull())
    return out.withColumn("__told", told).withColumns({"type": F.col("__told.type"), "size": F.col("__told.size"), "date": F.try_to_timestamp(F.substring("__told.modify", 1, 14), F.lit("yyyyMMddHHmmss"))}).drop("__told")


def reply(text: Column) -> Column:
    """struct(code, text) of a reply of one or more lines; null if it isn't complete."""
    last = r"(?:^|\n)(\d{3}) ([^\r\n]*)\r?\n?$"
    body = F.array_join(F.transform(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\d{3}[ -]", "")), "\r\n")
    return F.when(text.rlike(last), F.struct(F.regexp_extract(text, last, 1).cast("int").alias("code"), body.alias("text")))


def passive_address(text: Column) -> Column:
    """struct(host, port) of a passive-mode reply."""
    n = lambda k: F.regexp_extract(text, r"\((\d{1,3}),(\d{1,3}),(\d{1,3}),(\d{1,3}),(\d{1,3}),(\d{1,3})\)", k)
    return F.when(n(1) != "", F.struct(F.concat_ws(".", n(1), n(2), n(3), n(4)).alias("host"), (n(5).cast("int") * 256 + n(6).cast("int")).alias("port")))


def command(text: Column) -> Column:
    return F.struct(F.upper(F.regexp_extract(text, r"^(\S+)", 1)).alias("name"), F.regexp_extract(F.regexp_replace(text, r"\r?\n$", ""), r"^\S+ ?(.*)$", 1).alias("argument"))


def children(entries: DataFrame, base_url: Column, pattern: str | None = None) -> DataFrame:
    """URLs of a listing's entries: directories end with a slash; sockets and devices are left out."""
    rows = entries.filter(F.col("type").isNull() | F.col("type").isin("dir", "file", "symlink"))
    if pattern:
        rows = rows.filter(F.col("name").rlike("(?s)^" + glob_regex(pattern) + "$"))
    name = F.when(F.col("type") == "dir", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return rows.withColumn("child_url", F.concat(base_url, name))


def with_parent_entry(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``requests`` (url) with type and permissions from the parent's listing (parent_url, name)."""
    side = entries.select(F.col("parent_url").alias("__p"), F.col("name").alias("__n"), F.col("type").alias("entry_type"), F.col("perm").alias("entry_perm"))
    clean = F.regexp_replace("url", "/$", "")
    return requests.withColumns({"__up": F.regexp_extract(clean, "^(.*/)", 1), "__own": F.regexp_extract(clean, "([^/]*)$", 1)}).join(side, (F.col("__up") == F.col("__p")) & (F.col("__own") == F.col("__n")), "left").drop("__up", "__own", "__p", "__n")
