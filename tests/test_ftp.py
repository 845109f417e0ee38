"""Listings and dates by literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webframe.operators import ftp

NOW = dt.datetime(2010, 3, 1, 12, 0)
UNIX = """-rw-r--r--   1 root     other        531 Jan 29 03:26 README
dr-xr-xr-x   2 root     other        512 Apr  8  1994 etc
dr-xr-xr-x   2 root     512 Apr  8  1994 etc
lrwxrwxrwx   1 root     other          7 Jan 25 00:17 bin -> usr/bin
dr-xr-xr-x   2 root  other 512 Apr  8  2004 blah
"""
DOS = "04-27-00  09:09PM       <DIR>          licensed\r\n07-18-00  10:16AM       <DIR>          pub\r\n04-14-00  03:47PM                  589 readme.htm\r\n"
DOS_FILES = "04-27-00  09:09PM               123  licensed.exe\n07-18-00  10:16AM               456  pub.pdf\n04-14-00  03:47PM                  589 readme.htm\n"
DATES = "-rw-r--r--    1 500      500       1558532 Dec 30  2009 2009-12\n-rw-r--r--    1 500      500      10564020 Jan 14  2010 2010-01\n"
MORE = "-rw-r--r--    1 1000     100        242408 Mar 24  2010 english_german.2010-03-24.tar.gz\ndrwxr-xr-x    2 1000     100          4096 Mar 24  2009 old\n"
NAMES = "horse.txt\nfish\ndolphin.jpg\ndelicious cake.wri\negg\n"
MVS = "  WYOSPT 3420   2003/05/21  1  200  FB      80  8053  PS  48-MVS.FILE\n  TSO004 3390   VSAM 50-mvs-file\n"
OTHERS = "brw-rw---- 1 root disk 0 2010-01-02 10:11:12 sda\n-rwsr-xr-x 1 ünï grp 12 März 9 2009 näme  with  blanks\n-rw-r--r-- 1 a b 5 31.12.2009 23:59 x\n"

t = dt.datetime
CASES = {
    UNIX: [
        ("README", "file", 531, t(2010, 1, 29, 3, 26), None, 0o644), ("etc", "dir", 512, t(1994, 4, 8), None, 0o555), ("etc", "dir", 512, t(1994, 4, 8), None, 0o555),
        ("bin", "symlink", 7, t(2010, 1, 25, 0, 17), "usr/bin", 0o777), ("blah", "dir", 512, t(2004, 4, 8), None, 0o555),
    ],
    DOS: [("licensed", "dir", None, t(2000, 4, 27, 21, 9), None, None), ("pub", "dir", None, t(2000, 7, 18, 10, 16), None, None), ("readme.htm", "file", 589, t(2000, 4, 14, 15, 47), None, None)],
    DOS_FILES: [("licensed.exe", "file", 123, t(2000, 4, 27, 21, 9), None, None), ("pub.pdf", "file", 456, t(2000, 7, 18, 10, 16), None, None), ("readme.htm", "file", 589, t(2000, 4, 14, 15, 47), None, None)],
    DATES: [("2009-12", "file", 1558532, t(2009, 12, 30), None, 0o644), ("2010-01", "file", 10564020, t(2010, 1, 14), None, 0o644)],
    MORE: [("english_german.2010-03-24.tar.gz", "file", 242408, t(2010, 3, 24), None, 0o644), ("old", "dir", 4096, t(2009, 3, 24), None, 0o755)],
    NAMES: [(n, None, None, None, None, None) for n in NAMES.splitlines()],
    OTHERS: [("sda", "other", 0, t(2010, 1, 2, 10, 11, 12), None, 0o660), ("näme  with  blanks", "file", 12, t(2009, 3, 9), None, 0o755), ("x", "file", 5, t(2009, 12, 31, 23, 59), None, 0o644)],
    MVS: [],
    " aj  \x00     a304 jrf": [],
    UNIX + "a line of another kind\n": [],
    "": [],
}


def test_listings(spark):
    files = spark.createDataFrame([(k, x) for k, x in enumerate([*CASES, None])], "k int, text string")
    found = {}
    for r in ftp.listings(files, "k", "text", NOW).collect():
        found.setdefault(r["k"], []).append(tuple(r)[1:])
    for k, want in enumerate(CASES.values()):
        assert found.get(k, []) == want, list(CASES)[k]
    assert len(CASES) not in found


def test_types(spark):
    rows = spark.createDataFrame([(x,) for x in (UNIX, DOS, DOS_FILES, NAMES, MVS)], "x string").select(ftp.listing_type(ftp.lines_of(F.col("x")))).collect()
    assert [r[0] for r in rows] == ["unix", "msdos", "msdos", "nlst", "unknown"]


def test_dates(spark):
    cases = [
        ("Feb  9 1990", t(2010, 1, 1), t(1990, 2, 9)), ("Feb  9  18:45", t(2005, 2, 9, 20), t(2005, 2, 9, 18, 45)), ("Feb  9  18:45", t(2005, 2, 9, 17), t(2004, 2, 9, 18, 45)),
        ("Feb 10 2005", t(2005, 2, 5), t(2005, 2, 10)), ("2010-05-07", t(2005, 1, 1), t(2010, 5, 7)), ("2010年5月7日", t(2005, 1, 1), t(2010, 5, 7)), ("07-05-2010", t(2005, 1, 1), t(2010, 5, 7)),
        ("Apr 1 2014 10:39PM", t(2020, 1, 1), t(2014, 4, 1, 22, 39)), ("Apr 1 2014 12:39PM", t(2020, 1, 1), t(2014, 4, 1, 12, 39)), ("Apr 1 2014 12:39AM", t(2020, 1, 1), t(2014, 4, 1, 0, 39)),
        ("12月 7 2004 午後", t(2020, 1, 1), t(2004, 12, 7)), ("09:05 31/12/68", t(2020, 1, 1), t(2068, 12, 31, 9, 5)), ("1.2.69", t(2020, 1, 1), t(1969, 2, 1)), ("Feb 31 2001", t(2020, 1, 1), None), ("no date", t(2020, 1, 1), None),
        ("fe\u0301vr 3 2004", t(2020, 1, 1), t(2004, 2, 3)), ("September 3 2004", t(2020, 1, 1), t(2004, 9, 3)), ("13/2/2004", t(2020, 1, 1), t(2004, 2, 13)), ("2/13/2004", t(2020, 1, 1), t(2004, 2, 13)),
    ]
    for text, now, want in cases:
        row = spark.createDataFrame([(text,)], "x string").select(ftp.date_time(F.col("x"), now)).first()
        assert row[0] == want, text


@pytest.mark.parametrize("text,bits", [("a", 0), ("1234567890", 0), ("---------", 0), ("r--------", 0o400), ("--s--s--s", 0o111), ("r-xr--r-x", 0o545), ("rw--wx-w-", 0o632), ("rwsrwsrws", 0o777)])
def test_permissions(spark, text, bits):
    assert spark.createDataFrame([(text,)], "x string").select(ftp.perm_bits(F.col("x"))).first()[0] == bits


def test_machine_listing(spark):
    lines = ["Type=file;Size=25730;Modify=19940728095854;Perm=; cap60.pl198.tar.gz", "type=dir;modify=20010101000000.123; my dir; x", "no facts", "size=x;unknown; y"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    found = {r["name"]: (r["type"], r["date"]) for r in ftp.machine_listing(df.filter(~F.col("line").startswith("size"))).collect()}
    assert found == {"cap60.pl198.tar.gz": ("file", t(1994, 7, 28, 9, 58, 54)), "my dir; x": ("dir", t(2001, 1, 1))}
