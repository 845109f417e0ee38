"""Quality rules: per-document counts and cross-document line frequency, all in built-in functions.

A line is normalised to lower case with single spaces and hashed (xxHash64). For each host, here the source of a
document, the distinct documents that hold a line are counted; documents with the same text are one document, so that
exact copies, which a dedup step handles, don't make their own lines frequent. A line is boilerplate if it is in
MIN_DOCS documents of its host or more, however many the host has; callers may ask for over a share of them too. A document whose words are lost for the most part when
its boilerplate lines go (under KEEP of its words stay) is depleted and rejected.

Texts are not shuffled and their lines are cut once: (id, host, text hash, place, line hash, words) of each line is
checkpointed, counted, and met again by the frequent lines in a plain equi-join, which adaptive execution splits where a
line is in a third of all rows. Counts are pre-aggregated before each exchange.

Defined results: a null text has no words (base_failed); a null source is a host of its own; a document without words is
rejected; repeated rows are judged alike and all stay in the result; extra columns are ignored by :func:`judge` and kept
by :func:`keep_good` and :func:`remove_lines`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.session import cut

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
REPEAT_WIDTH = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_DOCS, SHARE, KEEP = 5, 0.0, 0.5
#: most numbers of eight bytes that are sent to the documents
SENT_NUMBERS = 4_000_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = REPEAT_WIDTH) -> Column:
    """Words in windows of ``width`` words that are in ``words`` twice or more.

    Most documents have no such window: distinct hashes are as many as windows. In the others the (hash, place) pairs are
    sorted, and the sorted places of repeated hashes are summed up as a union of spans.
    """

    def spans(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _let(F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(_equal(s, x, k), x["i"]).otherwise(-1)), lambda i: i >= 0)), _union))

    def _equal(s: Column, x: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
        after = (k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    def _union(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), i - F.get(p, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    whole = _let(spans(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(whole)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def base(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, text hash, lines, and the counts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        "id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def _line_words(line: Column) -> Column:
    """The words of a normalised line, which single spaces part."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("long")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANK + "+", " "))


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, text hash, place, line hash, words): a row for each line with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "")
    # what the whole text gives is computed below the generator: beside it, it would be computed again for every line
    whole = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.xxhash64(text).alias("text_hash"), line.alias("lines"))
    # the outer form keeps Catalyst from testing the size of the lines first, which would compute them twice
    n_words = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + _line_words(x))
    rows = whole.withColumn("n_words", n_words).select("id", "host", "text_hash", "n_words", F.posexplode_outer("lines").alias("place", "line")).filter(F.col("line").isNotNull())
    return rows.select("id", "host", "text_hash", "n_words", "place", F.xxhash64("line").alias("line_hash"), _line_words(F.col("line")).alias("words"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(f_host, f_hash) of boilerplate, from (host, text_hash, line_hash) of lines."""
    once = lines.groupBy("host", "text_hash", "line_hash").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "line_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    if share:
        hosts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n_host"))
        counts = counts.join(hosts, counts["host"].eqNullSafe(hosts["h"])).filter(F.col("n") > F.lit(share) * F.col("n_host"))
    return counts.select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_hash"))


def row_key(id: Column, host: Column) -> Column:
    return F.xxhash64(id, host, id.isNull(), host.isNull())


def _lost(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, share: float) -> DataFrame:
    """(l_key, l_hash, lost, l_words, l_lines) of rows that have boilerplate, by the keys of id and host, and text: the
    words of boilerplate, all words, and the hashes of the lines. The keys are 16 bytes, whatever ids and hosts are."""
    lines = cut(_lines(docs, id_col, text_col, host_col))
    often = frequent_lines(lines, min_docs, share)
    met = lines.join(often, lines["host"].eqNullSafe(often["f_host"]) & (lines["line_hash"] == often["f_hash"]))
    met = met.select(row_key(F.col("id"), F.col("host")).alias("l_key"), F.col("text_hash").alias("l_hash"), "place", "line_hash", "words", "n_words").distinct()  # rows that are repeated lose the same lines
    return met.groupBy("l_key", "l_hash").agg(F.sum("words").alias("lost"), F.max("n_words").alias("l_words"), F.collect_set("line_hash").alias("l_lines"))


def _passes_base(docs: DataFrame, text_col: str) -> DataFrame:
    words = words_of(F.coalesce(docs[text_col], F.lit("")))
    return docs.filter(_let(words, lambda w: (F.size(w) >= MIN_WORDS) & (100 * repeat_words(w) <= MAX_REPEAT_PERCENT * F.size(w))))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. :func:`remove_lines` keeps the same rows without their boilerplate.

    Rules of one document need no exchange. The depleted ones are written first; they are sent to the documents if they
    are few (at most SENT_NUMBERS together), and otherwise meet them in a shuffled join.
    """
    gone = cut(_lost(docs, id_col, text_col, host_col, min_docs, share).filter(F.col("l_words") - F.col("lost") < F.lit(keep) * F.col("l_words")).select("l_key", "l_hash"))
    side = F.broadcast(gone) if 2 * gone.count() <= SENT_NUMBERS else gone
    return _passes_base(docs, text_col).join(side, _same(docs, gone, id_col, text_col, host_col), "left_anti")


def _same(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, host_col: str) -> Column:
    """Columns are named by their frames: those of ``docs`` may have any names."""
    return (row_key(docs[id_col], docs[host_col]) == lost["l_key"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == lost["l_hash"])


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """The rows that :func:`keep_good` keeps, with ``text_col`` rebuilt without its boilerplate lines.

    The hashes of the lines that a row loses come back to it, and its lines are split and filtered again. All other
    lines, blank ones too, stay as they are; texts that lose nothing are not touched. Rows and hashes are sent to the
    documents if together they are SENT_NUMBERS at most.
    """
    found = cut(_lost(docs, id_col, text_col, host_col, min_docs, share))
    numbers = found.agg(F.sum(F.size("l_lines") + 4)).first()[0] or 0
    side = F.broadcast(found) if numbers <= SENT_NUMBERS else found
    depleted = F.coalesce(found["l_words"] - found["lost"] < F.lit(keep) * found["l_words"], F.lit(False))
    rows = _passes_base(docs, text_col).join(side, _same(docs, found, id_col, text_col, host_col), "left").filter(~depleted)
    left = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x: ~F.array_contains(found["l_lines"], F.xxhash64(_normal(x)))), "\n")
    text = F.when(found["l_lines"].isNull(), docs[text_col]).otherwise(left).alias(text_col)
    return rows.select(*[text if c == text_col else docs[c] for c in docs.columns])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: the counts, n_boilerplate_words, base_failed and kept."""
    lost = _lost(docs, id_col, text_col, host_col, min_docs, share).select("l_key", "l_hash", "lost")
    rows = base(docs, id_col, text_col, host_col)
    joined = rows.join(lost, (row_key(rows["id"], rows["host"]) == lost["l_key"]) & (rows["text_hash"] == lost["l_hash"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn("n_boilerplate_words", F.least(F.coalesce("lost", F.lit(0)), F.col("n_words")).cast("long"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words", "base_failed", (~F.col("base_failed") & (left >= F.lit(keep) * F.col("n_words"))).alias("kept"), "host", "text_hash"
    )
