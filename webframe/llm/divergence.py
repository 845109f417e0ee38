"""Audit of how far the sources of a language differ in their words, over wide term vectors.

Each task counts terms by (language, source) and gives one row for each of its terms, so the exchange carries what tasks
have found and not occurrences. A term that enough documents of a language hold is kept; its counts are pivoted into one
array that the language's sources index. Higher-order functions turn an array into contributions to pairs of sources,
which are added up before they cross an exchange.

A source that lacks a term gives it a base share that depends on the source alone. Two sources that both lack a term so
differ by the same amount for every such term, and an array gives contributions only for pairs of which one source has the
term: what it differs by beyond the two bases. The bases are added once for all kept terms, so rare terms of many sources
stay cheap and the sums are exact.

All arithmetic is of whole numbers (decimals where a product could leave 64 bits).

Defined results: null text, language or source are the empty text; a source of one language is another group than the same
source of another; groups without terms have every base share; a language without kept terms has pairs of value 0 and no
terms; repeated rows count each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.session import cut

MIN_DOCS, TOP_TERMS, PRIOR, UNIT = 30, 50, 5, 1_000_000_000
PIECE_BYTES = 1 << 20
#: entries that a task holds before it passes them on, and groups up to which their arrays are sent to all tasks
HELD, SENT_GROUPS = 500_000, 100_000


def _letters() -> bytes:
    """For bytes.translate: A-Z lowered, a-z and all bytes from 0x80 on as they are, the rest blank."""
    t = bytearray(b" " * 256)
    t[ord("a") : ord("z") + 1] = t[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    t[0x80:] = bytes(range(0x80, 0x100))
    return bytes(t)


LETTERS = _letters()


def terms(text: bytes) -> Counter:
    """How often each term is in a text, which is split in pieces of about PIECE_BYTES."""
    text, at, found = text.translate(LETTERS), 0, Counter()
    while at < len(text):
        to = text.find(b" ", at + PIECE_BYTES)
        to = len(text) if to < 0 else to
        found.update(text[at:to].split())
        at = to
    return found


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents; each group also has a row whose term is null."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def flush(held: dict[tuple, dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), group in held.items():
            words = [None, *group]
            n, d = (pa.array([0, *(x[k] for x in group.values())], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), n, d], names=["lang", "source", "term", "n", "d"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for k, of in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if of not in held:
                    size += 1
                group = held.setdefault(of, {})
                before = len(group)
                for word, n in terms(texts[k].as_py()).items():
                    if word in group:
                        x = group[word]
                        x[0] += n
                        x[1] += 1
                    else:
                        group[word] = [n, 1]
                size += len(group) - before
                if size > HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    found = named.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)); a language without kept terms has no shares."""
    over = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(11,0)")
    under = (total + PRIOR * kept).cast("decimal(20,0)")
    # the quotient of whole decimals would be rounded: what is over a multiple is taken off first
    whole = ((over - over % under) / under).cast("long")
    return F.when(kept > 0, whole + 1)


def _beside(rows: DataFrame, languages: DataFrame, few: bool) -> DataFrame:
    """``rows`` with what is known of their language, which is sent to all tasks only if the groups are few."""
    return rows.join(F.broadcast(languages) if few else languages, "lang")


def wide_vectors(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, bool]:
    """(languages, kept terms, whether languages are few enough to be sent). ``languages``: lang, kept (number of kept
    terms), total, and by index ``sources``, ``totals`` and ``base``, the share of a term that a source lacks. Kept terms:
    lang, term, and ``n``, an array of counts by the same index."""
    held = counts.filter(F.col("term").isNotNull())
    kept = cut(held.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("has")).filter(F.col("d") >= min_docs).select("lang", "term", "has"))
    sums = kept.select("lang", F.explode("has").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source")
    totals = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    languages = totals.join(sizes, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("g.source").alias("sources"), F.col("g.n").alias("totals"))
    total = F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)
    base = F.transform("totals", lambda n: _share(F.lit(0).cast("long"), n, F.col("kept")))
    languages = cut(languages.withColumns({"total": total, "base": base}))
    few = (languages.agg(F.sum(F.size("sources"))).first()[0] or 0) <= SENT_GROUPS
    # counts beside zeros of all sources, of which the greater stays: linear in the sources whatever the term has
    both = F.sort_array(F.concat("has", F.transform("sources", lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))))
    met = _beside(kept, languages.select("lang", "sources"), few).select("lang", "term", both.alias("b"))
    last = F.filter("b", lambda x, k: F.coalesce(F.get(F.col("b"), k + 1)["source"] != x["source"], F.lit(True)))
    return languages, met.select("lang", "term", last["n"].alias("n")), few


def _pairs(languages: DataFrame, vectors: DataFrame, few: bool) -> DataFrame:
    """(lang, i, j, value) for i < j: how much two sources differ over all kept terms."""
    known = _beside(vectors, languages.select("lang", "kept", "totals", "base"), few)
    shares = F.transform("n", lambda c, k: F.when(c == 0, F.get(F.col("base"), k)).otherwise(_share(c, F.get(F.col("totals"), k), F.col("kept"))))
    rows = known.select("lang", "n", "base", shares.alias("p"))
    # one row for each source that has the term; a pair that both have counts at the smaller index
    at = rows.select("lang", "n", "base", "p", F.posexplode("p").alias("i", "own")).filter(F.get("n", F.col("i")) > 0)
    beyond = lambda q, j: F.abs(F.col("own") - q) - F.abs(F.get(F.col("base"), F.col("i")) - F.get(F.col("base"), j))
    met = F.transform("p", lambda q, j: F.struct(F.least(F.col("i"), j).alias("i"), F.greatest(F.col("i"), j).alias("j"), F.when((j > F.col("i")) | ((j < F.col("i")) & (F.get(F.col("n"), j) == 0)), beyond(q, j)).alias("f")))
    met = F.filter(met, lambda x: x["f"] != 0)
    sums = at.select("lang", F.explode(met).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("f"))
    every = languages.select("lang", "kept", "base", F.posexplode("base").alias("i", "own"))
    every = every.select("lang", "kept", "i", "own", F.posexplode("base").alias("j", "other")).filter(F.col("i") < F.col("j"))
    value = F.col("kept") * F.coalesce(F.abs(F.col("own") - F.col("other")), F.lit(0)) + F.coalesce("f", F.lit(0))
    return every.join(sums, ["lang", "i", "j"], "left").select("lang", "i", "j", value.alias("value"))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Ranks by group. With a limit Spark drops in each task what can't be among the first ones before rows are dealt."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return out if most is None else out.filter(F.col("rank") <= most)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of part ``pair`` the other sources of the language by how much they differ,
    of part ``term`` the ``top`` terms that a source has more than its language by their difference."""
    counts = cut(term_counts(docs, text_col, lang_col, source_col))
    languages, vectors, few = wide_vectors(counts, min_docs)
    vectors = cut(vectors)
    name = lambda k: F.get(F.col("sources"), F.col(k))
    halves = _beside(_pairs(languages, vectors, few), languages.select("lang", "sources"), few).select("lang", name("i").alias("a"), name("j").alias("b"), "value")
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = _ranked(halves.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", "x.item", "value"))
    known = _beside(vectors, languages.select("lang", "kept", "total", "totals", "sources"), few)
    whole = _share(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x), F.col("total"), F.col("kept"))
    each = known.select("lang", F.col("term").alias("item"), "kept", "totals", "sources", whole.alias("q"), F.posexplode("n").alias("i", "c")).filter(F.col("c") > 0)
    more = each.select("lang", name("i").alias("source"), "item", (_share(F.col("c"), F.get("totals", F.col("i")), F.col("kept")) - F.col("q")).alias("value")).filter(F.col("value") > 0)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(_ranked(more, top), "term"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
occ AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM grp) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
ng AS (SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY g.lang, g.source),
nl AS (SELECT lang, sum(n) AS n FROM ng GROUP BY lang),
p AS (
  SELECT ng.lang, ng.source, kept.term, coalesce(c, 0) AS c, 1 + ({UNIT} * CAST(coalesce(c, 0) + {PRIOR} AS HUGEINT)) // CAST(n + {PRIOR} * v AS HUGEINT) AS p
  FROM ng JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cnt ON cnt.lang = ng.lang AND cnt.source = ng.source AND cnt.term = kept.term
),
q AS (
  SELECT kept.lang, kept.term, 1 + ({UNIT} * CAST(sum(c) + {PRIOR} AS HUGEINT)) // CAST(any_value(n) + {PRIOR} * any_value(v) AS HUGEINT) AS q
  FROM kept JOIN cnt USING (lang, term) JOIN nl USING (lang) JOIN v USING (lang) GROUP BY kept.lang, kept.term
),
diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN diff ON diff.lang = g.lang AND diff.source = g.source AND diff.item = h.source
),
more AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranks AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM more
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
