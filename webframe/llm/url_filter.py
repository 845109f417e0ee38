"""URL filtering by host rules and by a ratio of two character language models.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. URLs without a rule are judged
by two smoothed variable-order Markov models of characters, one of accepted and one of rejected URLs, which are the URLs
that rules decide. A character's probability is interpolated from the longest context of up to ORDER characters down
to the uniform distribution (each order weighs its count against SMOOTH). The verdict compares the difference of
log-likelihoods, divided by the URL's length, with a threshold calibrated on labelled URLs that training leaves out.

The models count every distinct labelled URL but a fifth, chosen by hash, which calibrates: tasks fill tables of
2**TABLE_BITS slots, whatever the input, and Spark adds them up; the driver gets the sums and broadcasts them. The threshold
is that of all calibrating scores, sorted in ranges. Scoring covers every row, in one pass without a shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and scores 0; a class without
calibrating URLs gives threshold 0, one without others a model of uniform characters; scores at the threshold are allowed; repeated rows
are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.session import cut

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, SMOOTH, TABLE_BITS = 5, 4.0, 20
#: one labelled URL of so many calibrates
HELD = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict."""
    out = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first, being outermost
        host, path = name.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bytes of all texts, their context hashes of each order, and each byte's text. Texts start after ORDER zeros."""
    pad = b"\0" * ORDER
    c = np.frombuffer(pad.join([b"", *texts]) + b"", np.uint8) if texts else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    place = np.repeat(np.arange(1, len(texts) + 1) * ORDER, [len(t) for t in texts]) + np.arange(len(owner))
    h = np.zeros(len(place), np.uint64)
    contexts = [h]
    for k in range(1, ORDER + 1):
        h = (h + c[place - k] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        contexts.append(h)
    return c[place], contexts, owner


@dataclass
class Model:
    seen: np.ndarray  # counts of (context, character)
    total: np.ndarray  # counts of contexts

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS))

    @classmethod
    def fit(cls, texts: list[bytes]) -> Model:
        model = cls.empty()
        model.add(texts)
        return model

    def add(self, texts: list[bytes]) -> None:
        c, contexts, _ = _hashes(texts)
        for k, h in enumerate(contexts):
            np.add.at(self.seen, self.slot(h, c, k), 1)
            np.add.at(self.total, self.slot(h, None, k), 1)

    @staticmethod
    def slot(h: np.ndarray, c: np.ndarray | None, k: int) -> np.ndarray:
        x = h + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)
        if c is not None:
            x = x ^ ((c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
        return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def log(self, c: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(c), 1 / 256)
        for k, h in enumerate(contexts):
            n, m = self.total[self.slot(h, None, k)], self.seen[self.slot(h, c, k)]
            p = (np.minimum(m, n) + SMOOTH * p) / (n + SMOOTH)
        return np.log(p)


@dataclass
class Ratio:
    accepted: Model
    rejected: Model
    threshold: float
    balance: float | None = None  # balanced accuracy of the threshold on the labelled URLs that training leaves out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Difference of log-likelihoods for each byte; 0 for empty texts."""
        c, contexts, owner = _hashes(texts)
        size = np.array([len(t) for t in texts], np.int64)
        d = np.bincount(owner, weights=self.accepted.log(c, contexts) - self.rejected.log(c, contexts), minlength=len(texts)) if len(c) else np.zeros(len(texts))
        return d / np.maximum(size, 1)


def runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of texts of about ``most`` bytes together, or of one that is longer."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def fit(good: list[bytes], bad: list[bytes]) -> Ratio:
    """Every fifth labelled URL calibrates the threshold: the midpoint of the cut with the best balanced accuracy."""
    train = lambda x: [t for i, t in enumerate(x) if i % 5]
    kept = lambda x: [t for i, t in enumerate(x) if not i % 5]
    ratio = Ratio(Model.fit(train(good)), Model.fit(train(bad)), 0.0)
    if len(good) < 5 or len(bad) < 5:
        return ratio
    scores = np.concatenate([ratio.score(kept(good)), ratio.score(kept(bad))])
    right = np.concatenate([np.ones(len(kept(good)), bool), np.zeros(len(kept(bad)), bool)])
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], right[order]
    below_good, below_bad = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(~y)])
    balance = (1 - below_good / y.sum()) + below_bad / (~y).sum()
    k = int(np.argmax(balance))
    ratio.balance = float(balance[k] / 2)
    ratio.threshold = float((s[max(0, k - 1)] + s[min(k, len(s) - 1)]) / 2)
    return ratio


def counted(urls: DataFrame) -> tuple[Model, Model]:
    """Models of the accepted and of the rejected of ``urls`` (good, u)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, Model] = {}
        for batch in batches:
            good = np.asarray(batch.column(0).to_pylist(), bool)
            texts = np.array([*batch.column(1).cast(pa.binary()).to_pylist(), None], object)[:-1]
            for side in (True, False):
                own = texts[good == side].tolist()
                for i, j in runs(own):
                    sides.setdefault(side, Model.empty()).add(own[i:j])
        for side, model in sides.items():
            for at, table in enumerate((model.seen, model.total)):
                slots = np.flatnonzero(table)
                for i in range(0, len(slots), 1 << 16):
                    part = slots[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part + ((2 * (not side) + at) << TABLE_BITS)), pa.array(table[part].astype(np.int64))], names=["slot", "n"])

    sums = urls.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most four tables
    tables = np.zeros(4 << TABLE_BITS)
    tables[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    good_seen, good_total, bad_seen, bad_total = np.split(tables, 4)
    return Model(good_seen, good_total), Model(bad_seen, bad_total)


def calibrated(scores: DataFrame) -> tuple[float, float | None]:
    """The midpoint of the cut with the best balanced accuracy, and that, from distinct scores (score, good, bad) with their
    counts: sorted in ranges, each added up behind the sums of those before it."""
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(scores.repartitionByRange(parts, "score")).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    sums = {r["part"]: r for r in placed.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).collect()}  # one for each partition
    goods, bads, last, before = 0, 0, None, []
    for p in range(max(sums, default=-1) + 1):
        before.append((goods, bads, last))
        if p in sums:
            goods, bads, last = goods + sums[p]["good"], bads + sums[p]["bad"], sums[p]["last"]
    if not goods or not bads:
        return 0.0, None
    known = lambda k, kind: F.get(F.array(*[F.lit(x[k]).cast(kind) for x in before]), F.col("part"))
    order = Window.partitionBy("part").orderBy("score")
    below = lambda k, c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + known(k, "long")
    balance = (1 - below(0, "good") / goods) + below(1, "bad") / bads
    cuts = placed.select("score", F.coalesce(F.lag("score").over(order), known(2, "double"), F.col("score")).alias("under"), balance.alias("balance"))
    best = cuts.agg(F.max_by(F.struct("score", "under", "balance"), F.struct("balance", -F.col("score"))).alias("x")).first()["x"]
    return (best["under"] + best["score"]) / 2, best["balance"] / 2


def train(ruled: DataFrame) -> Ratio:
    """From all URLs that rules decide, each once."""
    urls = ruled.filter(F.col("rule_verdict").isNotNull()).select((F.col("rule_verdict") == "allow").alias("good"), F.concat("host", "path").alias("u")).distinct()
    urls = cut(urls.withColumn("held", F.pmod(F.xxhash64("u"), F.lit(HELD)) == 0))
    ratio = Ratio(*counted(urls.filter(~F.col("held")).select("good", "u")), 0.0)
    sent = ruled.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            scores = np.concatenate([np.zeros(0), *(sent.value.score(texts[a:b]) for a, b in runs(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["good", "score"])

    scores = urls.filter("held").select("good", "u").mapInArrow(run, "good boolean, score double")
    ratio.threshold, ratio.balance = calibrated(scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    sent.unpersist()
    return ratio


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict and score of every row."""
    ruled = with_rule(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")), "url", rules)
    model = train(ruled)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # four tables of 2**TABLE_BITS floats, whatever the input
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, host, path, rule, verdict = batch.columns
            texts = [(h + p).encode() for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
            scores = np.concatenate([np.zeros(0), *(sent.value.score(texts[a:b]) for a, b in runs(texts))])
            says = [v or ("allow" if s >= sent.value.threshold else "block") for v, s in zip(verdict.to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, host, path, rule, pa.array(says, pa.string()), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    out = ruled.select("id", "host", "path", "rule", "rule_verdict").mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
