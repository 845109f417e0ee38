"""A frontier that outlives its crawl: a log of states in a bucketed table, one version for each wave.

A version holds the rows that a wave changed or added, as they are after it. The state of a URL is its row in the last
version that has one: an aggregate over a table that is bucketed by URL, which needs no exchange, as no anti-join of new
URLs with the known ones does on the table's side. Every COMPACT versions the states are written as one version, behind
which older ones aren't read again.

A version counts once a manifest names it: a small file that is written whole under another name and then renamed. What
a crawl wrote after its last manifest is never read, as each run that goes on with a frontier writes its own partitions.
The manifest also carries the crawl's counters, so that a crawl goes on as if nothing had happened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.operators import frontier as fr

COMPACT = 50


@dataclass
class Manifest:
    """What is there: for each run the first and last version that count; the crawl's counters."""

    runs: list[list[int]] = field(default_factory=list)
    version: int = 0
    buckets: int = 0
    since: int = 0  # versions since the states were last written as one
    counters: dict = field(default_factory=dict)


class _Folder:
    """Small files in whatever store Spark has."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, self._path(spark, path)
        self.store = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _path(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.store.listStatus(self.path)) if self.store.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.store.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none of it."""
        held = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self.store.create(held, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.store.rename(held, self._at(name)):
            raise OSError(f"{name} could not be written")


class FrontierLog:
    """The log in ``folder``; what is there already is gone on with."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = _Folder(spark, f"{self.folder}/manifests")
        found = [n for n in self.manifests.names() if n.startswith("manifest-")]
        self.manifest = Manifest(**json.loads(self.manifests.read(found[-1]))) if found else Manifest(buckets=buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.resumed = bool(found)
        # versions of runs that were lost are in partitions of their numbers: a run's number is used once
        begun = [int(n[4:]) for n in _Folder(spark, f"{self.folder}/runs").names() if n.startswith("run-")]
        self.run = max(begun, default=-1) + 1
        _Folder(spark, f"{self.folder}/runs").put(f"run-{self.run:08d}", "")
        self.table = f"frontier_{uuid.uuid4().hex}"
        kinds = ", ".join(f"`{c.split(' ')[0]}` {c.split(' ')[1]}" for c in fr.SCHEMA.split(", "))
        spark.sql(f"CREATE TABLE {self.table} ({kinds}, error string, run int, version int) USING parquet PARTITIONED BY (run, version) CLUSTERED BY (url) INTO {self.manifest.buckets} BUCKETS LOCATION '{self.folder}/log'")
        if self.resumed:
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def close(self) -> None:
        """Forgets the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _counts(self) -> Column:
        out = F.lit(False)
        for run, first, last in self.manifest.runs:
            out = out | ((F.col("run") == run) & F.col("version").between(first, last))
        return out

    def rows(self) -> DataFrame:
        """All rows that count, with run and version; one partition filter."""
        return self.spark.table(self.table).filter(self._counts())

    def known(self) -> DataFrame:
        """The URLs that are known, some more than once, dealt by URL as they are stored."""
        return self.rows().select("url")

    def states(self) -> DataFrame:
        """The last row of each URL: an aggregate without an exchange."""
        row = F.struct(*fr.COLUMNS)
        return self.rows().groupBy("url").agg(F.max_by(row, F.col("version")).alias("row")).select("row.*")

    def written(self) -> DataFrame:
        """The rows of the version that was written and isn't committed yet."""
        run, version = self._next()
        return self.spark.table(self.table).filter((F.col("run") == run) & (F.col("version") == version))

    def _next(self) -> tuple[int, int]:
        return self.run, self.manifest.version + 1

    def write(self, rows: DataFrame) -> None:
        """``rows`` (the frontier's columns, and error) as the next version, which counts from :meth:`commit` on. A URL is in
        it once."""
        run, version = self._next()
        if "error" not in rows.columns:
            rows = rows.withColumn("error", F.lit(None).cast("string"))
        # a file for each bucket
        placed = rows.select(*fr.COLUMNS, "error", F.lit(run).alias("run"), F.lit(version).alias("version")).repartition(self.manifest.buckets, "url")
        placed.write.insertInto(self.table)

    def commit(self, **counters) -> None:
        """The version that was written last is there from now on, and these are the crawl's counters."""
        run, version = self._next()
        runs = [list(r) for r in self.manifest.runs]
        if runs and runs[-1][0] == run:
            runs[-1][2] = version
        else:
            runs.append([run, version, version])
        self._put(Manifest(runs, version, self.manifest.buckets, self.manifest.since + 1, counters or self.manifest.counters))

    def compact(self, every: int = COMPACT) -> bool:
        """Writes the states as one version if there are ``every`` of them or more since the last time."""
        if self.manifest.since < every:
            return False
        self.write(self.states())
        run, version = self._next()
        self._put(Manifest([[run, version, version]], version, self.manifest.buckets, 0, self.manifest.counters))
        return True

    def _put(self, manifest: Manifest) -> None:
        self.manifests.put(f"manifest-{manifest.version:012d}.json", json.dumps(asdict(manifest)))
        self.manifest = manifest
