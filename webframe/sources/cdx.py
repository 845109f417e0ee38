"""CDX files: the first character of the header is the separator; then ``CDX`` and a letter for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.operators.archive import CDX_HEADER, cdx_lines


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    """Columns of strings named by the header's letters; raises ValueError if the header has no ``CDX``."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0]["value"] if head else ""
    separator, fields = line[:1], line[1:].split(line[:1] or " ")
    if not fields or fields[0] != "CDX":
        raise ValueError("no CDX header")
    cells = F.split(F.trim("value"), "\\Q" + separator + "\\E")
    rows = spark.read.text(path).filter((F.col("value") != line) & (F.trim("value") != ""))
    return rows.select(*[F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(fields[1:])])


def visits_from_cdx(cdx: DataFrame) -> DataFrame:
    """(url, warc_id, payload_digest), one for each URL; raises ValueError if a field is missing."""
    missing = {"a", "u", "k"} - set(cdx.columns)
    if missing:
        raise ValueError(f"CDX fields are missing: {sorted(missing)}")
    rows = cdx.select(F.col("a").alias("url"), F.col("u").alias("warc_id"), F.col("k").alias("payload_digest"))
    return rows.groupBy("url").agg(F.min_by(F.struct("warc_id", "payload_digest"), "warc_id").alias("v")).select("url", "v.*")


def write_cdx(index: DataFrame, path: str, file_col: str = "file") -> None:
    """A text file for each partition, each with its header; rows are ordered by file and offset."""
    placed = index.repartition(file_col).sortWithinPartitions(file_col, "offset")
    lines = cdx_lines(placed)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([CDX_HEADER], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    lines.mapInArrow(with_header, "line string").write.mode("overwrite").text(path)
