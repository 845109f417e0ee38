"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage is one operator over all documents that its predecessor kept. All but the last return the columns of
``documents``; between stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm import decontamination, near_copies, pieces, quality, substring_dedup
from webframe.llm.queries import tokenizer_model
from webframe.llm.warc import archive_folder
from webframe.session import cut, remove, table


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as no column of ``docs`` has."""
    while name in docs.columns:
        name = "_" + name
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that boilerplate lines make up for the most part, go; the others lose those lines."""
    before = free_name(docs, "before")
    done = quality.remove_lines(docs.withColumn(before, F.col("text")))
    length = F.when(F.col("text") == F.col(before), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return done.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more; candidates by SimHash, and what SimHash
    leaves by exact lists) the row with the smallest id stays, of
    several with this id the one with the least hashes of its shingles and of all its columns; rows without an id can't be
    told apart by it and stay. Only ids and hashes are dealt by group; rows that go are met by texts where these are, if they
    are few enough to be sent. Texts go to Python to be grouped alone."""
    i, h, t = (free_name(docs, x) for x in ("i", "h", "t"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    named = docs.filter(F.col("doc_id").isNotNull())
    found = near_copies.texts_of_groups(named)
    rows = named.select(F.col("doc_id").alias(i), F.xxhash64("text").alias(t), whole.alias(h))
    met = rows.join(near_copies.sent(found), F.col(t) == F.col("text_hash")).select("group", F.struct(F.col(i).alias("i"), F.col("key").alias("k"), F.col(h).alias("h")).alias("mark"))
    counted = cut(met.groupBy("group", "mark").agg(F.count("*").alias("n")))
    several = counted.groupBy("group").agg(F.min("mark").alias("least"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    # of equal rows all go, and one comes back
    again = (F.col("mark") == F.col("least")) & (F.col("n") > 1)
    gone = cut(counted.join(several, "group").filter((F.col("mark") != F.col("least")) | again).select(F.col("mark.i").alias(i), F.col("mark.h").alias(h), again.alias(t)))
    marked = docs.withColumn(h, whole)
    same = lambda x: (F.col("doc_id") == x[i]) & (marked[h] == x[h])
    out = marked.join(near_copies.sent(gone), same(gone), "left_anti").select(*columns)
    back = gone.filter(F.col(t))
    if back.limit(1).count():
        back = cut(back)
        out = out.unionByName(marked.join(near_copies.sent(back), same(back), "left_semi").dropDuplicates(["doc_id", h]).select(*columns))
    return out


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; texts that lose nothing stay as they are, and emptied documents go."""
    words, removed, kept = names = tuple(free_name(docs, x) for x in ("n_words", "n_removed", "kept"))
    done = substring_dedup.remove_repeats(docs, names=names)
    lost = F.col(removed) > 0
    done = done.filter(~lost | (F.col(removed) < F.col(words)))
    text = F.when(lost, F.col(kept)).otherwise(F.col("text"))
    done = done.withColumn("n_chars", F.when(lost, F.length(kept).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, and digests of ids, decoded text and source spans."""
    return pieces.encode(docs, tokenizer_model(), keep="ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Near-copy components, block anchors and SentencePiece are beyond SQL; tests compare whole rows of the first four stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = archive_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:  # what the stage read isn't needed again
                remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
