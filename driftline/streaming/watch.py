"""Comparisons as files arrive: a stream over a folder, one batch plan for each trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.plans.compare import Config, compare, documents_to_sections
from driftline.sources.files import markdown_lines


def watch(spark: SparkSession, base_lines: DataFrame, folder: str, output: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Compare each Markdown file that appears in ``folder`` with the base; append the rows as Parquet.

    A batch writes to a folder of its own number, so that a repeated batch replaces itself.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md").load(folder)
    found = stream.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), F.lit(".md").alias("suffix"), "content")

    def batch(df: DataFrame, number: int) -> None:
        pairs = documents_to_sections(markdown_lines(df), "compare", "", cfg.compat)
        base = documents_to_sections(base_lines, "base", "base", cfg.compat).drop("pair_id").crossJoin(pairs.select("pair_id").distinct())
        compare(base.unionByName(pairs), cfg).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
