"""Text and table sources, bound to Kafka, files or parquet.

The same reader serves batch and streaming: ``streaming=True`` gives a
``readStream`` DataFrame. Every source bounds its micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_text(
    spark: SparkSession,
    topic: str,
    servers: str,
    streaming: bool = True,
    starting: str | None = None,
    max_per_batch: int = 50_000_000,
    with_partition: bool = False,
    since_ms: int | None = None,
    with_key: bool = False,
) -> DataFrame:
    """Records of a topic as ``value`` text with ``seq``, the offset; ``with_key`` adds the ``key`` text.

    ``since_ms`` starts at the first record of that time or later instead of ``starting``; a
    partition without one starts at its end. Offsets order the records of one partition only; ``with_partition`` adds its number.

    Progress lives in the query checkpoint, not in a consumer group, so two jobs
    on one topic both read everything. ``starting`` applies to the first start.
    """
    reader = spark.readStream if streaming else spark.read
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
    }
    if since_ms is None:
        options["startingOffsets"] = starting or ("latest" if streaming else "earliest")
    elif starting is not None:
        raise ValueError("either a place or a time to start from")
    else:
        options["startingTimestamp"] = str(since_ms)
        options["startingOffsetsByTimestampStrategy"] = "latest"
    if streaming:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return (
        reader.format("kafka")
        .options(**options)
        .load()
        .select(
            F.col("value").cast("string").alias("value"),
            F.col("offset").alias("seq"),
            *(["partition"] if with_partition else []),
            *([F.col("key").cast("string").alias("key")] if with_key else []),
        )
    )


def file_text(
    spark: SparkSession, path: str, streaming: bool = True, files_per_batch: int = 1000
) -> DataFrame:
    """Lines of the text files under a folder as ``value``, with a null ``seq``."""
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select("value", F.lit(None).cast("bigint").alias("seq"))


def parquet_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    streaming: bool = True,
    files_per_batch: int = 1000,
    glob: str | None = None,
) -> DataFrame:
    """Rows of a parquet table with a declared schema."""
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if streaming:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def jdbc_table(
    spark: SparkSession, url: str, table: str, schema: T.StructType, **options: str
) -> DataFrame:
    """A database table, such as the code dictionary, with only the declared columns."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.load().select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
