"""Sources of check requests: JSON lines, Parquet, and streams of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as T

FIELDS = ("platform", "donator", "message", "currency")


def request_fields(body: Column) -> dict[str, Column]:
    """platform, donator, message, currency (strings, empty where of another type) and amount (finite or null) of a JSON body."""
    v = F.try_parse_json(body)

    def text(name: str) -> Column:
        inner = F.try_variant_get(v, f"$.{name}", "variant")
        return T.as_string(F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, f"$.{name}", "string")))

    kind = F.schema_of_variant(F.try_variant_get(v, "$.amount", "variant"))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    return {name: text(name) for name in FIELDS} | {"amount": F.when(numeric, T.finite_or_null(F.try_variant_get(v, "$.amount", "double")))}


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Requests of JSON lines; a line that does not parse gives empty fields, never a failed job."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(*[c.alias(n) for n, c in request_fields(F.col("value")).items()])


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Parquet events; a stream takes the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if streaming else spark.read.parquet(path)


#: Bytes of a table up to which its rows are dealt over all cores: one row group is one task, however many cores there are.
SPREAD_BYTES = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table dealt over all cores, where reading it gives fewer tasks; a large one as it is."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else table


#: Bytes of a table's files that one task of text work takes, about.
TASK_BYTES = 1 << 20


def into_tasks(table: DataFrame) -> DataFrame:
    """A table's rows dealt over all cores and into tasks of about TASK_BYTES: tasks of larger tables are more, not longer.

    One row group is one task to read, however long it is, so the layout of the files does not count. For work on rows that outweighs a shuffle.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


#: Rows of whole texts that a Python worker is sent at a time.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame. Its session sends Python workers at most BATCH_ROWS rows at a time from now on: each task holds a batch of whole texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df
