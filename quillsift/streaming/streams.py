"""Inspection and cleaning of streams: stateless maps, and windowed counts of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillsift.operators import inspection


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(docs: DataFrame, out: str, checkpoint: str, profile: str = "prose") -> StreamingQuery:
    """Appends cleaned documents; the checkpoint makes each row appear once."""
    return inspection.clean(docs, profile).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def findings_per_window(docs: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of findings by category and window; rows later than the watermark are dropped."""
    f = inspection.findings(docs.withWatermark(time, late).select(time, "text"))
    return f.groupBy(F.window(time, width), "category").agg(F.count(F.lit(1)).alias("n"))


def cleaned_totals(spark: SparkSession, documents: str, text_sql: str) -> DataFrame:
    """Streams a documents dataset through strip_invisible into a new dataset and sums it up."""
    import uuid

    from quillsift.functions import udfs as U

    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="quillsift-")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(spark.read.parquet(documents).schema)
    where = sc._jvm.org.apache.hadoop.fs.Path(documents)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads folders
        folder, _, name = documents.rpartition("/")
        reader, documents = reader.option("pathGlobFilter", name), folder
    d = reader.parquet(documents).select("doc_id", F.expr(text_sql).alias("text"))
    d = d.select("doc_id", U.strip_invisible("text").alias("r")).select("doc_id", F.col("r.text").alias("text"), F.col("r.removed").cast("bigint").alias("removed"))
    q = d.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("docs"), F.sum("removed").alias("removed"))
