"""Dead letters as a folder of files (S12, T14, T22): put down, taken up by a stream, moved aside once they are stored, purged by age.

``waiting`` holds files of JSON lines, any number of letters each; ``processed`` those that were taken up. A batch is stored before its files are moved: if it is
done again, it overwrites its own folder, and files that are gone already are passed over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.sources.stored import file_system
from trailmark.streaming.outbox import capacity

LETTER = "Id string, FailedAt timestamp, FailureReason string, RetryCount int, IsProcessed boolean, EventType string"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def put(letters: DataFrame, folder: str) -> None:
    """Letters into new files. Other columns are left out."""
    letters.select(*(c.split(" ")[0] for c in LETTER.split(", "))).write.mode("append").options(**TIMES).json(f"{folder}/waiting")


def waiting(spark: SparkSession, folder: str) -> DataFrame:
    """The letters that nobody has taken up."""
    fs, make = file_system(spark, folder)
    if not fs.exists(make(f"{folder}/waiting")):
        return spark.createDataFrame([], LETTER)
    return spark.read.schema(LETTER).options(**TIMES).json(f"{folder}/waiting")


def queue_state(spark: SparkSession, folder: str, soft: int = 1000, hard: int = 5000) -> DataFrame:
    """How many wait, and what the queue does with the next one."""
    return capacity(waiting(spark, folder), soft, hard)


def store_batch(batch: DataFrame, number: int, folder: str, out: str) -> None:
    """The letters of a batch into a folder of its own; then its files, at most those of one trigger, go aside."""
    spark = batch.sparkSession
    batch = batch.persist()
    batch.drop("file").write.mode("overwrite").parquet(f"{out}/batch={number}")
    files = [r.file for r in batch.select("file").distinct().collect()]
    batch.unpersist()
    fs, make = file_system(spark, folder)
    fs.mkdirs(make(f"{folder}/processed"))
    for file in files:
        if fs.exists(make(file)):
            fs.rename(make(file), make(f"{folder}/processed/{make(file).getName()}"))


def take_up(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Stores the letters that wait, for another attempt, and ends."""
    stream = spark.readStream.schema(LETTER).options(**TIMES).option("maxFilesPerTrigger", files_a_batch).json(f"{folder}/waiting")
    named = stream.select("*", F.col("_metadata.file_path").alias("file"))
    return named.writeStream.foreachBatch(lambda b, n: store_batch(b, n, folder, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def purge_processed(spark: SparkSession, folder: str, before: datetime) -> int:
    """Deletes the files aside that were written before a time (UTC); how many."""
    fs, make = file_system(spark, folder)
    if not fs.exists(make(f"{folder}/processed")):
        return 0
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/processed")
    old = [r.path for r in listed.where(F.col("modificationTime") < F.lit(before)).select("path").toLocalIterator()]
    for path in old:
        fs.delete(make(path), False)
    return len(old)
