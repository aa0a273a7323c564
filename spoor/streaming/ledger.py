"""Streams: a ledger that grows with what was fetched, and the progress of logs that grow."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoor.operators.irlog import is_start, kilobytes, polled
from spoor.sources.corpus import file_name, logs


LEDGER = "link_id string, run string, batch_id long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(link_id, run, batch_id) of a ledger that :func:`keep_ledger` fills."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)


def keep_ledger(
    links: DataFrame, path: str, checkpoint: str, fetch: Callable[[DataFrame], DataFrame], *, continuous: str | None = None
) -> StreamingQuery:
    """Fetches links of a stream (with ``link_id``) that no earlier batch has fetched.

    fetch turns links into links with ``status``; only those that are ok go into the ledger at ``path``, so a failed
    one is tried again when it comes up again. A batch writes its own folder, named by the checkpoint and its number: one
    that is repeated after a failure replaces it, and a run with a new checkpoint, whose numbers begin anew, adds to what
    is there. continuous: a trigger interval; without it the stream ends with what there is.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def batch(found: DataFrame, number: int) -> None:
        known = read_ledger(found.sparkSession, path).where(~((F.col("run") == run) & (F.col("batch_id") >= number))).select("link_id")
        fresh = found.dropDuplicates(["link_id"]).join(known, "link_id", "left_anti")
        done = fetch(fresh).where("status = 'ok'")
        done = done.select("link_id", F.lit(run).alias("run"), F.lit(number).cast("long").alias("batch_id"))
        done.write.mode("overwrite").parquet(f"{path}/{run}-{number}")

    links.sparkSession.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{path}/none")
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return links.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def keep_on(start: Callable[[], StreamingQuery], *, wait: float = 30.0, most: int | None = None, tell: Callable[[str], None] = print) -> int:
    """Runs a stream and, when it fails, starts it again after ``wait`` seconds; from its checkpoint it goes on where it
    was. Ends when the stream does (as one of what there is does), or with the error after ``most`` restarts. Returns how
    often it was started again."""
    again = 0
    while True:
        try:
            start().awaitTermination()
            return again
        except StreamingQueryException as wrong:
            if most is not None and again >= most:
                raise
            again += 1
            tell(f"error: {str(wrong).splitlines()[0]}; again in {wait:g} seconds")
            time.sleep(wait)


def progress(lines: DataFrame, line: str = "value") -> DataFrame:
    """A running count of started functions in a stream of log lines, for output mode complete."""
    return lines.where(is_start(F.col(line))).groupBy().agg(F.count("*").alias("start_lines"))


def poll(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, size_bytes, start_lines) of the logs at a path as they are now."""
    sizes = spark.read.format("binaryFile").load(path).select(file_name(F.col("path")).alias("log_id"), F.col("length").alias("size_bytes"))
    return polled(sizes, logs(spark, path).where("error IS NULL"))


def monitor(
    spark: SparkSession, path: str, done: Callable[[], bool], *, every: float = 3.0, tell: Callable[[str], None] = print
) -> dict[str, tuple[int, int]]:
    """Polls growing logs until ``done``, and tells the started functions and the size of each that has grown.

    Returns the last size and count of each log. The logs' names and numbers are on the driver, their texts are not.
    """
    last: dict[str, tuple[int, int]] = {}
    while not (ended := done()) or not last:
        time.sleep(0 if ended else every)
        for r in poll(spark, path).withColumn("kb", kilobytes(F.col("size_bytes"))).orderBy("log_id").toLocalIterator():
            if r["size_bytes"] > last.get(r["log_id"], (0, 0))[0]:
                tell(f"{r['log_id']}: {r['start_lines']} functions processed, {r['kb']:g} KB written")
            last[r["log_id"]] = (r["size_bytes"], r["start_lines"])
        if ended:
            break
    return last
