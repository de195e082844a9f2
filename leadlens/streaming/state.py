"""Tables that a stream keeps: what each micro-batch changed, over a snapshot that is compacted now and then.

A batch writes its changed rows to ``root/changes/batch=n`` and nothing else, so that its cost follows the batch.  A repeated
batch rewrites its folder; a folder counts once Spark has marked it as finished.  ``root/snapshot/epoch=n`` holds the tables
after batch n.  Folders are few, as compaction removes those that a snapshot replaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DONE = "_SUCCESS"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB and write what changed; a query keeps the settings that it was
    started with.  ``partitions`` of the state (else the session's for shuffles) can't change later: each is a store that
    every batch opens, so they should follow the size of the state, not that of a batch."""
    settings = STORE if partitions is None else {**STORE, "spark.sql.shuffle.partitions": str(partitions)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _path(spark, path)
    return system.exists(hadoop)


def finished(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Folders ``name=n`` below a path that were written to the end."""
    hadoop, system = _path(spark, path)
    if not system.exists(hadoop):
        return {}
    own = [s.getPath() for s in system.listStatus(hadoop) if s.getPath().getName().startswith(f"{name}=")]
    return {int(p.getName().split("=")[1]): p.toString() for p in own if exists(spark, f"{p.toString()}/{DONE}")}


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        hadoop, system = _path(spark, path)
        system.delete(hadoop, True)


def write_changes(batch: DataFrame, root: str, epoch: int, *by: str) -> None:
    writer = batch.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/changes/batch={epoch}")


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, epoch: int) -> None:
    """All tables after batch ``epoch``; the mark, set last, says that the snapshot is whole."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/snapshot/epoch={epoch}/{name}")
    hadoop, system = _path(spark, f"{root}/snapshot/epoch={epoch}/{DONE}")
    system.create(hadoop, True).close()


def snapshot_of(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Epoch and folder of the last snapshot."""
    whole = finished(spark, f"{root}/snapshot", "epoch")
    epoch = max(whole, default=-1)
    return epoch, whole.get(epoch)


def changes_after(spark: SparkSession, root: str, epoch: int, schema: str) -> DataFrame | None:
    """Changes of the batches after ``epoch`` with the number of their batch; None without any."""
    paths = [path for n, path in finished(spark, f"{root}/changes", "batch").items() if n > epoch]
    if not paths:
        return None
    return spark.read.option("basePath", f"{root}/changes").schema(f"{schema}, batch int").parquet(*paths)


def drop_replaced(spark: SparkSession, root: str, epoch: int) -> None:
    """Removes what the snapshot of ``epoch`` replaces."""
    remove(spark, [p for n, p in finished(spark, f"{root}/snapshot", "epoch").items() if n < epoch])
    remove(spark, [p for n, p in finished(spark, f"{root}/changes", "batch").items() if n <= epoch])


# ------------------------------------------------------------------ one table, kept by its keys
def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def latest_to_table(
    frame: DataFrame, root: str, checkpoint: str, mode: str = "update", partitions: int | None = None, **trigger
) -> StreamingQuery:
    """Write the rows that a streaming aggregation, or another keyed state, changes in a micro-batch."""
    def on_batch(rows: DataFrame, epoch: int) -> None:
        write_changes(rows, root, epoch)

    with rocksdb_state(frame.sparkSession, partitions):
        writer = frame.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, root: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The newest row of each key."""
    epoch, path = snapshot_of(spark, root)
    rows = changes_after(spark, root, epoch, ddl(schema))
    old = None if path is None else spark.read.schema(schema).parquet(f"{path}/latest").withColumn("batch", F.lit(-1))
    both = old if rows is None else rows if old is None else old.unionByName(rows)
    if both is None:
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*schema.names)


def compact_latest(spark: SparkSession, root: str, keys: list[str], schema: T.StructType) -> int:
    """Writes the newest rows as a snapshot and removes what it replaces; returns its epoch.  Run it between batches and
    away from readers; a run that fails leaves the table as it was."""
    before, _ = snapshot_of(spark, root)
    epoch = max(finished(spark, f"{root}/changes", "batch"), default=before)
    if epoch > before:
        write_snapshot(spark, {"latest": read_latest(spark, root, keys, schema)}, root, epoch)
        drop_replaced(spark, root, epoch)
    return epoch
