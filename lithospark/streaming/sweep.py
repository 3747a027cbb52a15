"""Beyond the reference: sweeps of a drop folder, and rolling counts of events, as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.sources.containers import RELATIONS, swept


def stream_sweep(spark: SparkSession, folder: str, suffix: str = ".pkg") -> DataFrame:
    """A row for each package that arrives in folder. A file is held whole, so this is for small packages."""
    arrived = spark.readStream.format("binaryFile").option("pathGlobFilter", f"*{suffix}").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    names = [f.split()[0] for f in RELATIONS["sweep"][0].split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, body in zip(frame.path, frame.content, strict=True):
                row = swept(lambda a, n, body=body: bytes(body[a : a + n]), len(body))
                rows.append((path, *(row[n] for n in names)))
            yield pd.DataFrame(rows, columns=["file", *names]).astype({"content_type": "Int64"})

    return arrived.select("path", "content").mapInPandas(run, "file string, " + RELATIONS["sweep"][0])


def overlay_batches(stream: DataFrame, target: str, key: str, checkpoint: str):
    """Keeps the latest row of each key in a table at target: every batch overlays what is there."""
    from lithospark.operators.overlay import last_writer_wins

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{target}/{number - 1}"
        layers = [batch]
        if number > 0:
            layers.insert(0, spark.read.parquet(old))
        last_writer_wins(layers, [key]).drop("layer").write.mode("overwrite").parquet(f"{target}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and kind; rows later than late are passed over."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", kind, "n")
