"""Row-wise operators and fitted lookups on streaming frames.

The reference has no streams, but every row-level operator of the toolkit
(P5-P7, T1, T2, E8-E10, A9-A11) is a stateless projection and every fitted
encoder is applied by a lookup join, so the same code serves a Structured
Streaming source: encoders are fitted once on the batch table, then joined
to each micro-batch as a static (size-checked, broadcast) table.

Output goes to a Parquet file sink with its checkpoint location in the
session's shared checkpoint folder (exactly-once, survives executor and
driver restarts); nothing is collected into driver memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import encode
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A streaming reader over a driver table (schema taken from the batch read)."""
    schema = read_table(spark, sf_dir, name).schema
    # file streams watch a directory; the filter keeps this table's files
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/")))


def fit_event_frequency(batch: DataFrame, col: str = "event_type") -> tuple[DataFrame, int]:
    """E6 model (level, Rfreq_<col>) fitted on the batch table, plus its row count."""
    n = batch.count()
    cnt = batch.groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("cnt"))
    model = cnt.select("level", (F.col("cnt") / F.lit(float(n))).alias(f"Rfreq_{col}"))
    rows = model.count()
    return model, rows


def rowwise_features(df: DataFrame, model: DataFrame, model_rows: int, col: str = "event_type") -> DataFrame:
    """Stateless features of each event plus the fitted frequency of its type.

    A model beyond the broadcast bounds is joined by a salted shuffle, in a
    stream as in a batch."""
    x = df.select(
        "event_id", "event_type",
        X.special_log("value").alias("Ts_value"),
        X.log1p_guarded("value").alias("Tl_value"),
        X.str_len("props").alias("Len_props"),
        X.blank_to_null("props").isNull().cast("int").alias("props_missing"),
    )
    return encode.lookup_join(x, model, F.col(col).cast("string"), "level", [f"Rfreq_{col}"],
                              defaults={f"Rfreq_{col}": 0.0}, model_rows=model_rows)


def run_to_parquet(stream_df: DataFrame, name: str = "stream") -> str:
    """Run a streaming query until its source is drained (available-now
    trigger) into a Parquet sink under the checkpoint folder; returns the
    output path."""
    spark = stream_df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = uuid.uuid4().hex
    out, ckpt = f"{root}/streams/{name}-{tag}/data", f"{root}/streams/{name}-{tag}/_checkpoint"
    q = (stream_df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out
