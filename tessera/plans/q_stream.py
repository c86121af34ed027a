"""Streaming query: row-wise operators and a batch-fitted encoder applied to
the ``events`` table read as a stream."""

from __future__ import annotations

from tessera.plans.registry import R, query, rounded
from tessera.sources.tables import read_table
from tessera.streaming import rowwise

_SQL = f"""
WITH m AS (SELECT event_type AS level, count(*) * 1.0 / (SELECT count(*) FROM events) AS f
           FROM events GROUP BY event_type)
SELECT event_id, event_type,
       {R("CASE WHEN value IS NULL THEN NULL WHEN value > 0 THEN ln(value) "
          "WHEN value = 0 THEN CAST('-inf' AS DOUBLE) ELSE -40.0 END")} AS Ts_value,
       {R("CASE WHEN value > -1 THEN ln(1 + value) END")} AS Tl_value,
       CAST(coalesce(length(props), 0) AS INTEGER) AS Len_props,
       CAST(nullif(props, '') IS NULL AS INTEGER) AS props_missing,
       {R("coalesce(m.f, 0.0)")} AS Rfreq_event_type
FROM events LEFT JOIN m ON events.event_type = m.level
"""


@query("st_events_rowwise", _SQL)
def st_events_rowwise(spark, d):
    """Structured Streaming: events read as a stream, special log / log1p /
    length / blank flags per row and the batch-fitted frequency of the event
    type (stream-static broadcast join), drained into a checkpointed Parquet
    sink and read back."""
    model, rows = rowwise.fit_event_frequency(read_table(spark, d, "events"))
    out = rowwise.run_to_parquet(rowwise.rowwise_features(rowwise.stream_table(spark, d, "events"),
                                                          model, rows), "events-rowwise")
    return rounded(spark.read.parquet(out))
