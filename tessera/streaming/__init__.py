"""Row-wise operators and fitted lookups on Structured Streaming frames."""

from tessera.streaming.rowwise import (  # noqa: F401
    fit_event_frequency, rowwise_features, run_to_parquet, stream_table,
)
