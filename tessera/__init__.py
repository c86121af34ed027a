"""tessera: a Spark-native toolkit for profiling, encoding, imputing and scoring
wide, partly missing, mixed-type tables.

Every operator is a function ``DataFrame -> DataFrame`` (plus keyword options)
built from Spark SQL expressions, joins, aggregates and windows, so it runs
distributed. Fitted state (encoder tables, scaler ranges, quantiles) is itself a
DataFrame or a handful of driver-side scalars whose size is bounded by the
number of columns, never by the number of rows.

Sub-packages
------------
sources    readers, writers and dataset assembly (train/test union and split)
functions  row-level Column expressions (logs, string items, row shares, hashes)
operators  fitted and aggregate operators (profiling, association, encoders,
           transforms, imputation, folds, metrics, selection, MLlib models)
plans      multi-step feature pipelines and the registered query catalogue
streaming  row-wise operators and fitted lookups applied to streaming frames
"""

from tessera.session import get_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
