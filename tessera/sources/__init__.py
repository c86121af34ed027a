"""Readers, writers and dataset assembly."""

from tessera.sources.io import (  # noqa: F401
    read_csv, split_labelled, submission, union_train_test, with_type_override, write_csv,
    write_submission,
)
from tessera.sources.tables import (  # noqa: F401
    CLAIMS_SQL, TABLES, claims_view, lineitem_view, read_table,
)
