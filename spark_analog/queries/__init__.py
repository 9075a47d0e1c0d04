"""Importing this package registers every query."""

from spark_analog.queries import (  # noqa: F401
    q_clean, q_detect, q_events, q_fusion, q_ledger, q_score, q_windows,
)
