"""User-level jobs composed from operators: payables, reconciliation, reports."""
