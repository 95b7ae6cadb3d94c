"""A PySpark engine for investigating audit events as a provenance graph."""
