"""Sources and sinks: training tables from the parquet folders, LIBSVM text, model tables."""
