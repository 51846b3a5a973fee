"""Plan-level helpers (joins, quantiles, storage) and the end-to-end jobs."""
