"""weft: training-data, rollout, scoring and telemetry tables as PySpark DataFrame jobs."""
