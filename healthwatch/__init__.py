"""healthwatch — pipeline-health analytics on Spark.

Learns a per-field statistical baseline of an event table, detects outliers,
distribution drift, schema drift, key floods, stalls and telemetry spikes,
folds alerts into an incident with a repair plan, applies repairs as
DataFrame rewrites and re-validates the result.  Every operator is a pure
``DataFrame -> DataFrame`` function that Catalyst plans; the same functions
run inside Structured Streaming micro-batches.
"""

from healthwatch.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
