"""rebound: decline-recovery analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns) and keeps the work
inside Spark: labels from retry chains, metrics, drift, retry decisions,
explanations, and Structured Streaming twins of the batch operators.
"""

from rebound.roles import Roles
from rebound.session import checkpoint_dir, get_spark

__all__ = ["Roles", "checkpoint_dir", "get_spark"]
