"""tabscope – Spark-native table profiling, insights and model training.

Every operator takes DataFrames and returns DataFrames; planning is left to
Catalyst. See README.md for the operator map.
"""

from .session import checkpoint_dir, configure, get_spark
from .types import ColumnClasses, classify

__all__ = ["get_spark", "configure", "checkpoint_dir", "classify", "ColumnClasses"]
