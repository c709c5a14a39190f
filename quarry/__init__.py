"""quarry: profiling, cleaning and chart-data operators for Spark DataFrames.

Every operator is a plain function ``DataFrame (+ parameters) -> DataFrame`` built from
built-in Spark expressions, so Catalyst plans it and the work stays on the executors.
"""

from quarry.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
