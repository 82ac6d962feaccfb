"""Data-integrity forensics and training-data operators on Spark DataFrames."""

from __future__ import annotations

import os


def _share_path() -> None:
    """Lets Python workers import this package where it is used from a checkout: by the environment that Spark's JVM inherits, or by the running context's."""
    from pyspark import SparkContext

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = SparkContext._active_spark_context
    for env in (os.environ, *([sc.environment] if sc is not None else [])):
        known = env.get("PYTHONPATH", "").split(os.pathsep)
        if root not in known:
            env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


_share_path()
