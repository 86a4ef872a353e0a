"""quarry: a Spark-first analytics and data-preparation engine.

Operators take DataFrames with explicit key and order columns and return
DataFrames; nothing in the hot path leaves the JVM unless the semantics need it.
"""

__version__ = "0.1.0"
