"""Typed-graph scoring and evaluation as plain Spark DataFrame operators.

Every operator takes DataFrames plus ``keys``: the grouping columns that tell
independent graphs, proposals, replicates or runs apart.  All of them are
evaluated in one plan; nothing loops over groups on the driver.
"""

__version__ = "0.1.0"
