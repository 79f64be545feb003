"""Client-engagement features, scoring and model monitoring as Spark plans.

Every public operator takes DataFrames plus an explicit ``as_of`` clock and
returns a lazy DataFrame; nothing is collected unless a docstring says so.
"""

__version__ = "0.1.0"
