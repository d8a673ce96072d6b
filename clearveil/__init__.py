"""Spark-native sensitive-data verification engine.

The package is organised by role: ``sources`` turn stored things into located
units of text, ``functions`` hold scalar Column functions, ``operators`` hold
relational operators on DataFrames, ``plans`` compose operators into queries,
``streaming`` holds the incremental mode.
"""

__version__ = "0.1.0"
