"""loomgraph: property-graph analytics and training-data operators, built on Spark DataFrames."""

__version__ = "0.1.0"
