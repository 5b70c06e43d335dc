"""Analytics over source-code workspaces, text and graphs, on Spark DataFrames."""

__version__ = "0.1.0"
