"""lograin: distil raw logs into countable facts with Spark DataFrames."""

from lograin.params import Integration, Params

__all__ = ["Integration", "Params"]
