"""Document-to-graph extraction on Spark: workflows compiled to DataFrame plans."""

__version__ = "0.1.0"
