"""textloom: text reduction, retrieval and cost accounting as Spark DataFrame plans."""

__version__ = "0.1.0"
