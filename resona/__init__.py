"""Community-comment analytics around a product release, written as Spark DataFrame operators."""

__version__ = "0.1.0"
