"""Entity resolution and data fusion as Spark DataFrame algebra."""

__version__ = "0.1.0"
