"""modelwatch: explain why deployed models get worse, as Spark DataFrame jobs."""

__version__ = "0.1.0"
