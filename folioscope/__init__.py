"""folioscope: analytics over collections of books and documents, on Spark DataFrames."""

__version__ = "0.1.0"
