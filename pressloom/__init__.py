"""pressloom: document analytics for news-like text, expressed as Spark plans."""

__version__ = "0.1.0"
