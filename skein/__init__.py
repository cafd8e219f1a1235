"""Static analysis of JavaScript and HTML corpora on Spark."""

__version__ = "0.1.0"
