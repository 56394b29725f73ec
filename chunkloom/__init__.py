"""chunkloom: adaptive, self-describing columnar encodings on PySpark."""

__version__ = "0.1.0"
