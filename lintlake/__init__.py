"""Code-findings analytics on Spark: corpus -> facts -> issues -> reports -> warehouse."""

__version__ = "0.1.0"
