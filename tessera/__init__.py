"""Factor research on Spark: panels keyed by (code, dt), expressed as DataFrame plans."""

__version__ = "0.1.0"
