"""Technical indicators. Importing this package fills the registry."""

from tessera.operators.indicators import candles, extended, recursive, rolling  # noqa: F401
