"""Column-level building blocks: scalar, rolling and cross-section functions."""
