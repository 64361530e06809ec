"""Readers, panel views and storage layouts."""
