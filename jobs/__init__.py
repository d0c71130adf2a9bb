"""Runnable jobs over the library: ``python -m jobs.NAME --help``."""
