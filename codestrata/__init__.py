"""Spark analytics over facts about software: files, functions, calls, runs, advisories, vectors."""

__version__ = "0.1.0"
