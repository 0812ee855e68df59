"""corvane: corpus curation and hybrid search over record tables, on Spark DataFrames."""

from corvane.session import build_session

__all__ = ["build_session"]
