"""Data quality and per-person summaries for keyed clinical event tables on Spark."""

from vitalsift.config import JobConfig
from vitalsift.specs import MODEL, WIDE_MODEL, ForeignKey, Model, TableSpec, build_model

__all__ = ["MODEL", "WIDE_MODEL", "ForeignKey", "JobConfig", "Model", "TableSpec", "build_model"]
