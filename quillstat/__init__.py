"""Statistical data processing on Spark: missing-value-aware frames, transformations, file combination and procedures."""

from quillstat.frame import Frame, Missing

__all__ = ["Frame", "Missing"]
