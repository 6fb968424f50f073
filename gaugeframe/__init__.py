"""Data-quality assessment of large tables with Spark DataFrames."""

from .operators import AccuracyTarget, TimeColumn
from .plans import AssessmentConfig, SourceMetadata, assess, assess_folder, final_quality, write_assessment

__all__ = [
    "AccuracyTarget",
    "AssessmentConfig",
    "SourceMetadata",
    "TimeColumn",
    "assess",
    "assess_folder",
    "final_quality",
    "write_assessment",
]
