from .assess import (
    BOUNDED_TABLES,
    SourceMetadata,
    assess,
    extended_dataset,
    final_quality,
    long_report,
    mean_confidence,
    write_assessment,
)
from .config import DIMENSIONS, GRANULARITIES, AssessmentConfig
from .folder import assess_folder, metadata_timestamps, read_source_metadata

__all__ = [name for name in dir() if not name.startswith("_")]
