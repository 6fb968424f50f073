from .readers import (
    METADATA_SCHEMAS,
    analysed_files,
    read_allow_lists,
    read_analysed_source,
    read_metadata,
    read_rows,
    read_text_lines,
    structure_text,
    text_schema,
)
from .writers import (
    copy_source_quality,
    shared_folder,
    store,
    stored_tables,
    write_extended,
    write_json,
    write_text,
)

__all__ = [name for name in dir() if not name.startswith("_")]
