"""An assessment from a profiled source folder to an output folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import read_allow_lists, read_analysed_source, read_metadata
from ..sources.writers import copy_source_quality, store
from .assess import SourceMetadata, assess, write_assessment
from .config import AssessmentConfig

QUALITY_PREFIX = "TIMELINESS_"


def metadata_timestamps(table: DataFrame | None) -> dict[str, str]:
    """Timestamp columns and their formats from the timelinessMetadata row."""
    row = table.first() if table is not None else None
    if row is None:
        return {}
    names = [name.removeprefix(QUALITY_PREFIX) for name in row.timelinessNames]
    return dict(zip(names, row.timeFormats))


def with_metadata(config: AssessmentConfig, information, formats: dict[str, str]) -> AssessmentConfig:
    """The configuration with what it leaves open filled in from the source's own metadata.

    ``information`` is the preliminary_information row or None: default volatility and the
    allow-lists of the last refresh. ``formats`` gives the timestamp columns where the
    configuration names none, and the formats that are missing there.
    """
    known = {name: fmt for name, fmt in formats.items() if name in config.columns}
    times = {name: fmt or known.get(name) for name, fmt in config.timestamps.items()} or known
    found = {"timestamps": times}
    if information is not None:
        if config.default_volatility_hours is None:
            found["default_volatility_hours"] = _number(information.volatiliy)
        if config.refreshed_allow_list_names is None:
            found["refreshed_allow_list_names"] = information.consistencyRuleFiles
    return replace(config, **found)


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def read_source_metadata(spark: SparkSession, folder: str, timestamps: Sequence[str]) -> SourceMetadata:
    """The metadata tables beside a source; absent ones are left out."""

    def rates(table: str) -> dict[str, DataFrame]:
        found = {name: read_metadata(spark, folder, table, name) for name in timestamps}
        return {name: rate for name, rate in found.items() if rate is not None}

    return SourceMetadata(
        update_rate_global=rates("update_rate_global"),
        update_rate_values=rates("update_rate_values"),
        source_distinctness=read_metadata(spark, folder, "source_distinctness"),
        association_rules=read_metadata(spark, folder, "association_rules"),
    )


def assess_folder(
    spark: SparkSession,
    folder: str,
    output: str,
    config: AssessmentConfig,
    now: dt.datetime | str,
    header: Sequence[str] | None = None,
    files: Sequence[str] | None = None,
    regex: str | None = None,
    source_summary: bool = False,
    **text_options,
) -> dict[str, DataFrame]:
    """Read the analysed updates of a source, assess them and write every table.

    ``header`` names all columns of the source; ``files`` restricts the updates; a
    ``regex`` reads the raw text updates instead of JSON rows; ``config.allow_list_names``
    are paths. What is not given (header, regex, timestamp columns and formats, default
    volatility, the allow-lists of the last refresh) comes from the metadata beside the
    source; what is given wins. ``source_summary`` only copies the stored quality report. The rows
    are parsed once and kept as parquet in the shared folder.
    """
    if source_summary:
        copy_source_quality(spark, folder, output)
        return {}
    found = read_metadata(spark, folder, "preliminary_information")
    information = found.first() if found is not None else None
    if header is None:
        header = information.header if information is not None else None
        if not header:
            raise ValueError(f"no header given and none in {folder}/preliminary_information")
    if regex is None:
        regex = (information.regex if information is not None else None) or ""
    config = with_metadata(config, information, metadata_timestamps(read_metadata(spark, folder, "timelinessMetadata")))
    source = store(read_analysed_source(spark, folder, header, files, regex, **text_options), "source")
    metadata = read_source_metadata(spark, folder, list(config.timestamps))
    allow_lists = read_allow_lists(spark, config.allow_list_names, config.columns)
    tables = assess(source, config, now, metadata, allow_lists)
    write_assessment(tables, output)
    return tables
