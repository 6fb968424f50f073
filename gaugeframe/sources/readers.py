"""Reading a profiled source: rows, update catalogue, metadata tables, allow-lists."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decimal_commas_to_dots, strip_backslashes, strip_quotes
from .writers import store

ON_MISMATCH = ("fail", "null")


def text_schema(header: Sequence[str]) -> T.StructType:
    """Every column as nullable text."""
    return T.StructType([T.StructField(name, T.StringType(), True) for name in header])


def read_rows(
    spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], on_malformed: str = "fail"
) -> DataFrame:
    """JSON Lines rows with an all-text schema; no inference pass.

    A line that is no JSON object raises; with ``on_malformed="null"`` it is a row of NULLs.
    """
    if on_malformed not in ON_MISMATCH:
        raise ValueError(f"on_malformed must be one of {ON_MISMATCH}")
    reader = spark.read.schema(text_schema(header)).option("mode", "FAILFAST" if on_malformed == "fail" else "PERMISSIVE")
    return reader.json(paths if isinstance(paths, str) else list(paths))


def read_text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines in one column ``value``."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths))


def structure_text(
    lines: DataFrame,
    regex: str,
    header: Sequence[str],
    decimal_commas: bool = True,
    on_mismatch: str = "fail",
    line_column: str = "value",
) -> DataFrame:
    """Lines to named text columns: every regex match of a line is a field.

    Order: strip quotes, drop empty lines, strip backslashes, decimal commas to dots
    (also between number fields and in time fractions, hence the switch), find matches,
    name them by position. A line with another number of matches raises; with
    ``on_mismatch="null"`` missing fields are NULL and extra ones are ignored.
    """
    if on_mismatch not in ON_MISMATCH:
        raise ValueError(f"on_mismatch must be one of {ON_MISMATCH}")
    groups = re.compile(regex).groups
    if groups > 1:
        raise ValueError("the regex may have at most one group")
    cleaned = lines.select(strip_quotes(F.col(line_column)).alias("line")).filter(F.length("line") > 0)
    text = strip_backslashes(F.col("line"))
    if decimal_commas:
        text = decimal_commas_to_dots(text)
    fields = F.regexp_extract_all(text, F.lit(regex), F.lit(groups))
    if on_mismatch == "fail":
        found = F.concat(F.lit(f"expected {len(header)} fields, found "), F.size("fields").cast("string"))
        checked = F.when(F.size("fields") == len(header), F.col("fields")).otherwise(F.raise_error(found))
    else:
        checked = F.col("fields")
    return (
        cleaned.select(fields.alias("fields"))
        .select(checked.alias("fields"))
        .select(*[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(header)])
    )


def analysed_files(catalogue: DataFrame, requested: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """``fileName`` of correctly analysed updates, optionally only requested ones."""
    done = catalogue.filter(F.col("correctAnalysis") == 1).select("fileName")
    if requested is None:
        return done
    if isinstance(requested, DataFrame):
        return done.join(requested.select("fileName"), "fileName", "left_semi")
    names = list(requested)
    return done.filter(F.col("fileName").isin(*names)) if names else done


def _below(root: str) -> Column:
    """The part of ``file_path`` that lies below a folder, whatever scheme either is written with."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    plain = posixpath.normpath(re.sub(scheme, "", root))
    marker = plain if plain.startswith("/") else "/" + re.sub(r"^(\.\./)+", "", plain)
    marker = marker.rstrip("/") + "/"
    # Spark reports a path as URI; url_decode would also take a plus for a blank.
    path = F.url_decode(F.replace(F.regexp_replace("file_path", scheme, ""), F.lit("+"), F.lit("%2B")))
    return F.substr(path, F.locate(marker, path) + F.lit(len(marker)))


def update_files(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """``file_key`` (hash of the path) of every file below ``root`` that belongs to a named update.

    An update is a file or a folder of files; ``names`` holds their paths below the root in
    a column ``owner``. Files are listed, not read, and met with the names as tables: each
    file offers every leading part of its path. Spark lists no file without content, so a named
    update without any is looked up by its own path, one after another: an absent one raises.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = listed.select(F.col("_metadata.file_path").alias("file_path"))
    files = store(listed.select("file_path", F.xxhash64("file_path").alias("file_key")), "source-files")
    known = files.agg(F.count_distinct("file_path").alias("paths"), F.count_distinct("file_key").alias("keys")).first()
    if known.paths != known.keys:
        raise ValueError(f"two files below {root} have one hash; name the updates to read")
    steps = F.split(_below(root), "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, F.lit(1), n)))
    owned = files.select(F.explode(leading).alias("owner"), "file_key")
    found = store(names.select("owner").distinct().join(owned, "owner", "left"), "source-updates")
    for bare in found.filter(F.col("file_key").isNull()).toLocalIterator():
        read_text_lines(spark, f"{root}/{bare.owner}")
    return store(found.filter(F.col("file_key").isNotNull()).select("file_key").distinct(), "source-file-keys")


def read_analysed_source(
    spark: SparkSession,
    folder: str,
    header: Sequence[str],
    requested: Sequence[str] | DataFrame | None = None,
    regex: str = "",
    **text_options,
) -> DataFrame:
    """The analysed updates of a source folder: JSON rows, or text lines with a regex.

    Updates that the caller lists by name are the paths of one read, so nothing else is
    touched. Without such a list the folder is read as a whole and its lines meet the files
    of analysed updates on a hash of their path: no name comes to the driver. The hashes
    are stored, eight bytes a file, so Spark broadcasts them up to about a million files and
    the lines are not shuffled; beyond its threshold it is a sort-merge join. Lines of
    other updates are dropped before they are parsed, so a malformed one there is harmless.
    """
    catalogue = spark.read.schema("fileName string, correctAnalysis int").json(
        f"{folder}/source_analysed_updates"
    )
    done = analysed_files(catalogue, requested).distinct()
    part, suffix = ("updates", ".txt") if regex else ("extended_dataset", "")
    root = f"{folder}/{part}"
    if requested is not None and not isinstance(requested, DataFrame) and len(requested):
        paths = [f"{root}/{row.fileName}{suffix}" for row in done.collect()]
        if not paths:
            raise ValueError(f"no correctly analysed update in {folder}")
        if regex:
            return structure_text(read_text_lines(spark, paths), regex, header, **text_options)
        return read_rows(spark, paths, header)
    if done.isEmpty():
        raise ValueError(f"no correctly analysed update in {folder}")
    wanted = update_files(spark, root, done.select(F.concat("fileName", F.lit(suffix)).alias("owner")))
    everything = spark.read.option("recursiveFileLookup", True).text(root)
    lines = everything.select("value", F.xxhash64("_metadata.file_path").alias("file_key"))
    lines = lines.join(wanted, "file_key", "left_semi").select("value")
    if regex:
        return structure_text(lines, regex, header, **text_options)
    fields = F.from_json("value", text_schema(header), {"mode": "FAILFAST"})
    return lines.filter(F.trim("value") != "").select(fields.alias("fields")).select("fields.*")


# The metadata tables beside a source and their schemas.
METADATA_SCHEMAS = {
    "preliminary_information": "header array<string>, regex string, volatiliy string, consistencyRuleFiles array<string>",
    "timelinessMetadata": "timelinessNames array<string>, timeFormats array<string>",
    "update_rate_global": "Hour int, Frequency double",
    "update_rate_values": "Key string, Value string, Hour int, Frequency double",
    "source_distinctness": "Attribute string, Count bigint",
    "association_rules": "Antecedent string, Consequent string",
}


def read_metadata(
    spark: SparkSession, folder: str, table: str, column: str | None = None, required: bool = False
) -> DataFrame | None:
    """A metadata table by name (update rates also by column); None when it is absent."""
    name = f"{table}_{column}" if column else table
    try:
        return spark.read.schema(METADATA_SCHEMAS[table]).json(f"{folder}/{name}")
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_allow_lists(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] | None = None,
    schemas: Mapping[str, Sequence[str]] | None = None,
) -> list[DataFrame]:
    """Allow-lists (JSON) whose columns are all among ``columns``; absent files are skipped.

    A malformed line raises. ``schemas`` names the columns of a list by path, which saves the
    reading of a long list to infer them.
    """
    out = []
    for path in paths:
        reader = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST")
        if schemas and path in schemas:
            reader = reader.schema(text_schema(schemas[path]))
        try:
            table = reader.json(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if columns is None or (table.columns and set(table.columns) <= set(columns)):
            out.append(table)
    return out
