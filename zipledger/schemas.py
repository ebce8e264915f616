"""Fixed schemas of the catalogue tables and of the executor-side readers."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampType,
)

# One row per registered archive (+ partition column scan_id).
ARCHIVES = StructType([
    StructField("archive_uuid", StringType(), False),
    StructField("drive", StringType(), False),
    StructField("archive_name", StringType(), False),
    StructField("archive_path", StringType(), False),
    StructField("file_size", LongType(), True),
    StructField("file_hash", StringType(), True),
    StructField("last_modified", TimestampType(), True),
    StructField("scan_date", TimestampType(), False),
    StructField("scan_seq", LongType(), False),
])

# One row per catalogued entry (+ partition column scan_id).
ENTRIES = StructType([
    StructField("archive_uuid", StringType(), False),
    StructField("file_name", StringType(), False),
    StructField("file_size", LongType(), False),
    StructField("path_in_archive", StringType(), False),
    StructField("entry_ordinal", IntegerType(), False),
    StructField("file_hash", StringType(), True),
    StructField("created_at", TimestampType(), False),
    StructField("compressed_size", LongType(), True),
    StructField("entry_mtime", TimestampType(), True),
    StructField("crc32", LongType(), True),
    StructField("header_offset", LongType(), True),
    StructField("compress_type", IntegerType(), True),
])

# What a run's entries of one archive add up to; rows of several runs can be added again.
ARCHIVE_TOTALS = StructType([
    StructField("archive_uuid", StringType(), False),
    StructField("entries", LongType(), False),
    StructField("total_size", LongType(), True),
    StructField("min_size", LongType(), True),
    StructField("max_size", LongType(), True),
    StructField("compressed", LongType(), True),
])

# Archives that could not be read (the reference only logs these).
SCAN_ERRORS = StructType([
    StructField("archive_path", StringType(), False),
    StructField("drive", StringType(), True),
    StructField("error_class", StringType(), False),
    StructField("error_message", StringType(), True),
])

# Every archive a scan has looked at, and what came of it.
SCAN_PROGRESS = StructType([
    StructField("archive_path", StringType(), False),
    StructField("file_size", LongType(), True),
    StructField("last_modified", TimestampType(), True),
    StructField("status", StringType(), False),   # done, no_targets or error
])

# One row per scan.
SCAN_METRICS = StructType([
    StructField("total_drives", LongType(), True),
    StructField("total_zip_files", LongType(), True),
    StructField("total_video_files", LongType(), True),
    StructField("total_size_bytes", LongType(), True),
    StructField("scan_duration_seconds", DoubleType(), True),
])

# Published runs: readers see, of every scan, the run published last.
MANIFEST = StructType([
    StructField("scan_id", StringType(), False),
    StructField("run_id", StringType(), False),
    StructField("published_at", TimestampType(), False),
])

# Archives whose rows of earlier runs are void: a refresh found them changed or deleted.
RETIRED = StructType([
    StructField("archive_uuid", StringType(), False),
])

# Output of the listing step: one row per candidate archive file.
LISTING = StructType([
    StructField("root", StringType(), False),
    StructField("drive", StringType(), True),
    StructField("archive_path", StringType(), False),
    StructField("archive_name", StringType(), False),
    StructField("file_size", LongType(), True),
    StructField("last_modified", TimestampType(), True),
])

# Rows emitted by the central-directory reader (mapInPandas).
RAW_ENTRIES = StructType([
    StructField("archive_path", StringType(), False),
    StructField("drive", StringType(), True),
    StructField("entry_ordinal", IntegerType(), True),
    StructField("path_in_archive", StringType(), True),
    StructField("file_size", LongType(), True),
    StructField("compressed_size", LongType(), True),
    StructField("entry_mtime", TimestampType(), True),
    StructField("crc32", LongType(), True),
    StructField("header_offset", LongType(), True),
    StructField("compress_type", IntegerType(), True),
    StructField("error_class", StringType(), True),
    StructField("error_message", StringType(), True),
])

# Rows emitted by the directory walker (mapInPandas), one per directory child.
WALK = StructType([
    StructField("root", StringType(), False),
    StructField("drive", StringType(), True),
    StructField("parent", StringType(), False),
    StructField("name", StringType(), False),
    StructField("path", StringType(), False),
    StructField("is_dir", BooleanType(), False),
    StructField("is_file", BooleanType(), False),
    StructField("file_size", LongType(), True),
    StructField("mtime", DoubleType(), True),
    StructField("depth", IntegerType(), False),
    StructField("descend", BooleanType(), False),
    StructField("error", StringType(), True),
    StructField("chain", ArrayType(StringType()), True),
])

# Rows emitted by the extractor (mapInPandas).
EXTRACT_RESULT = StructType([
    StructField("plan_pos", LongType(), False),
    StructField("archive_path", StringType(), False),
    StructField("path_in_archive", StringType(), False),
    StructField("entry_ordinal", IntegerType(), True),
    StructField("output_path", StringType(), False),
    StructField("status", StringType(), False),
    StructField("bytes_written", LongType(), True),
    StructField("sha256", StringType(), True),
    StructField("error_message", StringType(), True),
])

# Rows emitted by the content hasher (mapInPandas).
HASHED = StructType([
    StructField("archive_path", StringType(), False),
    StructField("path_in_archive", StringType(), False),
    StructField("entry_ordinal", IntegerType(), False),
    StructField("archive_uuid", StringType(), True),
    StructField("file_size", LongType(), True),
    StructField("content_hash", StringType(), True),
    StructField("error_message", StringType(), True),
])
