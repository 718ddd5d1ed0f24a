"""Local media references in text: extraction, path normalisation, MIME types, upload manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import SPACE
from tracewright.functions.text import QUOTES, WORD_START, texts
from tracewright.options import PART_SIZE_BYTES

# Fixed: extension -> MIME type.
MIME_TYPES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
    "svg": "image/svg+xml",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "m4a": "audio/mp4",
    "aac": "audio/aac",
    "ogg": "audio/ogg",
    "oga": "audio/ogg",
    "flac": "audio/flac",
    "opus": "audio/opus",
    "caf": "audio/x-caf",
    "weba": "audio/webm",
    "webm": "video/webm",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "mkv": "video/x-matroska",
}
OTHER_MIME = "application/octet-stream"

_EXT = "(?:" + "|".join(MIME_TYPES) + ")"
_REF = f"[^{SPACE}{QUOTES}]"
_STOP = f"(?=[{SPACE}{QUOTES}]|\\z)"

# Fixed patterns: the three explicit ways to point at a local file. A bare path does not count.
MEDIA_SCHEME = rf"(?i){WORD_START}media:((?:~/|/|[A-Za-z]:[/\\]){_REF}+?\.{_EXT}){_STOP}"
FILE_SCHEME = rf"(?i){WORD_START}file://((?:~/|/){_REF}+?\.{_EXT})(?:\?{_REF}*)?{_STOP}"
MARKDOWN_LINK = (
    rf"(?i)!?\[[^\]]*\]\((?:file://)?((?:~/|/)[^){SPACE}]+?\.{_EXT})(?:\?[^){SPACE}]*)?"
    rf"(?:[{SPACE}]+[\"'][^\"']*[\"'])?\)"
)


def percent_decode(value: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus, and an invalid escape leaves the text as it is."""
    kept = F.replace(value, F.lit("+"), F.lit("%2B"))
    decoded = F.try_url_decode(kept)
    # The decoder turns malformed UTF-8 into replacement characters; the source counts that as invalid.
    broken = decoded.contains("\uFFFD") & ~F.upper(value).contains("%EF%BF%BD") & ~value.contains("\uFFFD")
    return F.when(value.contains("%"), F.coalesce(F.when(~broken, decoded), value)).otherwise(value)


def _folded(path: Column) -> Column:
    """``.`` and ``..`` and empty steps resolved, without a trailing slash."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    steps = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        ).otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def extension(path: Column) -> Column:
    """The lower-case extension of the last path step, empty when it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^/.]*)\z", 1))


def normalize_path(candidate: Column, home: str) -> Column:
    """An absolute path with a known media extension, or null."""
    path = F.regexp_replace(candidate, f"^[{SPACE}]+|[{SPACE}]+\\z", "")
    path = F.regexp_replace(path, r"[),.;:]+\z", "")
    expanded = F.when(path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substr(path, F.lit(3)))).when(
        path.startswith("/"), path
    )
    # Drive paths are absolute already; their steps are folded below the drive.
    drive = path.rlike(r"\A[A-Za-z]:[/\\]")
    tail = F.replace(F.substr(path, F.lit(3)), F.lit("\\"), F.lit("/"))
    folded = F.when(expanded.isNotNull(), _folded(expanded)).when(
        drive, F.concat(F.substring(path, 1, 2), F.replace(_folded(tail), F.lit("/"), F.lit("\\")))
    )
    return F.when(extension(folded).isin(*MIME_TYPES), folded)


def media_refs(text: Column) -> Column:
    """Raw references in one text: media scheme, file scheme, markdown links, in that order."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(MEDIA_SCHEME), F.lit(1)),
        F.transform(F.regexp_extract_all(text, F.lit(FILE_SCHEME), F.lit(1)), percent_decode),
        F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1)), percent_decode),
    )
    # Three regex passes only on text that can hold a reference.
    return F.when(_could_refer(text), found).otherwise(F.array().cast("array<string>"))


def _could_refer(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("media:") | low.contains("file://") | text.contains("](")


def media_paths(text: Column, home: str) -> Column:
    """The distinct normalised paths one text points at."""
    paths = F.transform(media_refs(text), lambda ref: normalize_path(ref, home))
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))


def payload_paths(payload: Column, home: str) -> Column:
    """The distinct normalised paths a payload points at: all string values of JSON, or a plain text."""
    escaped = payload.contains(chr(92) + "u") | payload.contains(chr(92) + "/")
    found = F.flatten(F.transform(texts(payload, _could_refer(payload) | escaped), lambda leaf: media_paths(leaf, home)))
    return F.array_distinct(found)


def extract_media(
    df: DataFrame, entity: list[str], payloads: list[str], home: str, distinct: bool = True
) -> DataFrame:
    """One row per (entity, path), over all payload columns of the entity's rows.

    The string values of JSON payloads are searched, decoded, and plain texts whole; keys are not. Duplicates are
    dropped before the shuffle too.
    """
    every = F.array_distinct(
        F.flatten(F.array(*[payload_paths(F.coalesce(F.col(p), F.lit("")), home) for p in payloads]))
    )
    found = df.select(*entity, F.explode(every).alias("path"))
    return found.dropDuplicates([*entity, "path"]) if distinct else found


def mime_table(spark: SparkSession) -> DataFrame:
    """The fixed extension table, one row per extension."""
    return spark.createDataFrame(list(MIME_TYPES.items()), "ext string, mime string")


def with_mime(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``mime``; the table holds 25 rows, whatever the data."""
    dimension = F.broadcast(mime_table(df.sparkSession))
    joined = df.withColumn("_ext", extension(F.col(path))).join(dimension, F.col("_ext") == F.col("ext"), "left")
    return joined.withColumn("mime", F.coalesce("mime", F.lit(OTHER_MIME))).drop("_ext", "ext")


def media_manifest(references: DataFrame, files: DataFrame) -> DataFrame:
    """What would be uploaded: one row per (entity, path) of a non-empty file, with its part plan.

    ``references``: entity_type, entity_id, path. ``files``: path, size.
    """
    size = F.col("size")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(size / F.lit(float(PART_SIZE_BYTES))))
    on_drive = F.col("path").rlike(r"\A[A-Za-z]:")
    base = F.regexp_extract(
        F.when(on_drive, F.replace("path", F.lit("\\"), F.lit("/"))).otherwise(F.col("path")), r"([^/]*)\z", 1
    )
    return with_mime(
        references.dropDuplicates(["entity_type", "entity_id", "path"]).join(files.where(size > 0), "path")
    ).select(
        "entity_type",
        "entity_id",
        "path",
        F.when(base == "", F.lit("attachment.bin")).otherwise(base).alias("file_name"),
        "mime",
        "size",
        parts.alias("part_count"),
        (size - (parts - 1) * PART_SIZE_BYTES).alias("last_part_size"),
    )
