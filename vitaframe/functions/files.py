"""Checks and labels for file names, sizes and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions.text import basename, drop_nulls

# What may be uploaded.
ALLOWED_EXTENSIONS = ("pdf", "docx")
MAX_FILE_SIZE = 10 * 1024 * 1024
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
PARSEABLE = ("docx", "pdf", "txt")


def extension(name: Column) -> Column:
    """Text after the last dot, lower case; the whole name where there is no dot."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def suffix(path: Column) -> Column:
    """``.pdf`` as path libraries see it: empty for ``.pdf``, ``name`` and ``name.``."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def has_allowed_extension(name: Column, allowed=ALLOWED_EXTENSIONS) -> Column:
    return F.coalesce(F.contains(name, F.lit(".")) & extension(name).isin(*allowed), F.lit(False))


def has_allowed_size(size: Column, limit: int = MAX_FILE_SIZE) -> Column:
    return F.coalesce(size.between(1, limit), F.lit(False))


def upload_errors(name: Column, size: Column, limit: int = MAX_FILE_SIZE) -> Column:
    """All reasons why a file cannot be taken, as an array of messages."""
    dotted = F.concat(F.lit("."), F.when(F.contains(name, F.lit(".")), extension(name)).otherwise(""))
    allowed = " or ".join(f".{e}" for e in ALLOWED_EXTENSIONS)
    mega = 1024 * 1024
    return drop_nulls(
        F.when(
            ~dotted.isin(*[f".{e}" for e in ALLOWED_EXTENSIONS]),
            F.concat(F.lit('File type "'), dotted, F.lit(f'" is not supported. Please upload {allowed} files.')),
        ),
        F.when(
            size > limit,
            F.concat(
                F.lit("File size ("),
                F.floor(size / mega + 0.5).cast("string"),
                F.lit(f"MB) exceeds the maximum limit of {round(limit / mega)}MB."),
            ),
        ),
        F.when(size == 0, F.lit("File appears to be empty. Please select a valid file.")),
    )


def mime_type(name: Column) -> Column:
    out = None
    for ext, mime in MIME_TYPES.items():
        hit = extension(name) == ext
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out.otherwise("application/octet-stream")


def detect_type(path: Column, mime: Column | None = None) -> Column:
    """docx / pdf / txt / unknown from the suffix, else from a MIME type if one is known."""
    tail = suffix(path)
    out = F.when(tail == ".docx", "docx").when(tail == ".pdf", "pdf").when(tail.isin(".txt", ".text"), "txt")
    if mime is not None:
        out = (
            out.when(mime.rlike("openxmlformats|wordprocessingml"), "docx")
            .when(F.contains(mime, F.lit("pdf")), "pdf")
            .when(F.contains(mime, F.lit("text")), "txt")
        )
    return out.otherwise("unknown")


def type_of_name(name: Column) -> Column:
    """Type recorded in a profile: also knows ``doc`` and ``text``."""
    ext = F.when(F.contains(name, F.lit(".")), extension(name)).otherwise("")
    return (
        F.when(ext.isin("docx", "doc"), "docx")
        .when(ext == "pdf", "pdf")
        .when(ext.isin("txt", "text"), "txt")
        .otherwise("unknown")
    )


def is_parseable(path: Column, size: Column, mime: Column | None = None, limit: int = MAX_FILE_SIZE) -> Column:
    """May a listed file be parsed? Listings only hold existing plain files."""
    return path.isNotNull() & (size <= limit) & detect_type(path, mime).isin(*PARSEABLE)


def storage_path(run_id: Column, name: Column, at: Column) -> Column:
    """``original/YYYY/MM/run_id/name`` below the data folder."""
    return F.concat_ws("/", F.lit("original"), F.date_format(at, "yyyy"), F.date_format(at, "MM"), run_id, name)
