"""Which files are text worth indexing, and how old and new states compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SIZE = 64 << 20

#: Extensions of formats that are never text, fixed values
BINARY_EXTENSIONS = (
    "pdf", "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "tif", "tiff", "psd", "svgz",
    "zip", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "jar", "war", "tar", "lz4",
    "woff", "woff2", "ttf", "otf", "eot",
    "mp3", "mp4", "m4a", "mov", "avi", "mkv", "wav", "ogg", "flac", "webm",
    "exe", "dll", "so", "dylib", "a", "o", "obj", "lib", "class", "pyc", "pyo", "wasm", "bin", "dat", "db", "sqlite", "sqlite3", "parquet", "arrow",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp",
    "dmg", "iso", "img", "pkl", "npy", "npz", "h5", "hdf5", "onnx", "pb", "pt", "safetensors",
)


def too_large(size: Column) -> Column:
    return size > MAX_SIZE


def binary_name(path: Column) -> Column:
    """By the last extension; a name that only starts with a dot has none."""
    extension = F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+\.([^.]*)$", 1)
    return F.lower(extension).isin(*BINARY_EXTENSIONS)


def _head(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 8192), "ISO-8859-1")


def has_nul(content: Column) -> Column:
    return F.instr(_head(content), "\0") > 0


def has_control(content: Column) -> Column:
    """More than one control byte in twenty of the first 8192."""
    head = _head(content)
    return F.regexp_count(head, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")) * 20 > F.length(head)


def binary_content(content: Column) -> Column:
    return has_nul(content) | has_control(content)


#: What ``has_control`` counts, as bytes.
_CONTROL = bytes(b for b in range(32) if b not in b"\t\n\r") + b"\x7f"


def head_reason(head: bytes) -> str | None:
    """nul or control, by the first 8192 bytes: the rules of ``has_nul`` and ``has_control`` for use inside tasks."""
    if b"\0" in head:
        return "nul"
    return "control" if 20 * (len(head) - len(head.translate(None, _CONTROL))) > len(head) else None


def stat_reason(path: Column, size: Column) -> Column:
    """too_large or binary_name, which need no content, or null."""
    return F.when(too_large(size), "too_large").when(binary_name(path), "binary_name")


def index_reason(path: Column, size: Column, content: Column) -> Column:
    """ok, or the first reason against: too_large, binary_name, unreadable, nul, control."""
    by_content = F.when(content.isNull(), "unreadable").when(has_nul(content), "nul").when(has_control(content), "control")
    return F.coalesce(stat_reason(path, size), by_content, F.lit("ok"))


def unchanged_by_stat(mtime: Column, size: Column, old_mtime: Column, old_size: Column) -> Column:
    return (mtime != 0) & (old_mtime == mtime) & (old_size == size)
