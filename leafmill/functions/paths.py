"""What a path or URL names, told from its spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGES = tuple("png jpg jpeg gif bmp tiff tif webp".split())
DOCUMENTS = ("pdf", "docx")


def is_url(path: Column) -> Column:
    return F.coalesce(path.rlike("(?i)^https?:"), F.lit(False))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def is_docx(path: Column) -> Column:
    return F.lower(path).endswith(".docx")


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; a name of dots and then letters has none."""
    return F.regexp_extract(F.lower(path), r"[^/.][^/]*\.([^./]+)$", 1)


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGES)


def input_type(path: Column, is_directory: Column | None = None) -> Column:
    """url, directory, pdf, docx, image or unknown, in this order; only the caller knows what is a directory."""
    folder = is_directory if is_directory is not None else F.lit(False)
    return F.when(is_url(path), "url").when(folder, "directory").when(is_pdf(path), "pdf").when(is_docx(path), "docx").when(is_image(path), "image").otherwise("unknown")


def url_file_type(url: Column) -> Column:
    """By the URL's path, whatever its query and fragment say; image unless it says otherwise."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(path.endswith(".pdf"), "pdf").when(path.endswith(".docx"), "docx").otherwise("image")
