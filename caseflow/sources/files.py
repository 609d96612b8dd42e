"""File catalogue and checksums over the binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.text import keywords

# Extension groups and which extensions are read as text or shown as visual.
CATEGORIES = {
    "documents": [".pdf", ".doc", ".docx", ".txt", ".md", ".rtf"],
    "spreadsheets": [".xlsx", ".xls", ".csv", ".tsv"],
    "presentations": [".ppt", ".pptx"],
    "images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg"],
    "videos": [".mp4", ".avi", ".mov", ".wmv", ".flv"],
    "audio": [".mp3", ".wav", ".flac", ".aac"],
    "code": [".py", ".js", ".html", ".css", ".java", ".cpp", ".c"],
    "data": [".json", ".xml", ".yaml", ".sql"],
    "archives": [".zip", ".rar", ".7z", ".tar", ".gz"],
}
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".py", ".js", ".html"]
VISUAL_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg"]
VISUAL_KEYWORDS = ["visual", "document", "image"]
SUMMARIES = {
    "csv": "CSV data with %d rows, columns: %s",
    "json": "JSON data structure containing configuration or data records",
    "code": "Source code file (%s) containing functions and logic",
    "md": "Markdown documentation or notes",
    "text": "Text document with approximately %d words",
    "visual": "Visual content: %s",
}


def file_category(extension: Column) -> Column:
    out = F.lit("other")
    for name, extensions in CATEGORIES.items():
        out = F.when(extension.isin(extensions), F.lit(name)).otherwise(out)
    return out


def file_extension(name: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./\\]+)$", 1))


def text_summary(text: Column, extension: Column, name: Column) -> Column:
    """One line per file, by type; lines and words are counted over the whole text."""
    whole = F.trim(text)
    rows, words = F.regexp_count(whole, F.lit("\n")) + 1, F.regexp_count(whole, F.lit(r"\S+"))
    return (
        F.when(extension == ".csv", F.format_string(SUMMARIES["csv"], rows, F.substring_index(whole, "\n", 1)))
        .when(extension == ".json", F.lit(SUMMARIES["json"]))
        .when(extension.isin(".py", ".js"), F.format_string(SUMMARIES["code"], F.upper(F.substring(extension, 2, 9))))
        .when(extension == ".md", F.lit(SUMMARIES["md"]))
        .when(extension.isin(TEXT_EXTENSIONS), F.format_string(SUMMARIES["text"], words))
        .when(extension.isin(VISUAL_EXTENSIONS), F.format_string(SUMMARIES["visual"], name))
        .otherwise(F.lit(""))
    )


def catalog_entries(
    df: DataFrame, path: str, content: str, size: str, modified: str, head_chars: int | None = None, also: list[str] | None = None
) -> DataFrame:
    """Catalogue rows from any table that has a path, a text content, a size and a time.

    Keywords and summaries come from the whole text; ``head_chars`` restricts them to its beginning.
    """
    name = F.element_at(F.split(F.col(path), r"[/\\]"), -1)
    ext = file_extension(name)
    text = F.col(content) if head_chars is None else F.substring(F.col(content), 1, head_chars)
    words = (
        F.when(ext.isin(TEXT_EXTENSIONS), keywords(text))
        .when(ext.isin(VISUAL_EXTENSIONS), F.array(*[F.lit(w) for w in VISUAL_KEYWORDS]))
        .otherwise(F.array().cast("array<string>"))
    )
    return df.select(
        F.col(path).alias("path"),
        name.alias("name"),
        ext.alias("extension"),
        F.col(size).cast("long").alias("size"),
        F.col(modified).alias("modified"),
        file_category(ext).alias("category"),
        text_summary(text, ext, name).alias("summary"),
        words.alias("keywords"),
        *(also or []),
    )


def file_catalog(spark: SparkSession, folder: str, head_chars: int | None = None) -> DataFrame:
    """Recursive catalogue of a folder, one row per file, with ``error``.

    The listing has every file. Files with a text suffix, in any case, are opened by a second read and joined to the
    listing by path; of all others the listing is enough. A text file that is gone meanwhile, cannot be read or is no
    valid UTF-8 keeps its row with the reason in ``error`` and no keywords or summary.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    plain = file_extension(F.element_at(F.split("path", r"[/\\]"), -1)).isin(TEXT_EXTENSIONS)
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in TEXT_EXTENSIONS]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
    opened = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder)
    valid = F.is_valid_utf8(F.col("content"))
    texts = opened.select("path", F.when(valid, F.decode("content", "UTF-8")).alias("text"), F.when(~valid, F.lit("not UTF-8 text")).alias("error"), F.lit(True).alias("read"))
    missed = F.when(plain & F.col("read").isNull(), F.lit("cannot be read"))
    rows = listed.join(texts, "path", "left").withColumn("error", F.coalesce("error", missed))
    return catalog_entries(rows, "path", "text", "length", "modificationTime", head_chars, ["error"])


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 per file with the path relative to the folder, forward slashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace(F.col("path"), "^.*" + _quoted(folder.rstrip("/")) + "/", "")
    return files.select(
        F.regexp_replace(relative, r"\\", "/").alias("path"), F.sha2(F.col("content"), 256).alias("sha256")
    )


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
