"""Summaries, search index and folder plans over a file catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.positions import running_position


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Files and megabytes per (category, extension), per category, and overall (nulls)."""
    return catalog.rollup("category", "extension").agg(
        F.count(F.lit(1)).alias("files"), F.round(F.sum("size") / (1024.0 * 1024.0), 2).alias("total_mb")
    )


def index_entries(catalog: DataFrame) -> DataFrame:
    """Flat index (kind, term, path): one row per keyword or category of a file. Any term size is fine here."""
    words = catalog.select(F.lit("keyword").alias("kind"), F.explode("keywords").alias("term"), "path")
    groups = catalog.select(F.lit("category").alias("kind"), F.col("category").alias("term"), "path")
    return words.unionByName(groups)


def index_terms(catalog: DataFrame) -> DataFrame:
    """(kind, term, n_files): in how many files each term occurs."""
    return index_entries(catalog).distinct().groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n_files"))


def inverted_index(catalog: DataFrame, block: int = 1024) -> DataFrame:
    """Posting blocks (kind, term, block, n_files, first, last, files): the paths of a term in order, at most ``block`` in one.

    A path's place among those of its term decides its block, so a term that every file has is cut in as many blocks as
    it takes, and none is larger than the others. ``first`` and ``last`` say which blocks a range of paths needs. Paths
    are stored as they differ from the one before: ``files`` has the number of characters they share and the rest.
    """
    placed = running_position(index_entries(catalog).distinct(), ["kind", "term"], ["path"], "at")
    blocks = placed.withColumn("block", F.floor((F.col("at") - 1) / block).cast("int")).groupBy("kind", "term", "block")
    paths = blocks.agg(F.array_sort(F.collect_list("path")).alias("paths"))  # at most ``block`` of them

    def differs(path, i):
        """Number of characters shared with the path before, and what follows them."""
        earlier = F.when(i > 0, F.element_at("paths", F.greatest(i, F.lit(1)))).otherwise("")
        spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(path), F.length(earlier))))
        unlike = F.filter(spots, lambda k: F.substr(path, k, F.lit(1)) != F.substr(earlier, k, F.lit(1)))
        shared = F.when(F.length(earlier) == 0, 0).otherwise(F.coalesce(F.get(unlike, F.lit(0)) - 1, F.least(F.length(path), F.length(earlier))))
        return F.struct(shared.cast("int").alias("shared"), F.substr(path, shared + 1, F.length(path)).alias("rest"))

    return paths.select(
        "kind", "term", "block", F.size("paths").alias("n_files"), F.element_at("paths", 1).alias("first"), F.element_at("paths", -1).alias("last"),
        F.transform("paths", differs).alias("files"),
    )


def postings(index: DataFrame) -> DataFrame:
    """(kind, term, path): the posting blocks as flat rows again."""
    start = F.struct(F.lit("").alias("path"), F.array().cast("array<string>").alias("all"))

    def grown(state, entry):
        path = F.concat(F.substr(state["path"], F.lit(1), entry["shared"]), entry["rest"])
        return F.struct(path.alias("path"), F.concat(state["all"], F.array(path)).alias("all"))

    return index.select("kind", "term", F.explode(F.aggregate("files", start, grown, lambda state: state["all"])).alias("path"))


def search_index(catalog: DataFrame, term: str) -> DataFrame:
    """Catalogue rows of the files that hold a term as keyword or category, with path, size and summary."""
    hits = index_entries(catalog).filter(F.col("term") == F.lower(F.lit(term))).select("path").distinct()
    return catalog.join(hits, "path", "left_semi")


def organize_plan(catalog: DataFrame, strategy: str = "by_type") -> DataFrame:
    """(path, folder, target, reason) per file to move: by_type, semantic or by_date. No file is moved."""
    if strategy == "by_type":
        folder, reason = F.concat("category", F.lit("_files")), F.concat(F.lit("File type: "), F.col("category"))
    elif strategy == "semantic":
        folder = F.concat(F.coalesce(F.get("keywords", F.lit(0)), F.lit("misc")), F.lit("_related"))
        reason = F.concat(F.lit("Content similarity: "), folder)
    elif strategy == "by_date":
        folder = F.date_format("modified", "yyyy-MM")
        reason = F.concat(F.lit("Modified in "), folder)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    plan = catalog.select("path", folder.alias("folder"), F.concat(folder, F.lit("/"), F.col("name")).alias("target"), reason.alias("reason"))
    if strategy == "semantic":  # a folder of its own needs more than one file
        shared = plan.groupBy("folder").count().filter("count > 1").select("folder")
        plan = plan.join(shared, "folder", "left_semi").select("path", "folder", "target", "reason")
    return plan
