"""Text logs of scored runs: rendering, scanning and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Block separator, marker and field patterns of the log format.
SEPARATOR = "=" * 50
MARKER = "Clustering Metrics"
STRICT_PATTERN = (r"(?s)method: (\w+).*metric: (\w+).*norm: (\w+)"
                  r".*Silhouette Score: ([\d.]+)"
                  r".*Calinski-Harabasz Index: ([\d.]+)"
                  r".*Davies-Bouldin Index: ([\d.]+)")
PATTERN = (r"(?s)- method: (\w+).*?- metric: (\w+).*?- norm: (\w+)"
           r".*?Silhouette Score: (-?[\d.]+)"
           r".*?Calinski-Harabasz Index: (-?[\d.]+)"
           r".*?Davies-Bouldin Index: (-?[\d.]+)")
_TEMPLATE = f"""
{SEPARATOR}
File: run
{SEPARATOR}
Parameters:
- Plot Type: reduction
- n_components: 2
- n_clusters: 5
- cluster_method: kmeans
- method: %s
- metric: %s
- norm: %s

Results:
{MARKER}:
- Silhouette Score: %.4f (higher is better, range: [-1, 1])
- Calinski-Harabasz Index: %.4f (higher is better)
- Davies-Bouldin Index: %.4f (lower is better)

{SEPARATOR}
"""


def render(metrics: DataFrame) -> DataFrame:
    """One log entry per scored run."""
    return metrics.select("technique", F.format_string(
        _TEMPLATE, "method", "metric", "norm", "silhouette", "ch", "db").alias("value"))


def write_logs(metrics: DataFrame, path: str) -> None:
    """Entries by technique, as compressed text: most of an entry is the template."""
    render(metrics).write.mode("overwrite").option("compression", "lz4").partitionBy("technique").text(path)


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(technique, entry): blocks of every file; the technique is the name of
    the file's folder (its value, where the folder is a partition)."""
    blocks = (spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true")
              .text(paths).select(F.col("_metadata.file_path").alias("_file"), "value"))
    folder = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    return blocks.select(F.regexp_replace(folder, r"^[^=]*=", "").alias("technique"),
                         F.col("value").alias("entry"))


def parse(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Metrics rows of the entries that hold scores.

    ``strict`` reproduces the original pattern: the method field then captures
    the cluster method and entries with a negative score are dropped.
    """
    pattern = STRICT_PATTERN if strict else PATTERN
    held = entries.filter(F.col("entry").contains(MARKER))
    for score in ("Silhouette Score", "Calinski-Harabasz Index", "Davies-Bouldin Index"):
        # necessary for a match and cheap; spares the backtracking of a failing one
        held = held.filter(F.col("entry").rlike(score + (r": [\d.]" if strict else r": -?[\d.]")))
    # one evaluation of the pattern yields all fields
    packed = F.regexp_replace("entry", r"(?s)^.*?" + pattern.removeprefix("(?s)") + ".*$",
                              "\u0001" + "\u0001".join(f"${n}" for n in range(1, 7)))
    fields = ["method", "metric", "norm", "silhouette", "ch", "db"]
    parts = held.select("technique", packed.alias("_p")).filter(F.col("_p").startswith("\u0001"))
    parts = parts.select("technique", F.split("_p", "\u0001").alias("_p"))
    return parts.select("technique", *[
        F.col("_p")[n + 1].cast("string" if n < 3 else "double").alias(c)
        for n, c in enumerate(fields)])
