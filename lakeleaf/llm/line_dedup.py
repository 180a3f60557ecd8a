"""Site-relative line deduplication (operator 7), in DataFrame functions only.

A line is boilerplate of a host if it stands on more than a given share of the host's pages. Pages are the distinct texts of a host: a group of
exact copies is one page, so that copying a page does not turn its lines into boilerplate; copies are for the document deduplication to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import unused, written

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: ... if it stands on so many pages at least: a share of few pages says nothing.
MIN_PAGES = 5
#: Boilerplate lines up to which the table of them is broadcast (16 bytes each, besides the host); beyond it, it is joined.
BROADCAST_LINES = 500_000
#: Parts into which a host's documents are dealt for that join.
SALTS = 64


def _key(line: Column) -> Column:
    """128 bits of a line without the blanks around it."""
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(df: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, line_key, pages, host_pages of the lines on more than `ratio` of the host's pages, and on min_pages at least.

    Lines are compared without blanks around them; blank ones are never boilerplate. A null host is a host of its own. Counts are over all rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pages = df.select(F.col(host_col).cast("string").alias("host"), F.unhex(F.md5(text)).alias("page"), text.alias("text"))
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    lines = lines.select("host", "page", _key(F.col("line")).alias("line_key")).distinct()
    counted = lines.groupBy("host", "line_key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return (
        counted.join(total.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("pages") > F.col("host_pages") * F.lit(float(ratio)))
        .select("host", "line_key", "pages", "host_pages")
    )


def drop_boilerplate(
    df: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES, counts: bool = True
) -> DataFrame:
    """df with boilerplate lines taken out of its text, and with `counts` the columns n_lines and n_dropped (bigint; columns of these names are replaced).

    A null text stays null with 0 lines; an empty one has one line. A text of boilerplate alone becomes empty. What stays keeps its order and its line feeds.
    All columns and rows, repeated ones too, stay. A host's boilerplate is at most (mean distinct lines a page / ratio) lines, so it fits an array; that
    table is broadcast only if it has few lines in all, and else joined by host and salt, which deals a large host's documents to many tasks."""
    at, host, drop, salt, salt_of, clean = unused(df, "at", "host", "drop", "salt", "salt_of", "clean")
    found = written(boilerplate(df, ratio, min_pages, host_col, text_col).select("host", "line_key"), "boilerplate")
    by_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("line_key").alias(drop))
    text = F.col(text_col)
    joined = df.withColumn(at, F.col(host_col).cast("string"))
    if found.count() <= broadcast_lines:
        joined = joined.join(F.broadcast(by_host), F.col(at).eqNullSafe(F.col(host)), "left")
    else:
        salts = by_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt_of))
        joined = joined.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = joined.join(salts, F.col(at).eqNullSafe(F.col(host)) & (F.col(salt) == F.col(salt_of)), "left").drop(salt, salt_of)
    lines = F.split(text.cast("string"), "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col(drop), _key(line)))
    joined = joined.withColumn(clean, F.when(F.col(drop).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n")))
    if counts:
        joined = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint"))
        joined = joined.withColumn("n_dropped", F.when(text.isNull() | F.col(drop).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("bigint"))
    return joined.withColumn(text_col, F.col(clean)).drop(at, host, drop, clean)
