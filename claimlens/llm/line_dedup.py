"""Line deduplication by overlapping windows of three lines, with DataFrame functions only.

Every window of three consecutive lines is hashed; a window that also occurs earlier, by document id and then by
place, is a repeat, and all the lines that repeats cover go. The earliest occurrence of each window stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import free, stored

WINDOW = 3
# A second hash of the same lines starts from another value, so that a window is known by 128 bits.
SEED = "second"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per window: the document's key, a hash of its text, the window's first line and two hashes."""
    spans = F.when(F.size("_lines") >= width, F.sequence(F.lit(0), F.size("_lines") - width))

    def window(at: Column) -> Column:
        parts = [F.get(F.col("_lines"), at + k) for k in range(width)]
        filled = F.length(F.trim(F.concat(*parts))) > 0
        return F.struct(at.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(SEED), *parts).alias("h2"), filled.alias("filled"))

    return (
        docs.where(F.col(text).contains("\n"))
        .select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_sig"), _lines(F.col(text)).alias("_lines"))
        .select("_doc", "_sig", F.inline(F.transform(spans, window)))
        .where("filled")
        .drop("filled")
    )


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per document with repeats: its key, the hash of its text and the sorted line numbers to remove."""
    found = stored(windows(docs, key, text, width), "windows")
    place = F.struct("_doc", "_sig", "at")
    # The partial aggregate leaves one row per window and task, so a window that fills a third of the rows is no load.
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    firsts = stored(firsts.drop("_n"), "first")
    later = found.join(firsts, ["h1", "h2"]).where(place > F.col("_first"))
    return (
        later.groupBy("_doc", "_sig")
        .agg(F.collect_set("at").alias("_at"))
        .select("_doc", "_sig", F.array_sort(F.array_distinct(F.flatten(F.transform("_at", lambda at: F.sequence(at, at + width - 1))))).alias("_gone"))
    )


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Documents without the lines covered by later occurrences of a window, with ``n_lines`` and ``n_removed``.

    Every row stays, if need be with an empty text. A null text stays null and has no lines; an empty text is one
    line. Texts of fewer lines than a window are unchanged, as are windows of blank lines only. Rows that share
    key and text count as one place and keep or lose the same lines; among equal keys the text's hash decides
    which is earlier. A null key comes first. Columns named ``n_lines`` and ``n_removed`` are replaced.
    """
    plain = docs.drop("n_lines", "n_removed")
    doc, sig, lines, own = free(plain, "_doc", "_sig", "_gone", "_own")
    gone = repeated_lines(plain, key, text, width).toDF(doc, sig, lines)
    at = plain.withColumn(own, F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(sig)), "left")
    numbered = F.filter(_lines(F.col(text)), lambda line, k: ~F.array_contains(lines, k))
    kept = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(numbered, "\n"))
    return at.select(
        *[(kept if c == text else F.col(c)).alias(c) for c in plain.columns],
        F.coalesce(F.size(_lines(F.col(text))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_removed"),
    )
