"""Line dedup: passages of three lines that occur again are removed where they occur later.

Every three consecutive lines of a text are a window. Windows are known by 128 bits made of the lines'
hashes. The first occurrence in the order ``(id, line)`` stays; the lines that any later occurrence
covers are removed, windows that overlap merging into one span. A window that overlaps its own first
occurrence (a run of equal lines) is no later occurrence.

Only DataFrame functions. Windows carry two hashes and a position, never text. The first occurrences
are found by a partially aggregated grouping, so one passage in a third of all rows costs one row per
task; they return to the windows by a join whose hot keys adaptive execution splits.

Defined results: NULL and texts of fewer than three lines stay as they are; rows that share an id are
told apart by their content, and equal rows of equal id are the same text, so all of them keep or lose
the same lines; a row without id sorts first; no rows give no rows; all other columns are kept, and
columns of the same names as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import free_name

WINDOW = 3
RESULT = ("n_lines", "removed_lines", "removed_spans")


def _hashes(lines: Column, seed: int) -> Column:
    """A hash for each window, from the hashes of its lines; shifted copies spare looking lines up by index."""
    line = F.transform(lines, lambda x: F.xxhash64(x, F.lit(seed)))
    shifted = [F.slice(line, k + 1, F.greatest(F.size(lines) - (WINDOW - 1), F.lit(0))).alias(f"l{k}") for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(*[w[f"l{k}"] for k in range(WINDOW)], F.lit(seed)))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row, pos, a, b``: every window of the texts with its two hashes; ``row`` tells rows of one id apart."""
    text = F.col(text_col)
    lines = F.split(text, "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), lines.alias("lines")).where(F.size("lines") >= WINDOW)
    pairs = rows.select("id", "row", F.arrays_zip(_hashes(F.col("lines"), 1).alias("a"), _hashes(F.col("lines"), 2).alias("b")).alias("w"))
    return pairs.select("id", "row", F.posexplode("w").alias("pos", "w")).select("id", "row", "pos", "w.a", "w.b")


def later_windows(found: DataFrame) -> DataFrame:
    """One row per text that holds a later occurrence: ``id, row, later`` (a flag for each of its windows)."""
    first = (
        found.groupBy("a", "b")
        .agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    )
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
    later = F.col("first").isNotNull() & ~(here & (F.col("pos") < F.col("first.pos") + WINDOW))
    flagged = found.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left").select("id", "row", "pos", later.alias("later"))
    # Equal rows of equal id give every position several times, with the same flag: a set holds it once.
    return (
        flagged.groupBy("id", "row")
        .agg(F.max("later").alias("any"), F.array_sort(F.collect_set(F.struct("pos", "later"))).alias("w"))
        .where("any")
        .select("id", "row", F.col("w.later").alias("later"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later passages cut from the text.

    Adds ``n_lines`` (before), ``removed_lines`` (int) and ``removed_spans`` (array of structs ``start``,
    ``end``: merged line ranges, the end not included).
    """
    rows = docs.drop(*[c for c in RESULT if c not in (id_col, text_col)])
    row, later_id, later_row, flags = (free_name(rows, c) for c in ("_row", "_later_id", "_later_row", "_flags"))
    later = later_windows(windows(docs, id_col, text_col)).toDF(later_id, later_row, flags)
    rows = rows.withColumn(row, F.xxhash64(F.col(text_col)))
    both = rows.join(later, F.col(id_col).eqNullSafe(F.col(later_id)) & (F.col(row) == F.col(later_row)), "left")
    lines = F.split(F.col(text_col), "\n")

    def gone(i: Column) -> Column:
        return F.coalesce(F.get(flags, i), F.lit(False)) | F.coalesce(F.get(flags, i - 1), F.lit(False)) | F.coalesce(F.get(flags, i - 2), F.lit(False))

    kept = F.filter(lines, lambda x, i: ~gone(i))
    every = F.sequence(F.lit(0), F.size(lines))
    starts = F.filter(every, lambda i: gone(i) & ~gone(i - 1))
    ends = F.filter(every, lambda i: ~gone(i) & gone(i - 1))
    spans = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hit = F.col(flags).isNotNull()
    return (
        both.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("removed_spans", F.when(hit, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
        .withColumn("removed_lines", F.aggregate("removed_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]))
        .withColumn(text_col, F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
        .drop(row, later_id, later_row, flags)
    )
