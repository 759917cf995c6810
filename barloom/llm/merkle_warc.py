"""WARC fixity audit: hash trees over records and offset ranges, compared between replicas.

Pages become WARC records. Records of one id and URI are one leaf, whose hash covers how many they are,
their bytes, and the sum of their SHA-256 values in four 32-bit lanes: a sum does not depend on the
order, so a key of any number of records is added up before the shuffle. The archive's manifest places the leaves in
volumes (by a hash of the key, some ``VOLUME`` leaves each) and orders them there, giving every leaf an
offset range; a leaf's hash covers where it starts and, by its own length, ends. Above the leaves stand nodes
of ``FANOUT`` consecutive children, each hashing their offset range and their hashes, up to one root per volume.

Each replica's tree is built from its own records and the manifest, without the other's hashes. Records
that the manifest does not know are leaves behind the last one of their volume. The audit compares the
roots of the volumes and goes down, level by level, only below nodes whose hashes differ; the leaves it
arrives at are the damaged, missing or extra records. Starts are the manifest's, so records behind one that
is missing or has another length are no findings; rows of a table have no order that could be compared.

Defined results: a NULL id or URI is written as empty, a NULL body is an empty one; repeated rows count
(one copy less is a change); several records of one key are reported together, with their bytes added
up; equal replicas, and empty ones, give no rows; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import stored

#: Leaves of a volume, about.
VOLUME = 4096
FANOUT = 16
LANES = 4


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``id, uri, record``: the bytes of a WARC record for each page."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(id_col),
        F.lit(">\r\nWARC-Target-URI: "), text(url_col),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(text(id_col).alias("id"), text(url_col).alias("uri"), F.concat(F.encode(head, "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def leaves(found: DataFrame) -> DataFrame:
    """``id, uri, length, digest``: one row per key of ``records``."""
    hashed = found.select("id", "uri", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    lane = lambda i: F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long")
    summed = hashed.groupBy("id", "uri").agg(F.count("*").alias("n"), F.sum("length").alias("length"), *[F.sum(lane(i)).alias(f"lane{i}") for i in range(LANES)])
    return summed.select("id", "uri", "length", F.sha2(F.concat_ws(":", "n", "length", *[f"lane{i}" for i in range(LANES)]), 256).alias("digest"))


def volume_of(volumes: int) -> Column:
    key = F.concat_ws("\n", "id", "uri")
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(volumes))


def manifest(found: DataFrame, volumes: int) -> DataFrame:
    """``id, uri, volume, node, start, end``: the place and the offset range of every leaf."""
    order = Window.partitionBy("volume").orderBy("id", "uri")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = found.withColumn("volume", volume_of(volumes)).withColumn("node", F.row_number().over(order).cast("long") - 1)
    return placed.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).select("id", "uri", "volume", "node", "start", "end")


def base_level(found: DataFrame, listed: DataFrame) -> DataFrame:
    """The lowest level of a replica's tree: its leaves where the manifest has them; without a digest if they are missing."""
    met = listed.join(found.select("id", "uri", F.col("length").alias("own"), "digest"), ["id", "uri"], "left")
    placed = met.withColumn("end", F.when(F.col("own").isNull(), F.col("end")).otherwise(F.col("start") + F.col("own")))
    return placed.select("id", "uri", "volume", "node", "start", "end", F.coalesce(covering("digest"), F.lit("missing")).alias("digest"))


def covering(hashes: str | Column) -> Column:
    """Hash of an offset range and of what stands there; NULL if nothing does."""
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes
    return F.sha2(F.concat(F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit(":"), hashes), 256)


def strays(found: DataFrame, listed: DataFrame, volumes: int) -> DataFrame:
    """Leaves that the manifest does not have, as rows of ``base_level`` behind the last of their volume."""
    last = listed.groupBy("volume").agg((F.max("node") + 1).alias("n0"), F.max("end").alias("e0"))
    order = Window.partitionBy("volume").orderBy("id", "uri")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    extra = found.join(listed, ["id", "uri"], "left_anti").withColumn("volume", volume_of(volumes)).withColumns({"i": F.row_number().over(order).cast("long") - 1, "to": end})
    extra = extra.join(last, "volume", "left").withColumns({"node": F.coalesce("n0", F.lit(0)) + F.col("i"), "end": F.coalesce("e0", F.lit(0)) + F.col("to")})
    return extra.withColumn("start", F.col("end") - F.col("length")).select("id", "uri", "volume", "node", "start", "end", covering("digest").alias("digest"))


def next_level(level: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    above = level.groupBy("volume", F.expr(f"node div {FANOUT}").alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), children.alias("c"))
    return above.select("volume", "node", "start", "end", covering(F.array_join(F.col("c.digest"), "")).alias("digest"))


def tree(base: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the roots, each written once: a level has a ``FANOUT``-th of the rows of the one below."""
    levels = [stored(base)]
    for _ in range(height):
        levels.append(stored(next_level(levels[-1])))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves that differ, found from the roots down; ``other`` is the other tree's digest. Of those that ``theirs`` alone has, only place and digest."""
    suspects = None
    for mine, other in zip(reversed(ours), reversed(theirs)):
        if suspects is not None:  # only children of nodes that differ
            below = F.expr(f"node div {FANOUT}")
            mine = mine.withColumn("_up", below).join(suspects, ["volume", "_up"], "left_semi").drop("_up")
            other = other.withColumn("_up", below).join(suspects, ["volume", "_up"], "left_semi").drop("_up")
        met = mine.join(other.select("volume", "node", F.col("digest").alias("other")), ["volume", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        met = stored(met)
        suspects = met.select("volume", F.col("node").alias("_up"))
    return met


def audit(archive: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``id, uri, volume, start, length, status``: records that the replica has ``changed``, ``missing`` or ``extra``.

    ``start`` is the offset in the archive's volume (-1 for extra records).
    """
    ours = stored(leaves(records(archive, id_col, url_col, body_col)))
    theirs = stored(leaves(records(replica, id_col, url_col, body_col)))
    volumes = max(1, math.ceil(ours.count() / VOLUME))
    listed = stored(manifest(ours, volumes))
    extra = stored(strays(theirs, listed, volumes))
    largest = max(table.agg(F.max("node")).first()[0] or 0 for table in (listed, extra))
    height = 1
    while FANOUT**height <= largest:
        height += 1
    found = differing(tree(base_level(ours, listed), height), tree(base_level(theirs, listed).unionByName(extra), height))
    status = F.when(F.col("other") == "missing", "missing").otherwise("changed")
    known = found.where("digest IS NOT NULL").select("id", "uri", "volume", "start", (F.col("end") - F.col("start")).alias("length"), status.alias("status"))
    extra = extra.join(found.where("digest IS NULL").select("volume", "node"), ["volume", "node"], "left_semi")
    extra = extra.select("id", "uri", "volume", F.lit(-1).cast("long").alias("start"), (F.col("end") - F.col("start")).alias("length"), F.lit("extra").alias("status"))
    return known.unionByName(extra)
