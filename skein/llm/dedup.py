"""Exact duplicates: grouping by a 128-bit content hash, with the bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, store


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hashed=content_hash,
) -> DataFrame:
    """Decide for every row which row of its group of equal texts stays.

    Texts fall into groups by hash, whose counts and best ids are added up before the shuffle,
    so that a large group of copies costs one row per input partition and a text moves nowhere.
    Only texts whose hash occurs twice or more are then grouped by hash *and* bytes, copies
    collapsing before the shuffle again, to see whether a hash is shared by different texts.
    If there are any such hashes, their rows find their group by the text itself.

    Args:
        docs: rows with an id and a text; other columns are ignored, whatever their names.
        keep: ``min`` keeps the smallest id of a group, ``max`` the largest.
        hashed: makes the hash of a text column.

    Returns:
        doc_id, keep_id, group_size, kept, text_sha256: a row per input row. A null text
        counts as empty. Null ids lose against others; in a group of null ids alone keep_id is
        null and every row is kept. Rows that repeat an id within a group all have the decision
        of that id. Texts of any length are read whole. An empty table gives an empty one.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), hashed(text).alias("h"), text.alias("t"))
    decide = [best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    told = rows.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
    groups = store(rows.groupBy("h").agg(*decide), "groups")
    several = groups.filter("group_size > 1").select("h")
    equal = rows.select("h", "t").join(hinted(several), "h", "left_semi").groupBy("h", "t").agg(F.lit(1).alias("one"))
    shared = store(equal.groupBy("h").count().filter("count > 1").select("h"), "shared_hashes")
    if shared.isEmpty():
        found = _joined(told, groups)
    else:
        found = _joined(told.join(hinted(shared), "h", "left_anti"), groups)
        mixed = rows.join(hinted(shared), "h", "left_semi")
        mixed = mixed.join(mixed.groupBy("h", "t").agg(*decide), ["h", "t"]).withColumn("sha", F.unhex(F.sha2("t", 256)))
        found = found.unionByName(mixed.select(*found.columns))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with their groups; those of a hash of their own are groups by themselves."""
    groups = hinted(groups.filter("group_size > 1"))
    found = rows.join(groups, "h", "left")
    one = F.col("group_size").isNull()
    return found.select(
        "doc_id", "h", "sha", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Keep one row of each group of equal texts, with all its columns.

    Of rows that repeat an id within a group one stays. Null texts count as empty. An empty
    table gives an empty one. Rows that nothing equals are filtered where they lie.
    """
    made = store(exact_duplicates(docs, id_col=id_col, text_col=text_col, keep=keep), "decisions")
    key, sha, n = "__skein_id", "__skein_sha", "__skein_n"
    of = made.filter("group_size > 1").groupBy(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(sha))
    of = store(of.agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias(n)), "copies")
    gone = of.filter(f"not kept or {n} > 1").select(key, sha)
    tagged = docs.withColumns({key: F.col(id_col), sha: F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))})

    def met(how: str, few: DataFrame) -> DataFrame:
        same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col(f"a.{sha}") == F.col(f"b.{sha}"))
        return tagged.alias("a").join(hinted(few).alias("b"), same, how)

    out = met("left_anti", gone)
    again = of.filter(f"kept and {n} > 1").select(key, sha)
    if not again.isEmpty():
        out = out.unionByName(met("left_semi", again).dropDuplicates([key, sha]))
    return out.drop(key, sha)
