"""References to records that do not exist: orphan detection over composite keys with partial nulls."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_left_join

MATCHES = ("simple", "partial", "full")


def orphans(refs: DataFrame, targets: DataFrame, on: list[tuple[str, str]], match: str = "simple") -> DataFrame:
    """Rows of ``refs`` whose key names no row of ``targets``.

    ``on`` pairs a referring column with the referred one. References are grouped by their null mask and each group
    is anti-joined on its non-null columns, under one of SQL's match rules:

    * ``simple``: a key with any null refers to nothing and is never an orphan;
    * ``partial``: the non-null columns must agree with at least one target row;
    * ``full``: a key that is partly null is always an orphan; an all-null key never is.

    Repeated references all come out; extra columns (also ones named as in ``targets``) pass through unchanged.
    An empty ``targets`` makes every non-null reference an orphan; empty ``refs`` give an empty result.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    parts = []
    for mask in product((False, True), repeat=len(on)):
        if all(mask) or (match == "simple" and any(mask)):
            continue
        held = [pair for pair, null in zip(on, mask) if not null]
        wanted = F.lit(True)
        for (column, _), null in zip(on, mask):
            wanted &= F.col(column).isNull() if null else F.col(column).isNotNull()
        group = refs.where(wanted)
        if match == "full" and any(mask):
            parts.append(group)
            continue
        keys = targets.select([F.col(b).alias(f"__t{i}") for i, (_, b) in enumerate(held)]).dropna().distinct()
        parts.append(group.join(keys, [F.col(a) == F.col(f"__t{i}") for i, (a, _) in enumerate(held)], "left_anti"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chunk_states(change_log: DataFrame, entity: str) -> DataFrame:
    """The last state of every id a change log names: columns ``id``, ``deleted``.

    Events apply in the order of ``seq``, not of their clocks. A restore without ``new_id`` brings the id back; one
    with ``new_id`` revives the record under that id and leaves the old one deleted. Updates do not change a state.
    """
    log = change_log.where((F.col("entity") == entity) & F.col("op").isin("delete", "restore")).select("seq", "id", "op", "new_id")
    moved = (F.col("op") == "restore") & F.col("new_id").isNotNull()
    states = log.select(
        "seq",
        F.explode(
            F.when(moved, F.array(F.struct(F.col("id"), F.lit(True).alias("deleted")), F.struct(F.col("new_id").alias("id"), F.lit(False).alias("deleted"))))
            .otherwise(F.array(F.struct(F.col("id"), (F.col("op") == "delete").alias("deleted"))))
        ).alias("s"),
    ).select("seq", "s.id", "s.deleted")
    # max of a struct keeps the newest state in a partial aggregate: no window, no sort of a hot id in one task
    return states.groupBy("id").agg(F.max(F.struct("seq", "deleted")).alias("last")).select("id", F.col("last.deleted").alias("deleted"))


def orphan_references(refs: DataFrame, chunks: DataFrame, change_log: DataFrame) -> DataFrame:
    """Orphan references with their kind: ``ref_table``, ``row_id``, ``kind``, ``month``.

    ``refs`` has ``ref_table``, ``row_id``, ``key`` and ``at`` (when the referring record was made). The kind is the
    first that holds of ``deleted`` (the log deleted the chunk and did not bring it back under this id), ``missing``
    (no such chunk; found by ``orphans``) and ``late`` (the chunk was saved after the record). A null key refers to
    nothing. A null time on either side is not late. Exact repeats of a reference count once.
    """
    refs = refs.where(F.col("key").isNotNull()).dropDuplicates(["ref_table", "row_id", "key", "at"])
    saved = chunks.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(F.min("saved_at").alias("chunk_saved_at"))
    gone = chunk_states(change_log, "TextChunk").where("deleted").select(F.col("id").alias("key"), F.lit(True).alias("deleted"))
    # Everything known of a key goes into one row; the references, which may crowd on one key, are joined once.
    absent = orphans(refs.select("key").distinct(), saved.select(F.col("key").alias("id")), [("key", "id")]).withColumn("missing", F.lit(True))
    known = saved.join(gone, "key", "full").join(absent, "key", "full")
    late = F.col("chunk_saved_at") > F.col("at")
    kind = F.when(F.col("deleted"), "deleted").when(F.col("missing"), "missing").when(late, "late")
    return (
        skew_left_join(refs, known, "key")
        .select("ref_table", "row_id", kind.alias("kind"), F.date_trunc("month", "at").cast("date").alias("month"))
        .where(F.col("kind").isNotNull())
    )


def references(cards: DataFrame, density: DataFrame) -> DataFrame:
    """The two referring tables in one shape."""
    return cards.select(F.lit("flash_cards").alias("ref_table"), F.col("id").alias("row_id"), F.col("origin_id").alias("key"), F.col("saved_at").alias("at")).unionByName(
        density.select(F.lit("density").alias("ref_table"), F.col("chunk_id").alias("row_id"), F.col("chunk_id").alias("key"), F.col("taken_at").alias("at"))
    )


