"""References to records that do not exist.

Method: references and parent keys are put on one key space, co-partitioned by key
and a slice of time, sorted by time, and merged in one linear pass per partition: a
running maximum over the parents' validity ends says, at each reference, whether any
parent row was valid at that moment. The state a slice inherits from earlier slices
(its *carry*) comes from a cube that is pre-aggregated on the map side, so a key that
owns a third of all rows is spread over as many tasks as it has time slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time slice. A key's slices are bounded by the span of the data, not by its rows; a narrow slice keeps
#: what a bulk load gives one key apart.
SLICE_MINUTES = 1
#: References without a time are before all others and need no order: they are spread over this many slices of their own.
UNTIMED_SLICES = 64

_FOREVER = "9999-12-31 23:59:59"


def time_slice(ts: Column, minutes: int = SLICE_MINUTES) -> Column:
    """Number of the slice that holds ``ts``; null for null. Works on zone-less timestamps."""
    per_day = (24 * 60) // minutes
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * per_day + F.floor(
        (F.hour(ts) * 60 + F.minute(ts)) / minutes
    )


def leading_parts(key: Column, separator: str = "::") -> Column:
    """All leading parts of ``key`` that end right before a separator (the whole is not one)."""
    pieces = F.split(key, f"(?={separator})")
    ends = F.sequence(F.lit(1), F.size(pieces) - 1)
    parts = F.transform(ends, lambda i: F.array_join(F.slice(pieces, 1, i), ""))
    parts = F.when(F.size(pieces) > 1, parts).otherwise(F.array().cast("array<string>"))
    return F.when(key.startswith(separator), F.array_union(F.array(F.lit("")), parts)).otherwise(parts)


def orphan_references(references: DataFrame, parents: DataFrame, separator: str = "::") -> DataFrame:
    """Every reference that led to no valid parent row when it was made.

    ``references``: ``ref_table, id, ref`` (strings), ``created_at`` (timestamp),
    ``by_lead`` (boolean: the reference may also be a leading part of a parent id
    that ends before the separator). ``parents``: ``id, ingested_at, deleted_at``.
    Other columns are ignored.

    A parent row is valid from ``ingested_at`` (inclusive) to ``deleted_at``
    (exclusive; null means for ever). Result: distinct ``ref_table, id, ref, reason,
    period`` with reason ``missing`` (no parent row at all), ``late`` (rows, but none
    ingested by then) or ``deleted``.

    Nulls: a null ``ref`` is no reference; a null parent id matches nothing; a null
    ``ingested_at`` counts as a row that never arrived (so ``late``, not ``missing``);
    a null ``created_at`` is earlier than everything and has a null period. Empty
    tables give an empty result (or all ``missing``). Repeated rows count once.
    """
    p = parents.select(
        F.col("id").alias("key"),
        F.col("ingested_at").cast("timestamp_ntz").alias("t"),
        F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit(_FOREVER).cast("timestamp_ntz")).alias("until"),
    ).where(F.col("key").isNotNull())
    p = p.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.col("key").alias("key"), F.lit(True).alias("whole"))),
                F.transform(leading_parts(F.col("key"), separator), lambda k: F.struct(k.alias("key"), F.lit(False).alias("whole"))),
            )
        ).alias("k"),
        "t",
        F.when(F.col("t").isNotNull(), F.col("until")).alias("until"),
    )
    # kind orders rows of one moment: carry, parents, references
    events = p.select(
        F.col("k.key").alias("key"),
        time_slice(F.col("t")).alias("slice"),
        F.lit(1).alias("kind"),
        "t",
        F.when(F.col("k.whole"), F.col("until")).alias("until_whole"),
        F.col("until").alias("until_any"),
        (F.col("k.whole") & F.col("t").isNotNull()).alias("seen_whole"),
        F.col("t").isNotNull().alias("seen_any"),
        F.col("k.whole").alias("match_whole"),
        F.lit(True).alias("match_any"),
        F.lit(None).cast("struct<ref_table:string,id:string,by_lead:boolean>").alias("ref"),
    )
    created = F.col("created_at").cast("timestamp_ntz")
    refs = references.where(F.col("ref").isNotNull()).select(
        F.col("ref").alias("key"),
        F.coalesce(time_slice(created), F.pmod(F.xxhash64("id"), F.lit(UNTIMED_SLICES)) - F.lit(10**12)).alias("slice"),
        F.lit(2).alias("kind"),
        created.alias("t"),
        F.lit(None).cast("timestamp_ntz").alias("until_whole"),
        F.lit(None).cast("timestamp_ntz").alias("until_any"),
        *(F.lit(False).alias(c) for c in ("seen_whole", "seen_any", "match_whole", "match_any")),
        F.struct(F.col("ref_table"), F.col("id").cast("string").alias("id"), F.col("by_lead")).alias("ref"),
    )
    stream = events.unionByName(refs)

    state = ("until_whole", "until_any", "seen_whole", "seen_any", "match_whole", "match_any")
    cube = stream.groupBy("key", "slice").agg(
        *(F.max(c).alias(c) for c in state), F.max(F.col("kind") == 2).alias("asked")
    )
    before = Window.partitionBy("key").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.partitionBy("key")
    carry = (
        cube.select(
            "key",
            "slice",
            "asked",
            # rows without a time sit in the null slice and hold no state but their match
            *(F.max(c).over(before).alias(c) for c in state[:4]),
            *(F.max(c).over(ever).alias(c) for c in state[4:]),
        )
        .where("asked")
        .select(
            "key",
            "slice",
            F.lit(0).alias("kind"),
            F.lit(None).cast("timestamp_ntz").alias("t"),
            *state,
            F.lit(None).cast("struct<ref_table:string,id:string,by_lead:boolean>").alias("ref"),
        )
    )
    merge = (
        Window.partitionBy("key", "slice")
        .orderBy(F.col("t").asc_nulls_first(), F.col("kind"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at_ref = (
        # a parent without a time was never there at any moment; the carry knows that it exists
        events.where("t is not null").unionByName(refs).unionByName(carry)
        .select("key", "kind", "t", "ref", *(F.max(c).over(merge).alias(c) for c in state))
        .where(F.col("kind") == 2)
    )
    pick = lambda c: F.when(F.col("ref.by_lead"), F.col(f"{c}_any")).otherwise(F.col(f"{c}_whole"))
    return (
        at_ref.select(
            F.col("ref.ref_table").alias("ref_table"),
            F.col("ref.id").alias("id"),
            F.col("key").alias("ref"),
            "t",
            pick("until").alias("until"),
            F.coalesce(pick("seen"), F.lit(False)).alias("seen"),
            F.coalesce(pick("match"), F.lit(False)).alias("matched"),
        )
        .where(F.coalesce(~(F.col("until") > F.col("t")), F.lit(True)))
        .select(
            "ref_table",
            "id",
            "ref",
            F.when(~F.col("matched"), "missing").when(~F.col("seen"), "late").otherwise("deleted").alias("reason"),
            F.date_format(F.col("t"), "yyyy-MM").alias("period"),
        )
        .distinct()
    )


def benchmark_references(retrieval_questions: DataFrame, questions: DataFrame) -> DataFrame:
    """Both benchmark tables as one reference table for :func:`orphan_references`."""
    a = retrieval_questions.select(
        F.lit("retrieval_questions").alias("ref_table"), "id", F.explode("relevant_chunk_ids").alias("ref"), "created_at", F.lit(False).alias("by_lead")
    )
    b = questions.select(
        F.lit("questions").alias("ref_table"), "id", F.explode("expected_sources").alias("ref"), "created_at", F.lit(True).alias("by_lead")
    )
    return a.unionByName(b)


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per table, period and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("id").alias("n_questions")
    )
