"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm._tables import keyed_rows, lower_az, small, store, without

#: Characters that the second step hashes.
PREFIX = 64
#: Repeated rows that are dealt out from one array.
REPEATS = 10_000


def normalised(text: Column) -> Column:
    """Texts are equal when these are: A-Z lower-cased, null counted as empty."""
    return lower_az(F.coalesce(text.cast("string"), F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, full_hash, and the ``carry`` expressions over docs' columns.

    Only rows whose length recurs have their prefix hashed, and only rows whose
    length and prefix recur have their whole text hashed (SHA-256); others have a
    null ``full_hash`` and are groups of one. Of equal texts the greatest id is
    kept. Null texts count as empty. A null id is less than any other; of rows
    that repeat id and text one is kept. Other columns of docs are ignored, so
    their names cannot clash. An empty table gives an empty table.

    Texts are never shuffled while the tables of recurring lengths and prefixes
    are small enough to broadcast (their sizes are counted); beyond that they
    are joined by a shuffle.
    """
    carry = carry or {}
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *[c.alias(f"_carry_{k}") for k, c in carry.items()])
    base = base.withColumn("_len", F.octet_length("_t"))
    lengths = store(base.groupBy(F.col("_len").alias("_l1")).agg(F.count("*").alias("_n1")).where("_n1 > 1").select("_l1"), "lengths")
    step1 = base.join(small(lengths), F.col("_len") == F.col("_l1"), "left")
    step1 = step1.withColumn("_prefix", F.when(F.col("_l1").isNotNull(), F.xxhash64(lower_az(F.substring("_t", 1, PREFIX)))))
    prefixes = store(step1.where("_prefix is not null").groupBy(F.col("_len").alias("_l2"), F.col("_prefix").alias("_p2")).agg(F.count("*").alias("_n2")).where("_n2 > 1").select("_l2", "_p2"), "prefixes")
    step2 = step1.join(small(prefixes), (F.col("_len") == F.col("_l2")) & (F.col("_prefix") == F.col("_p2")), "left")
    rows = step2.select("_id", "_len", F.coalesce("_prefix", F.lit(0)).alias("_prefix"), F.when(F.col("_p2").isNotNull(), F.unhex(F.sha2(lower_az(F.col("_t")).cast("binary"), 256))).alias("full_hash"), *[f"_carry_{k}" for k in carry])
    key = ["_len", "_prefix", "full_hash"]
    # Rows that repeat id and text are counted here and dealt out again below.
    own = store(rows.groupBy("_id", *key).agg(F.count("*").alias("_times"), *[F.first(f"_carry_{k}").alias(f"_carry_{k}") for k in carry]), "text-keys")
    alone = own.where("full_hash is null").select("*", F.col("_id").alias("keep_id"), F.col("_times").alias("group_size"))
    shared = own.where("full_hash is not null")
    groups = shared.groupBy(key).agg(F.max("_id").alias("keep_id"), F.sum("_times").alias("group_size"))
    every = alone.unionByName(shared.join(groups, key).select(*alone.columns))
    # Repeats are dealt out in two steps, so no array grows with them.
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(_times - 1) div {REPEATS}"))).alias("_block"))
    every = every.select("*", F.explode(F.sequence(F.col("_block") * REPEATS + 1, F.least(F.col("_times"), (F.col("_block") + 1) * REPEATS))).alias("_nth"))
    return every.select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        ((F.col("_id").eqNullSafe(F.col("keep_id"))) & (F.col("_nth") == 1)).alias("kept"), "full_hash", *[F.col(f"_carry_{k}").alias(k) for k in carry],
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that :func:`exact_groups` drops, all columns unchanged.

    Of rows that repeat id and text, one stays (with any one's other columns).
    """
    groups = store(exact_groups(docs, id_col, text_col), "exact-groups")
    gone = groups.where("not kept and full_hash is not null").select(F.col(id_col).alias("gone_id"), F.col("full_hash").alias("gone_digest"), F.col("keep_id").eqNullSafe(F.col(id_col)).alias("again"))
    rows = keyed_rows(docs, id_col, F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    left = without(rows, store(gone.where("not again").select("gone_id", "gone_digest").distinct(), "copies"))
    repeats = store(gone.where("again").select("gone_id", "gone_digest").distinct(), "repeats")
    if not repeats.isEmpty():
        same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_digest") == F.col("gone_digest"))
        once = left.join(small(repeats), same, "left_semi").groupBy("own_id", "own_digest").agg(F.first("row").alias("row"))
        left = without(left, repeats).select("row").unionByName(once.select("row"))
    return left.select("row.*")
