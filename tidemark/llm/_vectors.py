"""Vectors in blocks: every query against every row, with both sides in groups of bounded size.

Rows are dealt into blocks of about ``block_rows`` and queries into groups of about ``query_rows``.
A row goes to its block once for each query group, a query to its group once for each block, and the
two meet by (block, group). So one task holds one block and one group at a time, at any size of table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A group of queries is cut further while it has more than so many rows and there are fewer than so many groups.
SMALL_GROUPS, SMALL_GROUP_ROWS = 2, 512


def valid_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector) of rows with an id and a vector without null or non-finite components; an array<float> or array<double>."""
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of_each(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's (``q``) best ``k`` of (q, query_id, vec_id, score); ties go to the smaller vec_id."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def numbered(number: Column, parts: Column) -> Column:
    """0 .. parts - 1 by a row's number: in turn within a partition, and not all partitions begin with 0."""
    return F.pmod(number + F.shiftrightunsigned(number, 33), parts.cast("long")).cast("int")


def search_blocks(
    rows: DataFrame, query: Column, function: Callable[[pa.Table, pa.Table], pa.Table], k: int, score_type: str, block_rows: int, query_rows: int, hashed: Callable[[DataFrame, bool], DataFrame] | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's best ``k`` over all blocks.

    ``rows`` has (id, vector); ``query`` says which rows are queries. Rows of one length (``d``) make up their
    own blocks and groups. ``function`` gets a block (id, vector) and a query group (q, own, direction), and
    returns (q, query_id, vec_id, score) with the block's best ``k`` of each query. ``hashed`` adds a column ``strings``
    to rows or (if its second argument is true) to queries, before they are copied; ``largest`` is the length's largest norm.
    """
    sized = rows.withColumn("d", F.size("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # one row for each length of vector. n lengths take 4 n^2 bytes of table at least, so even 100 TB have no more than 5 million: safe to broadcast
    facts = sized.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(query).alias("m"), F.max(norm).alias("largest")).where(F.col("m") > 0)
    several = F.least(F.lit(SMALL_GROUPS), F.ceil(F.col("m") / SMALL_GROUP_ROWS))  # so that a table of one block is more than one task
    facts = facts.select("d", F.ceil(F.col("n") / block_rows).alias("blocks"), F.greatest(F.ceil(F.col("m") / query_rows), several).alias("groups"), "largest")
    facts = F.broadcast(facts)
    number = F.monotonically_increasing_id()
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    extra = ["strings"] if hashed else []
    left = sized.withColumn("number", number).join(facts, "d").withColumn("block", numbered(F.col("number"), F.col("blocks"))).select("d", "block", "groups", "largest", "id", "vector")
    left = (hashed(left, False) if hashed else left).withColumn("group", upto("groups")).select("d", "block", "group", "id", "vector", *extra)
    # names and attributes of its own: two sides that share them lose columns to the optimizer when few of the result's are read
    asked = sized.where(query).select(F.col("id").alias("own"), F.col("vector").alias("direction"), F.col("d").alias("e"), number.alias("q"))
    asked = asked.join(F.broadcast(facts.select(F.col("d").alias("e"), F.col("blocks").alias("e_blocks"), F.col("groups").alias("e_groups"), "largest")), "e")
    asked = asked.withColumn("e_group", numbered(F.col("q"), F.col("e_groups"))).select("e", "e_group", "e_blocks", "largest", "q", "own", "direction")
    right = (hashed(asked, True) if hashed else asked).withColumn("e_block", upto("e_blocks")).select("e", "e_block", "e_group", "q", "own", "direction", *(F.col(c).alias("own_strings") for c in extra))
    found = left.groupBy("d", "block", "group").cogroup(right.groupBy("e", "e_block", "e_group")).applyInArrow(function, f"q long, query_id long, vec_id long, score {score_type}")
    return best_of_each(found, k)


def hits_table(q: list, query_id: list, vec_id: list, score: list, score_type: pa.DataType) -> pa.Table:
    """The lists of arrays that a block's search gathers, as the table that :func:`search_blocks` wants."""
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"q": join(q, pa.int64()), "query_id": join(query_id, pa.int64()), "vec_id": join(vec_id, pa.int64()), "score": join(score, score_type)})
