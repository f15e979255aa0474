"""Nested JSON to flat key/value pairs.

Two forms: :func:`flatten_rows` makes a row of each pair with SQL's VARIANT alone, to a depth given in
advance; :func:`flatten_column` makes an array of pairs in each row, to any depth, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import rounded

#: What stands before and after a key below the top, for each style.
STYLES = {"dot": (".", ""), "path": ("/", ""), "rails": ("[", "]"), "underscore": ("_", "")}
ID_ENDINGS = ("_id", "_ids", "_code")


def expanded(key: Column, value: Column) -> tuple[Column, Column]:
    """Key and value with the id part of a true path moved to the value.

    'a.b_id.X.seen' = true becomes 'a.b_id' = 'X.seen', at the first part but the last that ends like an id.
    """
    parts = F.split(key, "\\.")
    n = F.size(parts)
    ids = F.transform(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda p: F.when(p.rlike("_(id|ids|code)$"), 1).otherwise(0))
    at = F.array_position(ids, 1).cast("int")
    moves = (value == "true") & (at > 0)
    head, rest = F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(1))), "."), F.array_join(F.slice(parts, at + 1, F.greatest(n - at, F.lit(0))), ".")
    return F.when(moves, head).otherwise(key), F.when(moves, rest).otherwise(value)


def flatten_rows(df: DataFrame, json_col: str, max_depth: int = 4, prefix: str = "", style: str = "dot", expand: bool = False) -> DataFrame:
    """The other columns of ``df`` with ``key`` and ``value`` for each leaf; malformed JSON has none.

    Numbers are rounded half to even, null becomes '<nil>', empty containers vanish. Leaves deeper
    than ``max_depth`` raise an error.
    """
    before, after = STYLES[style]
    carried = [c for c in df.columns if c != json_col]

    def is_nested():
        kind = F.schema_of_variant("_v")
        return kind.startswith("OBJECT") | kind.startswith("ARRAY")

    level = df.select(*carried, F.try_parse_json(F.col(json_col)).alias("_v"), F.lit(prefix).alias("_path")).where(is_nested())
    for depth in range(max_depth):
        # one pass: a container gives way to its parts, a leaf goes on as it is
        level = level.withColumn("_inner", F.when(is_nested(), F.col("_v")))
        parts = df.sparkSession.tvf.variant_explode_outer(F.col("_inner").outer()).toDF("_pos", "_key", "_part")
        name = F.coalesce("_key", F.col("_pos").cast("string"))
        deeper = F.concat("_path", name) if depth == 0 else F.concat("_path", F.lit(before), name, F.lit(after))
        opened, inside = F.col("_inner").isNotNull(), name.isNotNull()
        level = level.lateralJoin(parts).where(~opened | inside).select(*carried, F.when(opened, F.col("_part")).otherwise(F.col("_v")).alias("_v"), F.when(opened, deeper).otherwise(F.col("_path")).alias("_path"))
    kind = F.schema_of_variant("_v")
    text = F.when(kind == "VOID", "<nil>").when(kind.isin("STRING", "BOOLEAN"), F.variant_get("_v", "$", "string")).otherwise(rounded(F.try_variant_get("_v", "$", "double")))
    fits = F.when(is_nested(), F.raise_error(F.lit(f"JSON nests deeper than {max_depth}")).cast("string")).otherwise(text)
    found = level.select(*carried, F.col("_path").alias("key"), fits.alias("value"))
    if expand:
        key, value = expanded(F.col("key"), F.col("value"))
        found = found.withColumns({"key": key, "value": value})
    return found


def flatten_value(value: object, prefix: str = "", style: str = "dot") -> list[tuple[str, str]]:
    """The pairs of one parsed JSON value, in order of key and value."""
    before, after = STYLES[style]
    found, todo = [], [(value, prefix, True)]
    while todo:
        node, path, top = todo.pop()
        if isinstance(node, (dict, list)):
            items = node.items() if isinstance(node, dict) else enumerate(node)
            todo += [(v, f"{path}{k}" if top else f"{path}{before}{k}{after}", False) for k, v in items]
        elif isinstance(node, bool):
            found.append((path, "true" if node else "false"))
        elif node is None:
            found.append((path, "<nil>"))
        elif isinstance(node, (int, float)):
            found.append((path, f"{float(node):.0f}"))
        else:
            found.append((path, str(node)))
    return sorted(found)


def expand_pair(key: str, value: str) -> tuple[str, str]:
    parts = key.split(".")
    if value == "true":
        for i, part in enumerate(parts[:-1]):
            if part.endswith(ID_ENDINGS):
                return ".".join(parts[: i + 1]), ".".join(parts[i + 1 :])
    return key, value


def flatten_column(text: Column, prefix: str = "", style: str = "dot", expand: bool = False) -> Column:
    """An array of (key, value) for each JSON text, to any depth; null for malformed JSON."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = []
            for t in texts:
                try:
                    pairs = flatten_value(json.loads(t), prefix, style) if isinstance(t, str) else None
                except ValueError:
                    pairs = None
                if pairs is not None:
                    pairs = [{"key": k, "value": v} for k, v in sorted(expand_pair(*p) if expand else p for p in pairs)]
                rows.append(pairs)
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(run, "array<struct<key:string,value:string>>")(text)


def flatten_to_json(text: Column, prefix: str = "", style: str = "dot") -> Column:
    """Flat JSON from nested JSON."""
    return F.to_json(F.map_from_entries(flatten_column(text, prefix, style)))
