"""The star-schema tables as a call graph: rows become symbols, foreign keys become calls.

Suppliers call the parts they ship and orders the suppliers they use (by name,
so homonymous parts are ambiguous), customers call their orders, and events
call their type, which no symbol defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve_calls
from ..plans.shared import cut, few

NODES = [("part", "p_partkey", "p_name", "part:", "function"), ("supplier", "s_suppkey", "s_name", "supp:", "class"), ("orders", "o_orderkey", None, "ord:", "method"), ("customer", "c_custkey", "c_name", "cust:", "variable")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(key: str):
    return F.concat(F.lit("m"), (F.col(key) % 25).cast("string"), F.lit(".ts"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, file, seq); ``seq`` orders by table, then key."""
    out = None
    for order, (table, key, name, prefix, kind) in enumerate(NODES):
        label = F.col(name) if name else F.concat(F.lit("Order#"), F.col(key).cast("string"))
        seq = F.struct(F.lit(order).alias("t"), F.col(key).cast("long").alias("k"))
        one = _read(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), label.alias("name"), F.lit(kind).alias("kind"), _file(key).alias("file"), seq.alias("seq"))
        out = one if out is None else out.unionByName(one)
    return out


def _sources(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> list[tuple[DataFrame, DataFrame | None]]:
    """(calls, the names they may have) of each kind of call; the names are None where nearly every call has its own.

    ``names`` (to_name) keeps calls to these names; the tables that hold names
    are then narrowed before the rows that use them are met.  Where at most
    ``FEW`` of their rows are left, these are broadcast, so that lines are not
    moved for parts that are many only because their name is common.
    """
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("to_name"))
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("to_name"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("to_name"))
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("to_name"))
    if names is not None:
        part, supplier = (few(cut(t.join(names, "to_name", "left_semi"), "narrowed")) for t in (part, supplier))
        orders, events = (t.join(names, "to_name", "left_semi") for t in (orders, events))

    def calls(df: DataFrame, prefix: str, caller: str, source: int, *keys) -> DataFrame:
        parts = [k if not isinstance(k, str) else F.col(k) for k in (*keys, *[F.lit(0)] * (4 - len(keys)))]
        seq = F.struct(F.lit(source).alias("t"), *(p.cast("long").alias(f"k{i}") for i, p in enumerate(parts)))
        return df.select(F.concat(F.lit(prefix), F.col(caller).cast("string")).alias("from_id"), "to_name", _file(caller).alias("file"), seq.alias("seq"))

    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return [
        (calls(line.join(part, "l_partkey"), "supp:", "l_suppkey", 0, *keys), part),
        (calls(line.join(supplier, "l_suppkey"), "ord:", "l_orderkey", 1, *keys), supplier),
        (calls(orders, "cust:", "o_custkey", 2, "o_orderkey"), None),
        (calls(events, "cust:", "user_id", 3, "event_id"), events),
    ]


def raw_calls(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """(from_id, to_name, file, seq), all or those to ``names`` (to_name); ``seq`` orders by source, then its keys."""
    out = None
    for calls, _ in _sources(spark, sf_dir, names):
        out = calls if out is None else out.unionByName(calls)
    return out


def resolved_calls(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """``raw_calls`` resolved against ``nodes``: each kind by the names it may have, so that lines and events are not moved for it."""
    out = None
    for calls, names in _sources(spark, sf_dir):
        edges = resolve_calls(calls, nodes, names=names)
        out = edges if out is None else out.unionByName(edges)
    return out


def link_calls(pages: DataFrame) -> DataFrame:
    """(from_id, to_name, calls): how often a page (page_id, html) links to each target, as calls by name."""
    links = pages.select(F.col("page_id").alias("from_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("to_name"))
    return links.groupBy("from_id", "to_name").agg(F.count("*").alias("calls"))
