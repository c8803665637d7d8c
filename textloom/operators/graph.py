"""Graphs as triples (s, p, o): reading, patterns as joins, components and serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import settle

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)'


def triples(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, p, o) of N-Triples, a line each; comments and what can't be read are left out."""
    pattern = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return lines.select(*(c.alias(n) for c, n in zip(parts, "spo"))).where("s <> ''")


def matches(graph: DataFrame, patterns: list[tuple[str, str, str]], select: list[str]) -> DataFrame:
    """Distinct solutions of a basic graph pattern, whose variables begin with a question mark: each pattern filters the triples, and those that share variables are joined by them."""
    found = None
    for pattern in patterns:
        rows, seen = graph, {}
        for column, term in zip("spo", pattern):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term in seen:
                rows = rows.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        rows = rows.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))
        if found is None:
            found = rows
            continue
        shared = [c for c in rows.columns if c in found.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        found = found.join(rows, shared)
    return found.select(*(v.lstrip("?") for v in select)).distinct()


def literal(term: Column | str) -> Column:
    """The text of a literal without quotes, language and type, or of an address without its brackets."""
    c = F.col(term) if isinstance(term, str) else term
    return F.when(c.startswith('"'), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(F.regexp_replace(c, "^<|>$", ""))


def components(graph: DataFrame) -> DataFrame:
    """(node, component): subjects and objects (without literals), by the least node that each is connected with; rounds of least neighbours with jumps, logarithmic in most graphs."""
    edges = graph.where(~F.col("o").startswith('"')).select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    alone = graph.select(F.col("s").alias("node")).distinct()
    label = settle(both.select(F.col("a").alias("node")).unionByName(alone).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        least = label.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        fresh = settle(least.join(jump, "component", "left").select("node", F.least("component", "beyond").alias("component"), "was"))
        label = fresh.select("node", "component")
        if fresh.where("component <> was").isEmpty():
            return label


def subjects(graph: DataFrame) -> DataFrame:
    """(s, record): each subject's statements as JSON."""
    return graph.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("o")).groupBy("s").agg(F.to_json(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("record"))


def lines(graph: DataFrame) -> DataFrame:
    """(line): the triples as N-Triples."""
    return graph.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))
