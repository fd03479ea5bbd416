"""Result sub-databases: for a join query, the rows of each relation that take part in a result."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

#: relation -> relation -> (own key, partner's key)
Graph = dict[str, dict[str, tuple[str, str]]]


def graph_of(edges: list[tuple[str, str, str, str]]) -> Graph:
    """edges: (relation, its key, relation, its key)."""
    out: Graph = {}
    for a, ka, b, kb in edges:
        out.setdefault(a, {})[b] = (ka, kb)
        out.setdefault(b, {})[a] = (kb, ka)
    return out


def is_tree(graph: Graph) -> bool:
    if not graph:
        return True
    seen, todo = set(), [next(iter(graph))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += graph[x]
    return len(seen) == len(graph) and sum(map(len, graph.values())) == 2 * (len(graph) - 1)


def reduction_order(graph: Graph, root: str) -> list[tuple[str, str]]:
    """(parent, child) in breadth-first order from root. Only for trees."""
    if not is_tree(graph):
        raise ValueError("semi-joins reduce fully only if the join graph is a tree")
    out, seen, todo = [], {root}, deque([root])
    while todo:
        x = todo.popleft()
        for y in graph[x]:
            if y not in seen:
                seen.add(y)
                out.append((x, y))
                todo.append(y)
    return out


def reduce_fully(relations: dict[str, DataFrame], graph: Graph, root: str) -> dict[str, DataFrame]:
    """Semi-joins from the leaves to the root and back; duplicates in a relation stay."""
    out, order = dict(relations), reduction_order(graph, root)
    steps = [(a, b) for a, b in reversed(order)] + [(b, a) for a, b in order]
    for kept, by in steps:
        own, other = graph[kept][by]
        keys = out[by].select(out[by][other].alias("__key"))
        out[kept] = out[kept].join(keys, out[kept][own] == keys["__key"], "left_semi")
    return out


def join_all(relations: dict[str, DataFrame], graph: Graph, root: str) -> DataFrame:
    out = relations[root]
    for a, b in reduction_order(graph, root):
        ka, kb = graph[a][b]
        out = out.join(relations[b], out[ka] == relations[b][kb])
    return out


def yannakakis(relations: dict[str, DataFrame], graph: Graph, root: str) -> DataFrame:
    """Reduces, then joins: no intermediate result has a row that the end result lacks."""
    return join_all(reduce_fully(relations, graph, root), graph, root)


def dynamic(joined: DataFrame, columns: list[str]) -> DataFrame:
    """A distinct projection of the join; works for any join graph."""
    return joined.select(*columns).distinct()


def result_database(relations: dict[str, DataFrame], graph: Graph, root: str, joined: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sub-database: by the reducer for trees, else by distinct projections of `joined`."""
    if is_tree(graph):
        return reduce_fully(relations, graph, root)
    if joined is None:
        raise ValueError("a cyclic join graph needs the join itself")
    return {n: dynamic(joined, r.columns) for n, r in relations.items()}
