"""Ways to split a program into stages that run apart."""

from __future__ import annotations

from .graph import Graph, Kind

Parts = tuple[tuple[int, ...], ...]


def all_partitions(g: Graph) -> list[Parts]:
    """Every split, walking from the program's end towards its sources.

    A node starts a stage or joins the last one, unless that stage's last node is a merge or a source, or it would hold two of
    sources and sinks.
    """
    order: list[int] = []

    def visit(i: int) -> None:
        if i not in order:
            order.append(i)
            for a in sorted(g.inputs(i)):
                visit(a)

    visit(g.root())
    found: list[list[list[int]]] = [[[order[0]]]] if order else []
    ends = {n.id for n in g.nodes if n.kind in (Kind.SOURCE, Kind.SINK)}
    for node in order[1:]:
        grown = []
        for parts in found:
            grown.append([*parts, [node]])
            last = parts[-1]
            if g[last[-1]].kind not in (Kind.MERGE, Kind.SOURCE) and sum(i in ends for i in (*last, node)) <= 1:
                grown.append([*parts[:-1], [*last, node]])
        found = grown
    return [tuple(tuple(p) for p in parts) for parts in found]


def split(g: Graph, parts: Parts) -> tuple[list[Graph], list[tuple[int, int]]]:
    """The stages as graphs of their own, and the edges cut between them."""
    home = {i: k for k, part in enumerate(parts) for i in part}
    stages = [Graph(tuple(n for n in g.nodes if home[n.id] == k), tuple(e for e in g.edges if home[e[0]] == home[e[1]] == k)) for k in range(len(parts))]
    return stages, [e for e in g.edges if home[e[0]] != home[e[1]]]


def overlaid(stages: list[Graph], cut: list[tuple[int, int]]) -> Graph:
    """The program that was split."""
    return Graph(tuple(n for s in stages for n in s.nodes), (*[e for s in stages for e in s.edges], *cut))
