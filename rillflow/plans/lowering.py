"""Lowering a program to DataFrames: each operator becomes its batch form, and Catalyst optimises the whole."""

from __future__ import annotations

from ..events import EventStream
from ..operators import basic, joins, merging, stateful, windows
from .graph import Graph, Kind, Node
from .partitions import Parts


def _one(node: Node, inputs: list[EventStream]) -> EventStream:
    kind = node.kind
    if kind is Kind.SOURCE:
        return node.stream
    if kind is Kind.MERGE:
        return merging.merge(inputs) if len(inputs) > 1 else inputs[0]
    if kind is Kind.JOIN:
        return joins.join_zip(*inputs)
    (stream,) = inputs
    if kind is Kind.SINK:
        return stream
    if kind is Kind.MAP:
        out = basic.map_values(stream, node.fn)
        return out if node.out is None else out.with_df(out.df.withColumn("value", out.df["value"].cast(node.out)))
    if kind is Kind.FILTER:
        return basic.filter_events(stream, node.fn)
    if kind is Kind.EXPAND:
        return basic.expand(stream)
    if kind is Kind.WINDOW:
        return windows.window(stream, node.maker)
    if kind is Kind.FILTER_ACC:
        return stateful.filter_acc(stream, node.fold.step, node.fold.start, node.fn)
    if isinstance(node.fold, str):
        return stateful.scan(stream, node.fold)
    step, view = node.fold.step, node.fn or (lambda acc: acc)

    def advance(acc, v):
        acc = step(acc, v)
        return acc, True, view(acc)

    return stateful.sequential(stream, lambda: node.fold.start, advance, node.out or stream.value_type)


def lower(g: Graph) -> EventStream:
    """The stream at the program's end."""
    done: dict[int, EventStream] = {}
    for i in g.topological():
        done[i] = _one(g[i], [done[a] for a in g.inputs(i)])
    return done[g.root()]


def run_staged(g: Graph, parts: Parts, folder: str) -> EventStream:
    """Runs a split program stage by stage, each as a job of its own; a stage's results go to the next through a Parquet table in ``folder``.

    Returns the stream at the program's end, whose stage reads its links and runs when it is used. ``folder`` must be shared
    by the driver and the executors; who calls removes it.
    """
    place = {i: k for k, i in enumerate(g.topological())}
    links: dict[int, EventStream] = {}
    for k, part in enumerate(sorted(parts, key=lambda p: max(place[i] for i in p))):
        done = dict(links)
        for i in sorted(part, key=place.get):
            done[i] = _one(g[i], [done[a] for a in g.inputs(i)])
        end = max(part, key=place.get)
        if end == g.root():
            return done[end]
        out, path = done[end], f"{folder.rstrip('/')}/stage{k}"
        out.df.write.parquet(path)
        links[end] = out.with_df(out.df.sparkSession.read.schema(out.df.schema).parquet(path))
    raise ValueError("no stage holds the program's end")


def explained(g: Graph, parts: Parts) -> str:
    """The plan as text: a line for each stage, in the order of the flow."""
    line = lambda part: " -> ".join(f"{g[i].kind.value}#{i}" for i in reversed(part))
    return "\n".join(f"stage {k}: {line(part)}" for k, part in enumerate(reversed(parts)))
