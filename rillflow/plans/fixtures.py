"""Programs whose plans and rates are known: for the planner's queries and tests."""

from __future__ import annotations

from ..operators.windows import ChopTime
from .graph import Fold, Graph, Kind, Node, chain


def _n(id_: int, kind: Kind, **more) -> Node:
    return Node(id_, kind, **more)


def _edges(*paths: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    return tuple(dict.fromkeys(e for p in paths for e in zip(p, p[1:], strict=False)))


def _same(v):
    return v


def _still(v):
    return v == v


def _falls(v, acc):
    return acc > v


def _newest(acc, v):
    return v


def path() -> Graph:
    return Graph((_n(0, Kind.SOURCE, rate=1), _n(1, Kind.MAP), _n(2, Kind.SINK)), _edges((0, 1, 2)))


def merged() -> Graph:
    return Graph((_n(0, Kind.SOURCE, rate=1), _n(4, Kind.MERGE), _n(2, Kind.SINK), _n(3, Kind.SOURCE, rate=1)), _edges((0, 4, 2), (3, 4)))


def two_maps() -> Graph:
    nodes = (_n(0, Kind.SOURCE, rate=1), _n(1, Kind.MAP), _n(4, Kind.MERGE), _n(2, Kind.SINK), _n(3, Kind.SOURCE, rate=1), _n(5, Kind.MAP))
    return Graph(nodes, _edges((0, 1, 4, 2), (3, 5, 4)))


def taxi() -> Graph:
    """Frequent routes: 1.2 trips a second, 95 % within the grid, one change in ten."""
    return chain(
        _n(0, Kind.SOURCE, rate=1.2, service=10000),
        _n(0, Kind.MAP, service=10000),
        _n(0, Kind.FILTER, selectivity=0.95, service=10000),
        _n(0, Kind.WINDOW, service=10000),
        _n(0, Kind.MAP, service=10),
        _n(0, Kind.FILTER_ACC, selectivity=0.1, service=10000),
        _n(0, Kind.SINK, service=10000),
    )


def wearable(rate: float = 20.947272312257475) -> Graph:
    """Steps from a wearable's readings (``rate`` a second), with measured service times; its functions stand in for the program's."""
    reading, vector = "(Int,Int,Int,Int)", "(Int,Int,Int)"
    return chain(
        _n(0, Kind.SOURCE, rate=rate, service=1 / 1.5e-7, out_type=reading),
        _n(0, Kind.FILTER, fn=_still, selectivity=1 - 5 / 275310, service=1 / 7.73e-7, out_type=reading),
        _n(0, Kind.MAP, fn=_same, service=1 / 9.19e-7, out_type=vector),
        _n(0, Kind.MAP, fn=_same, service=1 / 3.4e-6, out_type="Int"),
        _n(0, Kind.FILTER_ACC, fn=_falls, fold=Fold(_newest, 0), selectivity=0.020272, service=1 / 1.6e-6, out_type="Int"),
        _n(0, Kind.WINDOW, maker=ChopTime(120), service=1 / 1.24e-6, out_type="[Int]"),
        _n(0, Kind.MAP, fn=_same, service=1 / 1.5e-7, out_type="Int"),
        _n(0, Kind.SINK, service=1 / 1.5e-7),
    )


def too_much() -> Graph:
    """A source twice as fast as the map after it: no plan can run it."""
    return chain(_n(0, Kind.SOURCE, rate=2, service=100), _n(0, Kind.MAP, service=1), _n(0, Kind.SINK, service=100))


def overloaded_merge() -> Graph:
    """Merge, then a filter that cannot keep up: viable once the filter stands before the merge."""
    nodes = (
        _n(1, Kind.SOURCE, rate=1, service=100),
        _n(2, Kind.SOURCE, rate=1, service=100),
        _n(3, Kind.MERGE, service=1.5),
        _n(4, Kind.FILTER, fn=abs, selectivity=0.5, service=10),
        _n(5, Kind.SINK, service=100),
    )
    return Graph(nodes, _edges((1, 3, 4, 5), (2, 3)))


def departures() -> dict[str, tuple[Graph, int]]:
    """Operators with known departure rates."""
    three = Graph((*[_n(i, Kind.SOURCE, rate=1) for i in (1, 2, 3)], _n(6, Kind.MERGE), _n(7, Kind.SINK)), _edges((1, 6, 7), (2, 6), (3, 6)))
    two = Graph((_n(1, Kind.SOURCE, rate=1), _n(3, Kind.SOURCE, rate=2), _n(8, Kind.JOIN), _n(7, Kind.FILTER, selectivity=0.5), _n(6, Kind.SINK)), _edges((1, 8, 7, 6), (3, 8)))
    blocks = Graph((_n(1, Kind.SOURCE, rate=1), _n(9, Kind.WINDOW, maker=ChopTime(120)), _n(6, Kind.SINK)), _edges((1, 9, 6)))
    return {"merge": (three, 6), "join": (two, 8), "filter": (two, 7), "block": (blocks, 9)}
