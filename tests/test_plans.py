import random
from dataclasses import replace

import pytest
from test_operators import events, make, rows

from rillflow.plans import Kind, Node, Options, best_plan, chain, fixtures, lower, plan_cost, plans_of, viable_plans
from rillflow.plans import rewriting as rw
from rillflow.plans.costs import arrivals, event_size, loads, output_rate, over_bandwidth, over_utilised, stages_with_sources
from rillflow.plans.drawing import to_dot
from rillflow.plans.graph import Fold, Graph, joined
from rillflow.plans.lowering import explained, run_staged
from rillflow.plans.partitions import all_partitions, overlaid, split
from rillflow.queries import ORACLES, QUERIES, _EXPANDS, _VALUES


def test_partitions():
    assert all_partitions(fixtures.path()) == [((2,), (1,), (0,)), ((2,), (1, 0)), ((2, 1), (0,))]
    assert all_partitions(fixtures.merged()) == [((2,), (4,), (0,), (3,)), ((2, 4), (0,), (3,))]
    assert [[list(p) for p in parts] for parts in all_partitions(fixtures.two_maps())] == [
        [[2], [4], [1], [0], [5], [3]], [[2], [4], [1], [0], [5, 3]], [[2], [4], [1, 0], [5], [3]], [[2], [4], [1, 0], [5, 3]],
        [[2, 4], [1], [0], [5], [3]], [[2, 4], [1], [0], [5, 3]], [[2, 4], [1, 0], [5], [3]], [[2, 4], [1, 0], [5, 3]],
    ]


def test_split_and_overlay():
    g = fixtures.two_maps()
    for parts in all_partitions(g):
        stages, cut = split(g, parts)
        back = overlaid(stages, cut)
        assert back.same_as(g) and set(back.edges) == set(g.edges)


def test_random_trees_have_few_enough_stages():
    rnd = random.Random(1)
    for _ in range(30):
        ids, edges, nodes = [0], [], [Node(0, Kind.SINK)]
        for i in range(1, rnd.randrange(3, 9)):
            to = rnd.choice([n.id for n in nodes if n.kind is not Kind.SOURCE])
            if to in {b for _, b in edges} and nodes[to].kind is not Kind.MERGE:
                nodes.append(Node(i, Kind.MAP))
                first = next(a for a, b in edges if b == to)
                edges.remove((first, to))
                edges += [(first, i), (i, to)]
            else:
                nodes.append(Node(i, rnd.choice([Kind.MAP, Kind.MERGE, Kind.SOURCE])))
                edges.append((i, to))
            ids.append(i)
        g = Graph(tuple(nodes), tuple(edges))
        assert max(map(len, all_partitions(g))) <= len(nodes)


def test_queueing():
    got = [x.arrival for x in loads(fixtures.taxi())]
    assert got == pytest.approx([1.2, 1.2, 1.2, 1.14, 1.14, 1.14, 0.114])
    import numpy as np

    p = np.array([[0, 0.5, 0.5], [0, 0, 0], [0, 0, 0.0]])
    assert arrivals(p, np.array([1.0, 0, 0])).tolist() == [1, 0.5, 0.5]
    assert output_rate(fixtures.merged(), 4) == 2 and output_rate(fixtures.merged(), 0) == 1
    busy = chain(Node(0, Kind.SOURCE, rate=8), Node(0, Kind.MAP, service=0.2), Node(0, Kind.SINK))
    assert over_utilised(loads(busy))
    quiet = next(x for x in loads(chain(Node(0, Kind.SOURCE, rate=1), Node(0, Kind.MAP, service=4), Node(0, Kind.SINK))) if x.service)
    assert (quiet.utilisation, quiet.customers, quiet.response, quiet.queue_time) == pytest.approx((0.25, 1 / 3, 1 / 3, 1 / 12))


def test_bandwidth():
    assert event_size("Int") < event_size("(Int,Int,Int)") and event_size("IO ()") is None and event_size("[Int]") is None
    assert event_size("String3") - event_size("String1") == 8
    g = fixtures.two_maps()
    assert stages_with_sources(g, ((2, 4), (1, 0), (5, 3))) == {0, 1, 3, 5}
    line = chain(Node(0, Kind.SOURCE, rate=1, out_type="Int"), Node(0, Kind.SINK))
    assert over_bandwidth(line, ((2,), (1,)), 50) and not over_bandwidth(line, ((2,), (1,)), 500)


def test_planner():
    assert not list(viable_plans(fixtures.too_much()))
    with pytest.raises(ValueError):
        best_plan(fixtures.too_much())
    g = fixtures.overloaded_merge()
    assert all(plan_cost(p, Options()) is None for p in plans_of(g))
    best = best_plan(g)
    assert best.cost == len(best.parts) and best.graph.of_kind(Kind.FILTER)[0].id != 4


def test_nine_steps_need_three_stages():
    g = chain(Node(0, Kind.SOURCE, rate=1, service=1), *[Node(0, Kind.MAP, service=1) for _ in range(7)], Node(0, Kind.SINK, service=1))
    plans = list(viable_plans(g, Options(rules=[])))
    assert min(p.cost for p in plans) == 3 and ((9, 8, 7), (6, 5, 4), (3, 2, 1)) in [p.parts for p in plans]
    assert all(len(part) <= 3 for p in plans for part in p.parts)


def test_rates_add_up():
    assert rw.sum_rates(1, 1, 1) == 0.5 and rw.sum_rates(5, 0.5, 10) == 4 and rw.sum_rates(0, 1, 5) == 0


def test_variants_are_different_and_have_a_lineage():
    g = fixtures.wearable()
    found = rw.variants(replace_fns(g))
    assert len({v.graph.shape() for v in found}) == len(found) > 5
    assert all(len(v.lineage()) <= 5 for v in found) and found[0].lineage() == []


def replace_fns(g):
    return Graph(tuple(replace(n, fn=n.fn or (abs if n.kind in (Kind.MAP, Kind.FILTER) else None), fold=n.fold or (Fold(max, 0) if n.kind is Kind.FILTER_ACC else None)) for n in g.nodes), g.edges)


@pytest.mark.parametrize("name", sorted(_VALUES))
@pytest.mark.parametrize("seed", [1, 2])
def test_pure_rules_keep_results(spark, name, seed):
    rule, nodes, _ = _VALUES[name]
    g = chain(Node(0, Kind.SOURCE, stream=make(spark, events(seed))), *nodes)
    out = rw.apply(rule, g)
    assert not out.same_as(g) and rows(lower(out)) == rows(lower(g))


@pytest.mark.parametrize("name", sorted(set(_EXPANDS) - {"expand_expand"}))
def test_list_rules_keep_results(spark, name):
    rule, nodes, _ = _EXPANDS[name]
    lists = [(t, None if v is None else list(range(v % 5))) for t, v in events(3, valueless=False)]
    g = chain(Node(0, Kind.SOURCE, stream=make(spark, lists, "array<bigint>")), *nodes)
    assert rows(lower(rw.apply(rule, g))) == rows(lower(g))


def test_merge_rules_keep_results(spark):
    parts = [chain(Node(0, Kind.SOURCE, stream=make(spark, events(k, untimed=False)))) for k in range(3)]
    g = joined(parts, Node(0, Kind.MERGE), Node(0, Kind.FILTER, fn=lambda v: v > 20))
    hoisted = rw.apply(rw.merge_filter, g)
    assert len(hoisted.of_kind(Kind.FILTER)) == 3 and rows(lower(hoisted)) == rows(lower(g))
    back = rw.apply(rw.filter_merge, joined_sink(hoisted))
    assert len(back.of_kind(Kind.FILTER)) == 1 and rows(lower(back)) == rows(lower(g))


def joined_sink(g):
    end, new = g.root(), g.fresh()
    return Graph((*g.nodes, Node(new, Kind.SINK)), (*g.edges, (end, new)))


def test_reshaping_rules_are_opt_in():
    assert not set(rw.RESHAPING) & set(rw.DEFAULT) and len(rw.DEFAULT) == 21 and len(rw.RESHAPING) == 2


def test_rules_leave_shared_inputs_alone():
    nodes = (Node(1, Kind.SOURCE), Node(2, Kind.FILTER, fn=abs), Node(3, Kind.FILTER, fn=abs), Node(4, Kind.MAP, fn=abs), Node(5, Kind.MERGE))
    g = Graph(nodes, ((1, 2), (2, 3), (2, 4), (3, 5), (4, 5)))
    assert rw.apply(rw.filter_fuse, g) is None


def test_equality_ignores_ids_and_text_forms():
    g = fixtures.path()
    again = Graph(tuple(replace(n, id=n.id + 10) for n in g.nodes), tuple((a + 10, b + 10) for a, b in g.edges))
    assert g.same_as(again) and not g.same_as(fixtures.merged())
    dot = to_dot(fixtures.taxi(), "load", all_partitions(fixtures.taxi())[0])
    assert "cluster_0" in dot and "utilisation" in dot and "n1 -> n2" in dot
    assert '\\"' in to_dot(Graph((Node(1, Kind.SOURCE, label='a "b"'),)))
    assert "B/s" in to_dot(fixtures.wearable(), "bandwidth")
    assert explained(g, ((2, 1), (0,))).splitlines() == ["stage 0: source#0", "stage 1: map#1 -> sink#2"]


def test_every_rule_has_a_query():
    names = {f"rw_{r.__name__}" for r in rw.DEFAULT + rw.RESHAPING}
    assert names <= set(QUERIES) and set(QUERIES) == set(ORACLES)


def test_a_program_run_in_stages_gives_what_it_gives_as_a_whole(spark, tmp_path):
    streams = [make(spark, events(seed, 30)) for seed in (1, 2)]
    sources = [chain(Node(0, Kind.SOURCE, stream=s, rate=1), Node(0, Kind.MAP, fn=lambda v: v + 1)) for s in streams]
    g = joined(sources, Node(0, Kind.MERGE), Node(0, Kind.FILTER, fn=lambda v: v > 3), Node(0, Kind.SCAN, fold="sum"), Node(0, Kind.SINK))
    whole = rows(lower(g))
    for k, parts in enumerate(all_partitions(g)[::3]):
        assert rows(run_staged(g, parts, str(tmp_path / str(k)))) == whole


def test_variants_of_the_wearable_program():
    g = fixtures.wearable()
    found = list(rw.variants(g))
    assert len(found) > 20 and any(v.graph.same_as(g) for v in found)
    first = next(n for n in rw.apply(rw.map_filter, chain(Node(0, Kind.SOURCE), Node(0, Kind.MAP, fn=abs, service=2), Node(0, Kind.FILTER, fn=abs, service=3), Node(0, Kind.SINK))).nodes if n.kind is Kind.FILTER)
    assert first.service == 5
