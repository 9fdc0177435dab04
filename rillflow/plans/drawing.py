"""Programs as GraphViz text."""

from __future__ import annotations

from .costs import bandwidth, loads
from .graph import Graph, Node
from .partitions import Parts


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _name(n: Node) -> str:
    return n.label or n.kind.value


def to_dot(g: Graph, show: str = "plain", parts: Parts | None = None) -> str:
    """GraphViz source; ``show``: plain, load (arrival and utilisation) or bandwidth (on edges). Stages are drawn as clusters."""
    found = {x.id: x for x in loads(g)} if show == "load" else {}

    def node(i: int) -> str:
        text = f"{i}: {_name(g[i])}"
        if i in found:
            text += f"\narrival {found[i].arrival:.4g}/s\nutilisation {found[i].utilisation:.4g}"
        return f"  n{i} [label={_quoted(text)}];"

    lines = ["digraph program {", "  rankdir=LR;"]
    for k, part in enumerate(parts or ()):
        lines += [f"  subgraph cluster_{k} {{", f"    label={_quoted(f'stage {k}')};", *["  " + node(i) for i in part], "  }"]
    lines += [node(n.id) for n in g.nodes] if not parts else []
    for a, b in g.edges:
        rate = bandwidth(g, a) if show == "bandwidth" else None
        lines.append(f"  n{a} -> n{b}" + (f" [label={_quoted(f'{rate:.4g} B/s')}]" if rate is not None else "") + ";")
    return "\n".join([*lines, "}"])
