"""Programs as graphs: building, rewriting, partitioning, costing, and lowering to DataFrames."""

from .graph import Graph, Kind, Node, chain
from .lowering import lower, run_staged
from .planner import Options, Plan, best_plan, plan_cost, plans_of, viable_plans

__all__ = ["Graph", "Kind", "Node", "Options", "Plan", "best_plan", "chain", "lower", "plan_cost", "plans_of", "run_staged", "viable_plans"]
