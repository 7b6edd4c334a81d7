"""linkloom: dependency-graph analytics on Spark DataFrames."""

from linkloom.operators.graph import Graph, graph_from_edges
from linkloom.plans.build import Build, build

__all__ = ["Build", "Graph", "build", "graph_from_edges"]
