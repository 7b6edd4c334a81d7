"""Small graphs and file trees, and a brute-force model to compare with."""

from __future__ import annotations

from collections import Counter, defaultdict

from linkloom.operators.graph import graph_from_edges


def edges_df(spark, edges, repo="t"):
    return spark.createDataFrame([(repo, a, b) for a, b in edges] or [], "repo string, source string, target string")


def graph(spark, edges, nodes=(), repo="t"):
    extra = spark.createDataFrame([(repo, n) for n in nodes], "repo string, id string") if nodes else None
    return graph_from_edges(edges_df(spark, edges, repo), extra)


def files_df(spark, tree, repo="t"):
    return spark.createDataFrame([(repo, p, c) for p, c in tree.items()], "repo string, path string, content string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


class Model:
    """The semantics written down directly, for graphs of a few nodes."""

    def __init__(self, edges, nodes=()):
        self.edges = list(edges)
        self.nodes = sorted({x for e in edges for x in e} | set(nodes))

    def adjacency(self, edges):
        out = defaultdict(set)
        for a, b in edges:
            out[a].add(b)
        return out

    def reach(self, edges, start):
        out, seen, stack = self.adjacency(edges), set(), list(self.adjacency(edges)[start])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(out[x])
        return seen

    def redundant(self):
        out = self.adjacency(self.edges)
        return {(s, t) for s in list(out) for t in out[s]
                for m in out[s] if m != t and t in self.reach(self.edges, m)}

    def reduced(self):
        gone = self.redundant()
        return [e for e in self.edges if e not in gone]

    def components(self, edges):
        reach = {n: self.reach(edges, n) for n in self.nodes}
        comp = {}
        for n in self.nodes:
            peers = [m for m in reach[n] if n in reach[m] and m != n]
            if peers:
                comp[n] = min([n, *peers])
        return comp

    def impact(self, edges):
        count = Counter()
        for n in self.nodes:
            for m in self.reach(edges, n) - {n}:
                count[m] += 1
        return {n: count[n] for n in self.nodes}

    def depth(self, edges):
        comp = self.components(edges)
        out = defaultdict(set)
        for a, b in edges:
            ca, cb = comp.get(a, a), comp.get(b, b)
            if ca != cb:
                out[ca].add(cb)

        def longest(x):
            return max((1 + longest(y) for y in out[x]), default=0)
        return {n: longest(comp.get(n, n)) for n in self.nodes}
