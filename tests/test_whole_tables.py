"""Queries over whole tables against plain versions; no row of lineitem or customer may be left out."""

from collections import Counter, defaultdict, deque

import pytest

from quarrylens.functions import rules
from quarrylens.plans import registry, views


@pytest.fixture(scope="module")
def tables(spark, sf_small):
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{sf_small}/{name}.parquet").collect()]
    return {n: read(n) for n in ("lineitem", "part", "customer")}


@pytest.fixture(scope="module")
def plain_edges(tables):
    orders = defaultdict(list)
    for r in tables["lineitem"]:
        orders[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"], r["l_discount"]))
    best = {}
    for rows in orders.values():
        rows.sort()
        for a, b in zip(rows, rows[1:]):
            if a[1] != b[1]:
                e = (str(a[1]), str(b[1]))
                best[e] = max(best.get(e, 0), 1 - float(a[4]))
    return best


def run(spark, sf_small, name):
    return registry.queries()[name](spark, sf_small).collect()


def walk(edges, seeds, most, forward=True):
    near = defaultdict(list)
    for a, b in edges:
        near[a if forward else b].append(b if forward else a)
    depth, todo = dict.fromkeys(seeds, 0), deque(seeds)
    while todo:
        v = todo.popleft()
        for w in near[v] if depth[v] < most else ():
            if w not in depth:
                depth[w] = depth[v] + 1
                todo.append(w)
    return depth


def first(tables):
    least = min(p["p_name"] for p in tables["part"])
    return [str(p["p_partkey"]) for p in tables["part"] if p["p_name"] == least]


def test_references_are_all_resolved(spark, sf_small, tables):
    keys = {p["p_partkey"] for p in tables["part"]}
    n = sum(r["l_partkey"] in keys and r["l_suppkey"] in keys for r in tables["lineitem"])
    assert n == views.references(spark, sf_small).count() and 0 < n
    assert sum(r.n for r in run(spark, sf_small, "resolution_distribution")) == sum(r.n for r in run(spark, sf_small, "symbol_resolve_tiers")) == n


@pytest.fixture(scope="module")
def trade(spark, sf_small, tables):
    """Plain nodes (id -> type, name, file) and edges of customers, orders, parts and nations."""
    more = {n: [r.asDict() for r in spark.read.parquet(f"{sf_small}/{n}.parquet").collect()] for n in ("orders", "nation", "supplier")}
    nodes = {f"c{r['c_custkey']}": ("symbol", r["c_name"], r["c_mktsegment"]) for r in tables["customer"]}
    nodes |= {f"o{r['o_orderkey']}": ("symbol", f"order{r['o_orderkey']}", r["o_orderpriority"]) for r in more["orders"]}
    nodes |= {f"p{r['p_partkey']}": ("symbol", r["p_name"], r["p_brand"]) for r in tables["part"]}
    nodes |= {f"n{r['n_nationkey']}": ("external", r["n_name"], None) for r in more["nation"]}
    home = {r["s_suppkey"]: r["s_nationkey"] for r in more["supplier"]}
    edges = {(f"c{r['o_custkey']}", f"o{r['o_orderkey']}") for r in more["orders"]}
    edges |= {(f"o{r['l_orderkey']}", f"p{r['l_partkey']}") for r in tables["lineitem"]}
    edges |= {(f"p{r['l_partkey']}", f"n{home[r['l_suppkey']]}") for r in tables["lineitem"] if r["l_suppkey"] in home}
    return nodes, edges


def test_degrees_and_entry_points(spark, sf_small, tables, plain_edges, trade):
    o, i = Counter(a for a, _ in plain_edges), Counter(b for _, b in plain_edges)
    got = run(spark, sf_small, "degree_centrality")
    assert {r.id: (r.in_degree, r.out_degree) for r in got} == {str(p["p_partkey"]): (i[str(p["p_partkey"])], o[str(p["p_partkey"])]) for p in tables["part"]}
    nodes, edges = trade
    o, i, want = Counter(a for a, _ in edges), Counter(b for _, b in edges), set()
    for k, (kind, name, _) in nodes.items():
        wide = o[k] >= 2 and o[k] / max(i[k], 1) >= 3
        if wide or (kind == "symbol" and any(w in name.lower() for w in rules.ENTRY_WORDS)):
            want.add((k, "high_fan_out_low_fan_in" if wide else "name_pattern", o[k], i[k]))
    assert want and set(map(tuple, run(spark, sf_small, "entry_points"))) == want


def test_walks(spark, sf_small, tables, plain_edges):
    seeds = first(tables)
    for name, forward in (("callees_depth3", True), ("callers_depth3", False)):
        assert {r.id: r.depth for r in run(spark, sf_small, name)} == {k: d for k, d in walk(plain_edges, seeds, 3, forward).items() if d}
    seen, level, want = set(seeds), dict.fromkeys(seeds, 1.0), {}
    for depth in (1, 2, 3):
        after = {}
        for (a, b), c in plain_edges.items():
            if b in level and a not in seen and level[b] * c >= rules.IMPACT_FLOOR:
                after[a] = max(after.get(a, 0), level[b] * c)
        want |= {k: (depth, round(c, 6)) for k, c in after.items()}
        seen, level = seen | set(after), after
    got = {r.id: (r.depth, r.confidence) for r in run(spark, sf_small, "impact_analysis")}
    assert {k: d for k, (d, _) in got.items()} == {k: d for k, (d, _) in want.items()}
    assert all(abs(c - want[k][1]) < 2e-6 for k, (_, c) in got.items())


def test_components(spark, sf_small, tables, plain_edges):
    ids = [str(p["p_partkey"]) for p in tables["part"]]
    forward = {k: set(walk(plain_edges, [k], 1 << 30)) for k in ids}
    strong = {k: min(w for w in forward[k] if k in forward[w]) for k in ids if any(k in forward[w] for w in forward[k] - {k})}
    assert {r.id: r.component for r in run(spark, sf_small, "scc_cycles")} == strong
    both = {**plain_edges, **{(b, a): 1 for a, b in plain_edges}}
    assert {r.id: r.component for r in run(spark, sf_small, "wcc")} == {k: min(walk(both, [k], 1 << 30)) for k in ids}


def test_flows_follow_all_edges(spark, sf_small, trade):
    nodes, edges = trade
    got = {r.entry: (r.names, r.files, r.depth, r.reaches_external) for r in run(spark, sf_small, "process_flows")}
    want = {}
    for r in run(spark, sf_small, "entry_points"):
        steps = walk(edges, [r.id], rules.FLOW_DEPTH)
        if len(steps) > 1:
            names = ">".join(n for _, n, _ in sorted((d, nodes[k][1], k) for k, d in steps.items()))
            want[r.id] = (names, ",".join(sorted({nodes[k][2] for k in steps} - {None})), max(steps.values()), any(nodes[k][0] == "external" for k in steps))
    assert want and got == want


def test_hierarchy_holds_all_customers(spark, sf_small, tables):
    got = {(r.direction, r.name, r.depth) for r in run(spark, sf_small, "type_hierarchy")}
    assert got == {("down", c["c_name"], 1) for c in tables["customer"]} | {("up", "top", 1)}
