import random

from sediment.operators.graphs import cyclic_nodes, support_paths, supported_evidence


def on_cycle(edges):
    onward = {}
    for a, b in edges:
        if a != b:
            onward.setdefault(a, set()).add(b)

    def reaches(a):
        seen, left = set(), list(onward.get(a, ()))
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += onward.get(x, ())
        return seen

    far = {a: reaches(a) for a in onward}
    return {a: min(b for b in far[a] if a in far.get(b, ())) for a in onward if a in far[a]}


def graphs():
    rng = random.Random(4)
    for n, m in ((6, 9), (30, 30), (30, 60), (40, 35)):
        yield [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    chain = [(f"v{k}", f"v{k + 1}") for k in range(300)]
    hub = [(f"s{k}", "hub") for k in range(50)] + [("hub", f"t{k}") for k in range(50)]
    yield [*chain, *hub, ("t3", "s4"), ("p", "q"), ("q", "p"), ("x", "x")]


def test_cycles_equal_reachability(spark):
    every = [(f"{g}{a}", f"{g}{b}") for g, edges in enumerate(graphs()) for a, b in edges]
    links = spark.createDataFrame(every, "src string, dst string")
    assert {r["node"]: r["cycle"] for r in cyclic_nodes(links).collect()} == on_cycle(every)
    assert cyclic_nodes(links.limit(0)).collect() == []


def test_large_components_are_searched_by_colours(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a"), ("f", "h")]
    links = spark.createDataFrame(edges, "src string, dst string")
    assert {r["node"]: r["cycle"] for r in cyclic_nodes(links, in_one_task=2).collect()} == on_cycle(edges) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_support_stops_on_cycles_and_at_four_steps(spark):
    rng = random.Random(6)
    nodes = {f"n{k:02}": [f"n{rng.randrange(40):02}" for _ in range(rng.randrange(3))] for k in range(40)}
    nodes["n03"] = ["n03", "n04"]  # names itself
    nodes["n05"] = ["gone", "n06"]
    rows = [(k, v, [f"e{k}", "common"]) for k, v in nodes.items()]
    got = {r["id"]: (r["supports"], r["evidence"]) for r in supported_evidence(spark.createDataFrame(rows, "id string, derived_from array<string>, held array<string>"), "held").collect()}
    loops = {k for k, v in nodes.items() if k in v}
    for k in nodes:
        steps = {k: 0}
        front = [] if k in loops else [k]
        for d in range(1, 5):
            front = sorted({x for y in front for x in nodes[y] if x in nodes and x not in steps and x not in loops})
            steps |= dict.fromkeys(front, d)
        order = sorted((d, x) for x, d in steps.items() if d)
        want = [] if k in loops else list(dict.fromkeys(e for _, x in [(0, k), *order] for e in (f"e{x}", "common")))
        assert got[k] == ([x for _, x in order], want)


def test_paths_are_shortest_and_first_by_id(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g")]
    got = {(r["src"], r["dst"]): (r["steps"], r["path"]) for r in support_paths(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got["a", "d"] == (2, ["a", "b", "d"]) and got["a", "f"] == (4, ["a", "b", "d", "e", "f"])
    assert ("a", "g") not in got and ("a", "a") not in got
