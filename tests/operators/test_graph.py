from dendra.operators import graph

VECTORS = {"r": [1.0, 0.0], "a": [1.0, 0.2], "b": [1.0, 0.2], "h": [0.9, 0.1], "c": [0.8, 0.6], "d": [-1.0, 0.1], "z": [0.0, 1.0]}
LINKS = [("r", "a"), ("r", "b"), ("r", "h"), ("r", "d"), ("a", "c"), ("b", "c"), ("h", "c"), ("h", "z"), ("a", "h")]


def world(spark, cap):
    edges = graph.symmetric(spark.createDataFrame(LINKS, "src string, dst string"))
    vertices = spark.createDataFrame(list(VECTORS.items()), "title string, embedding array<double>")
    vertices = vertices.join(graph.degrees(vertices, edges), "title")
    seeds = spark.createDataFrame([("q", "r", [1.0, 0.1]), ("q", "nowhere", [1.0, 0.0]), ("p", "z", [0.0, 1.0])], "qid string, root string, query array<double>")
    return seeds, edges, vertices


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5


def plain(seeds, edges, degree, hops, k, threshold, cap):
    """The expansion, one pair at a time."""
    out = []
    for qid, root, query in seeds:
        if root not in VECTORS or degree[root] > cap:
            continue
        frontier, visited = [(root, 1.0)], {root}
        for hop in range(1, hops + 1):
            best = {}
            for source, score in frontier:
                for s, t in edges:
                    if s == source and t not in visited:
                        local = score * cos(VECTORS[source], VECTORS[t])
                        if t not in best or local > best[t][0]:
                            best[t] = (local, source)
            ranked = sorted(((-(0.4 * b[0] + 0.6 * cos(query, VECTORS[t])), t, b) for t, b in best.items()))
            kept = [(i + 1, t, b, -s) for i, (s, t, b) in enumerate(ranked[:k]) if -s >= threshold]
            out += [(qid, root, hop, i, t, b[1], round(s, 9)) for i, t, b, s in kept]
            frontier = [(t, b[0]) for _, t, b, _ in kept if degree[t] <= cap]
            visited |= {t for t, _ in frontier}
    return sorted(out)


def test_expansion_matches_the_definition(spark):
    for cap, k in ((10, 3), (3, 5)):
        seeds, edges, vertices = world(spark, cap)
        hops, counts = graph.propagate(seeds, edges, vertices, hops=3, top_k=k, degree_cap=cap)
        degree = {r.title: r.degree for r in vertices.collect()}
        want = plain([tuple(r) for r in seeds.collect()], [tuple(r) for r in edges.collect()], degree, 3, k, 0.1, cap)
        got = sorted((r.qid, r.root, r.hop, r["rank"], r.title, r.source_title, round(r.total_score, 9)) for r in hops.collect())
        assert got == want and want
        assert all(r.candidates > 0 for r in counts.collect())


def test_a_hub_is_reported_again_but_never_expanded(spark):
    hops, _ = graph.propagate(*world(spark, 3), hops=3, degree_cap=3)
    rows = [r for r in hops.collect() if r.root == "z"]
    assert rows == [] or all(r.source_title != "h" for r in rows)
    seeds, edges, vertices = world(spark, 3)
    rows = graph.propagate(seeds.where("root = 'z'"), edges, vertices, hops=2, degree_cap=3)[0].collect()
    assert [r.title for r in rows] == ["h"]


def test_paths_read_breadth_first(spark):
    hops = [("q", "r", 1, 1, "a", "r"), ("q", "r", 1, 2, "b", "r"), ("q", "r", 2, 1, "x", "b"), ("q", "r", 2, 2, "y", "a"), ("q", "r", 2, 3, "w", "a"), ("q", "r", 3, 1, "v", "y")]
    rows = spark.createDataFrame(hops, "qid string, root string, hop int, rank int, title string, source_title string")
    roots = spark.createDataFrame([("q", "r"), ("q", "lone")], "qid string, root string")
    got = {}
    for r in graph.paths(rows, roots).orderBy("place").collect():
        got.setdefault((r.root, r.path), []).append(r.title)
    assert got == {("r", 0): ["r"], ("r", 1): ["r", "a", "y", "w", "v"], ("r", 2): ["r", "b", "x"], ("lone", 0): ["lone"], ("lone", 1): ["lone"]}


def test_edges_and_degrees(spark):
    edges = graph.symmetric(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "src string, dst string"))
    assert sorted(map(tuple, edges.collect())) == [("a", "a"), ("a", "b"), ("b", "a")]
    vertices = graph.with_endpoints(spark.createDataFrame([("c", 1)], "title string, x int"), edges)
    assert sorted(map(tuple, graph.degrees(vertices, edges).collect())) == [("a", 2), ("b", 1), ("c", 0)]
    batches = spark.createDataFrame([("t", "old", 1), ("t", "new", 2)], "title string, intro string, seq int")
    assert [tuple(r) for r in graph.upsert_vertices(batches).collect()] == [("t", "new")]
