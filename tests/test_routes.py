"""Paths, doubles and reports against plain versions."""

from geoweave.operators import dedup, graph, routes

SMALL = "/root/testdata/sf0.001"


def test_paths_follow_the_tree(spark):
    from geoweave.plans.queries import _edges
    from geoweave.plans.route_queries import _tree, route_paths
    from geoweave.sources.driver_tables import city

    via = {r.v: r.via for r in _tree(spark, SMALL).collect()}
    want = set()
    for goal in (r.v for r in city(spark, SMALL).collect() if r.v % 5 == 0 and r.v in via):
        v, step = goal, 0
        while v >= 0:
            want.add((goal, step, v))
            v, step = via[v], step + 1
    assert {(r.goal, r.step, r.v) for r in route_paths(spark, SMALL).collect()} == want
    edges = {(r.a, r.b) for r in _edges(spark, SMALL).collect()}
    assert all((b, a) in edges for a, b in via.items() if b >= 0)


def test_paths_of_a_chain_and_of_goals_outside(spark):
    tree = spark.createDataFrame([(i, i - 1) for i in range(13)], "v long, via long")
    goals = spark.createDataFrame([(12,), (0,), (99,), (12,)], "goal long")
    got = sorted((r.goal, r.step, r.v) for r in routes.paths(tree, goals).collect())
    assert got == [(0, 0, 0)] + [(12, k, 12 - k) for k in range(13)]
    assert routes.paths(tree.limit(0), goals).count() == 0


def plain_ring(x, y, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            inside = not inside
    return inside


def plain_doubles(rings, tolerance=1.0):
    """Congruent pairs, and suspicious pairs with the smaller one, over all pairs."""
    def turned(ring):
        i = ring.index(min(ring))
        return ring[i:] + ring[:i]

    def centres(ring):
        closed = ring + ring[:1]
        return [tuple(sum(p[c] for p in closed[i : i + 3]) / 3 for c in (0, 1)) for i in range(len(closed) - 2)]

    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2
    same, odd = set(), set()
    for a, r in rings.items():
        for b, s in rings.items():
            if a < b:
                if len(r) == len(s) and all(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= tolerance for p, q in zip(turned(r), turned(s))):
                    same.add((a, b))
                elif all(plain_ring(*c, r) == plain_ring(*c, s) for c in centres(r) + centres(s)):
                    boxes = [(min(p[0] for p in x), max(p[0] for p in x), min(p[1] for p in x), max(p[1] for p in x)) for x in (r, s)]
                    if boxes[0][0] <= boxes[1][1] and boxes[1][0] <= boxes[0][1] and boxes[0][2] <= boxes[1][3] and boxes[1][2] <= boxes[0][3]:
                        odd.add((a, b, a if area(r) < area(s) else b))
    return same, odd


def test_suspicious_pairs_and_report(spark):
    from geoweave.plans import route_queries as q

    rings = {r.id: [(p.x, p.y) for p in r.ring] for r in q._doubles(spark, SMALL).collect()}
    same, odd = plain_doubles(rings)
    assert same and odd
    assert {(r.a, r.b, r.smaller) for r in q.suspicious_pairs(spark, SMALL).collect()} == odd
    label = {i: i for i in rings}
    for _ in range(3):
        for a, b in same:
            label[a] = label[b] = min(label[a], label[b])
    left = {i: r for i, r in rings.items() if label[i] == i}
    smaller = {x for _, _, x in plain_doubles(left)[1]}
    n = lambda ids: sum(len(rings[i]) for i in ids)
    got = q.dedup_report(spark, SMALL).first().asDict()
    assert got == {"removed": len(rings) - len(left), "suspicious": len(smaller), "remaining": len(left) - len(smaller), "vertices": n(rings), "outer": n(set(left) - smaller)}


def test_doubles_of_nothing(spark):
    none = spark.createDataFrame([], "id long, ring array<struct<x:double,y:double>>")
    assert dedup.suspicious_pairs(none).count() == 0
    assert dedup.report(none).first().asDict() == {"removed": 0, "suspicious": 0, "remaining": 0, "vertices": 0, "outer": 0}
    assert graph.components(none.selectExpr("id as v"), dedup.congruent_pairs(none)).count() == 0


def test_rays_from_outside_and_to_a_wall(spark):
    rows = [(1, 0, 1, 2, 0.0, 0.0, 4.0, 0.0, 4.0, 4.0), (2, 0, 2, 3, 0.0, 0.0, 4.0, 4.0, 0.0, 4.0)]
    t = spark.createDataFrame(rows, "tid long, v1 long, v2 long, v3 long, ax double, ay double, bx double, by double, cx double, cy double")
    from geoweave.operators.mesh import triangle_neighbours

    rays = spark.createDataFrame([(1, 3.0, 1.0, 3.0, 9.0), (2, 3.0, 1.0, 1.0, 3.0), (3, 9.0, 9.0, 1.0, 1.0)], "r long, ax double, ay double, bx double, by double")
    walls, corridors = routes.ray_walks(rays, t, triangle_neighbours(t))
    assert sorted((r.r, r.t, r.tid, r.e) for r in walls.collect()) == [(1, 0.375, 2, 1), (2, None, None, None)]
    assert sorted((r.r, r.tid, r.t) for r in corridors.collect()) == [(1, 1, 0.0), (1, 2, 0.25), (2, 1, 0.0), (2, 2, 0.5)]


def test_triangle_groups_against_a_plain_flood(spark):
    from geoweave.plans import route_queries as q

    rows = {r.tid: r for r in q.triangles(spark, SMALL).collect()}
    corners = {t: [(r.v1, (r.ax, r.ay)), (r.v2, (r.bx, r.by)), (r.v3, (r.cx, r.cy))] for t, r in rows.items()}
    by_edge: dict = {}
    for t, c in corners.items():
        for i in range(3):
            by_edge.setdefault(frozenset((c[i][0], c[(i + 1) % 3][0])), []).append((t, i))

    def cross(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    onward: dict = {t: [] for t in rows}
    for both in by_edge.values():
        if len(both) == 2:
            for (t, i), (u, j) in (both, both[::-1]):
                own, other = corners[t][(i + 2) % 3][1], corners[u][(j + 2) % 3][1]
                if cross(own, corners[t][i][1], other) >= 0 and cross(own, other, corners[t][(i + 1) % 3][1]) >= 0:
                    onward[t].append(u)
    label: dict = {}
    for t in sorted(rows):
        queue = [t] if t not in label else []
        label.setdefault(t, t)
        for a in queue:
            for b in onward[a]:
                if b not in label:
                    label[b] = t
                    queue.append(b)
    assert {r.v: r.label for r in q.triangle_groups(spark, SMALL).collect()} == label


def test_floods_take_steps_one_way_only(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "v long")
    edges = spark.createDataFrame([(2, 1), (2, 3), (4, 3), (5, 5), (7, 6), (6, 4), (9, 1), (3, 99)], "a long, b long")
    assert {r.v: r.label for r in graph.reached_by(nodes, edges).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7}


def test_flat_corners_against_a_plain_scan(spark):
    from geoweave.plans import route_queries as q

    def area(a, b, c):
        return abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n >= 1e-12 else 0
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5, n**0.5

    want = {}
    for r in q._bumpy(spark, SMALL).collect():
        ring = [(p.x, p.y) for p in r.ring]
        i = 0
        while i < len(ring) and len(ring) > 3:
            a, b, c = (ring[(i + k) % len(ring)] for k in range(3))
            m, n = off(b, a, c)
            share = 3 - 2 * (m - 0.1) / (0.05 * n - 0.1) if 0.05 * n != 0.1 else 3
            if area(a, b, c) < 40 * share:
                del ring[(i + 1) % len(ring)]
                i = 0
            else:
                i += 1
        want[r.id] = (len(ring), ring[0][0])
    got = {r.id: (r.n, r.first_x) for r in q.flat_corners(spark, SMALL).collect()}
    assert got == want and {n for n, _ in want.values()} != {12}


def test_thinning_keeps_what_is_far(spark):
    from geoweave.operators.polygons import simplified

    ring = [(0.0, 0.0), (5.0, 0.2), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = spark.createDataFrame([(1, ring), (2, ring[:2]), (3, None), (4, [])], "id int, ring array<struct<x double, y double>>")
    got = {r.id: None if r.ring is None else [(p.x, p.y) for p in r.ring] for r in simplified(rows, 0.5).collect()}
    assert got == {1: [ring[0], *ring[2:], ring[0]], 2: [], 3: None, 4: []}


def test_latest_commands_in_a_stream(spark, tmp_path):
    from geoweave.streaming.metrics import latest_commands

    shape = "target long, seq long, action string, value double"
    spark.createDataFrame([(1, 2, "stop", 1.0), (1, 1, "resume", 2.0), (2, 5, "unknown", 3.0)], shape).coalesce(1).write.json(f"{tmp_path}/in")
    commands = spark.readStream.schema(shape).json(f"{tmp_path}/in")
    q = latest_commands(commands).writeStream.outputMode("update").format("memory").queryName("commands").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.target: (r.seq, r.action, r.handled) for r in spark.table("commands").collect()}
    assert got[1] == (2, "stop", 2) and got[2][2] == 0
