import itertools
import math
import os

import pytest
from pyspark.sql import functions as F

from voxelspark.functions import scalars as S
from voxelspark.operators import order, rays, view
from voxelspark.operators import volume as V
from voxelspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def test_every_event_has_a_frame_and_every_supplier_a_cell(spark):
    ids = {r.event_id for r in V.read(spark, SF, "events").select("event_id").collect()}
    bricks = registry.seg_palettes(spark, SF).count()
    q = registry.queries()
    assert {r.frame: r.n for r in q["lod_histogram"](spark, SF).groupBy("frame").agg(F.sum("bricks").alias("n")).collect()} == {i: bricks for i in ids}
    known = {r.s_suppkey + 1 for r in V.read(spark, SF, "supplier").collect()}
    assert {r.label for r in V.segmentation(spark, SF).select("label").distinct().collect()} == known | {0}


def test_volumes_grow_with_the_seeds(spark, tmp_path):
    rows = [(k,) for k in range(600)]
    spark.createDataFrame(rows, "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert V.side(spark, str(tmp_path)) == 64
    got = V.segmentation(spark, str(tmp_path))
    assert got.count() == 64**3 and got.filter("label > 512").count() > 0
    place = lambda k: ((7 * k + 3) % 64, (11 * k + 5 + k // 64) % 64, (13 * k + 1 + k // 64) % 64)
    seeds = [(place(k), k) for (k,) in rows]
    for r in got.filter("x % 13 = 0 and y % 17 = 0 and z % 19 = 0").collect():
        d, k = min((sum((a - b) ** 2 for a, b in zip(p, (r.x, r.y, r.z))), k) for p, k in seeds)
        assert r.label == (k + 1 if d <= 100 else 0)


def test_codes_of_21_bits(spark):
    rows = [(0, 0, 0), (1023, 1024, 1025), (2**21 - 1, 2**20, 5), (2**21 - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("m", S.morton(F.col("x"), F.col("y"), F.col("z")))
    plain = lambda p: sum((c >> b & 1) << 3 * b + i for i, c in enumerate(p) for b in range(21))
    for r in df.select("x", "y", "z", "m", *(c.alias(n) for c, n in zip(S.demorton(F.col("m")), "abc"))).collect():
        assert r.m == plain((r.x, r.y, r.z)) and (r.a, r.b, r.c) == (r.x, r.y, r.z)


def test_orders_without_one_task(spark):
    rows = [(k * k % 997 * 3, float(k % 31)) for k in range(900)]
    rows = list({k: (k, v) for k, v in rows}.values())
    df = spark.createDataFrame(rows, "frame long, ms double").repartition(5)
    want, at = {}, sorted(rows)
    for i, (k, _) in enumerate(at):
        last = at[max(0, i - 59) : i + 1]
        want[k] = (len(last), sum(v for _, v in last))
    assert {r.frame: (r.samples, r.sum_ms) for r in order.last_rows(df, "frame", 60, fan=128, sum_ms="ms").collect()} == want
    df = df.withColumn("one", F.lit(1))
    total, sums = 0.0, {}
    for k, v in at:
        sums[k], total = total, total + v
    assert {r.frame: r.s for r in order.sums_before(df, "one", "frame", "ms", "s", fan=64).collect()} == sums


def walk(alphas, at, normal, light, through, side=32):
    """The shadow of one point, step by step until the ray leaves the volume."""
    if through < 0.1 or 1 - through < 0.2:
        return 1.0
    n, total = math.sqrt(sum(c * c for c in light)), 0.0
    for k in range(max(24, int(64 * through))):
        place = [p + 0.5 + 0.6 * m + (0.5 + k) * c / n for p, m, c in zip(at, normal, light, strict=True)]
        if not all(0 <= c < side for c in place):
            break
        total += alphas.get(tuple(math.floor(c) for c in place), 0.0)
        if total > 0.8:
            return 0.0
    return 1 + (math.exp(-1.5 * total) - 1) * through


@pytest.mark.parametrize("through", [1.0, 0.7, 0.6, 0.3, 0.05])
def test_shadow_rays(spark, through):
    light = (0.8, 0.4, -0.2)
    occluders = {(x, y, z): 0.1 + (x * 7 + y * 3 + z) % 5 / 20 for x in range(32) for y in range(32) for z in range(32) if (x * x + 3 * y + 5 * z) % 53 == 0} | {(28, 0, 0): 0.3}
    places = [((x, x % 7, 9 + x % 11), n) for x in range(0, 31, 3) for n in ((0.0, 0.0, 0.0), (0.6, 0.0, -0.8))]
    points = spark.createDataFrame([(i, *p, *n, through) for i, (p, n) in enumerate(places)], "id long, x long, y long, z long, nx double, ny double, nz double, through double")
    voxels = spark.createDataFrame([(*c, a) for c, a in occluders.items()], "x long, y long, z long, alpha double")
    got = {r.id: r.shadow for r in rays.shadows(points, voxels, light, 32).collect()}
    assert got == pytest.approx({i: walk(occluders, p, n, light, through) for i, (p, n) in enumerate(places)})


def test_shading_by_hand(spark):
    light = (0.0, 3.0, 4.0)  # of length 5: its direction is (0, 0.6, 0.8)
    rows = [(0.0, -0.5, 0.0, 0.5 + 0.6 * 0.8), (0.0, 0.0, -2.0, 1.0), (0.0, 0.25, 0.0, 0.5), (0.0, 0.0, 0.0, 0.5), (0.0, -0.3, -0.4, 1.0)]
    df = spark.createDataFrame(rows, "gx double, gy double, gz double, want double")
    for r in df.select("want", rays.shade([F.col(c) for c in ("gx", "gy", "gz")], light).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
    dark = df.limit(1).select(rays.shade([F.col(c) for c in ("gx", "gy", "gz")], light, ambient=0.0, shadow=0.0).alias("a"), *(c.alias(n) for c, n in zip(rays.shadowed([F.lit(1.0), F.lit(0.0), F.lit(0.0)], F.lit(0.0)), "rgb"))).first()
    assert dark.a == 0.3 and (dark.r, dark.g, dark.b) == pytest.approx((0.5 + 0.5 * (0.299 * 0.8 + 0.2), 0.5 * 0.299 * 0.8, 0.5 * 0.299 * 0.8))


def plain_image(nodes, lods, empty, tones, cam, side, brick, width, height, light):
    """The render loop pixel by pixel."""
    code = lambda p: sum((c >> b & 1) << 3 * b + i for i, c in enumerate(p) for b in range(8))
    norm = lambda v: [c / (math.sqrt(sum(x * x for x in v)) or 1.0) for c in v]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    o, f = cam[:3], norm(cam[3:])
    r = norm(cross(f, [1.0, 0.0, 0.0] if abs(f[1]) > 0.999 else [0.0, 1.0, 0.0]))
    u, t = cross(r, f), math.tan(math.pi / 6)

    def tone(brick_id, cell):
        lod = lods[brick_id]
        if empty[brick_id] or not all(0 <= c < 1 << lod for c in cell):
            return None
        return tones.get(nodes[brick_id, lod, code(cell)])

    def alpha(v):
        if not all(0 <= c < side for c in v):
            return 0.0
        b = code([c // brick for c in v])
        stride = brick >> lods[b]
        found = tone(b, [c % brick // stride for c in v])
        return found[3] if found else 0.0

    def cells(o, d, size, limit, t0, t1):
        at = [min(max(math.floor((o[i] + d[i] * (t0 + max(t0 * 1e-6, 1e-5))) / size), 0), limit - 1) for i in range(3)]
        inv = [(1 if d[i] >= 0 else -1) / max(abs(d[i]), 1e-6) for i in range(3)]
        nxt, begin = [((at[i] + (d[i] >= 0)) * size - o[i]) * inv[i] for i in range(3)], t0
        while begin < t1 and all(0 <= c < limit for c in at):
            axis = 0 if nxt[0] < nxt[1] and nxt[0] < nxt[2] else 1 if nxt[1] < nxt[2] else 2
            end = min(nxt[axis], t1)
            if end > begin:
                yield tuple(at), begin, end
            begin = max(begin, end)
            at[axis] += 1 if d[axis] >= 0 else -1
            nxt[axis] += abs(inv[axis]) * size

    out = {}
    for py in range(height):
        for px in range(width):
            nx, ny = ((px + 0.5) / width * 2 - 1) * width / height * t, (1 - (py + 0.5) / height * 2) * t
            d = norm([f[i] + r[i] * nx + u[i] * ny for i in range(3)])
            inv = [(d[i] > 0) - (d[i] < 0) for i in range(3)]
            inv = [s / max(abs(c), 1e-6) for s, c in zip(inv, d)]
            ends = [sorted((-o[i] * inv[i], (side - o[i]) * inv[i])) for i in range(3)]
            t0, t1 = max(0.0, *(e[0] for e in ends)), min(e[1] for e in ends)
            colour, a = [0.0] * 3, 0.0
            if t0 <= t1:
                for at, b0, b1 in cells(o, d, float(brick), side // brick, t0, t1):
                    b = code(at)
                    low, stride = [c * brick for c in at], brick >> lods[b]
                    for cell, _, _ in cells([x - y for x, y in zip(o, low)], d, float(stride), 1 << lods[b], b0, b1) if not empty[b] else ():
                        found = tone(b, cell)
                        if not found or found[3] <= 0.05 or a > 0.95:
                            continue
                        rgb, own = list(found[:3]), found[3]
                        if own > 0.35:
                            around = [[alpha([x + stride * (c + s * (i == j)) for j, (x, c) in enumerate(zip(low, cell))]) for s in (1, -1)] for i in range(3)]
                            g = [(p - m) / 2 for p, m in ([x if x > 0.05 else own for x in pair] for pair in around)]
                            n = max(math.sqrt(sum(c * c for c in g)), 0.001)
                            normal, shadow, to = [-c / n for c in g], 1.0, norm(light)
                            if own > 0.4:
                                shadow = walk_at(alpha, [x + stride * c for x, c in zip(low, cell)], normal, to, 1 - a, side)
                            along = max(0.0, sum(x * y for x, y in zip(normal, to)))
                            factor = min(1.0, max(0.5 + along * 0.8 * shadow, 0.3 if along > 0.01 else 0.1))
                            grey = sum(c * w for c, w in zip(rgb, (0.299, 0.587, 0.114)))
                            mixed = min(max(1 - shadow, 0.0), 1.0) * 0.5
                            rgb = [(c * (1 - mixed) + (grey * 0.8 + c * 0.2) * mixed) * factor for c in rgb]
                        source = min(max(1 - (1 - own) ** stride, 0.0), 1.0) * (1 - a)
                        colour, a = [c + x * source for c, x in zip(colour, rgb)], a + source
            out[px, py] = [min(c, 1.0) * 255 for c in (*colour, a)]
    return out


def walk_at(alpha, at, normal, to, through, side):
    if through < 0.1 or 1 - through < 0.2:
        return 1.0
    total = 0.0
    for k in range(max(24, int(64 * through))):
        place = [p + 0.5 + 0.6 * m + (0.5 + k) * c for p, m, c in zip(at, normal, to)]
        if not all(0 <= c < side for c in place):
            break
        total += alpha([math.floor(c) for c in place])
        if total > 0.8:
            return 0.0
    return 1 + (math.exp(-1.5 * total) - 1) * through


def test_images_equal_the_plain_loop(spark):
    camera = registry.one_camera(spark, SF)
    bricks = registry.seg_palettes(spark, SF).cache()
    nodes = registry.seg_nodes(spark, SF).cache()
    lods = {r.brick_id: (r.brick_id * 5 + 1) % 4 for r in bricks.collect()}
    levels = bricks.select("brick_id", ((F.col("brick_id") * 5 + 1) % 4).cast("int").alias("lod"), "is_empty")
    colors = registry.colors(spark, SF).withColumn("rgba", F.col("rgba") % 16777216 + F.when(F.col("label") % 3 == 0, 160).when(F.col("label") % 3 == 1, 110).otherwise(40) * F.lit(16777216).cast("long")).cache()
    c = camera.first()
    tones = {r.label: [(r.rgba >> 8 * i & 255) / 255 for i in range(4)] for r in colors.collect()}
    want = plain_image({(r.brick_id, r.lod, r.m): r.label for r in nodes.collect()}, lods, {r.brick_id: r.is_empty for r in bricks.collect()}, tones, [c.px, c.py, c.pz, c.dx, c.dy, c.dz], 32, 8, 12, 9, S.light_direction(25))
    got = {(r.px, r.py): [r.rgba >> 8 * i & 255 for i in range(4)] for r in rays.render(spark, nodes, levels, colors, camera.drop("session"), 32, 8, 12, 9).collect()}
    assert got.keys() == want.keys() and sum(v[3] > 20 for v in got.values()) > 15
    for k, v in want.items():
        assert all(abs(a - math.floor(b)) <= 1 for a, b in zip(got[k], v)), (k, got[k], v)


@pytest.mark.parametrize("mixed", [False, True])
def test_gradients_look_across_faces(spark, mixed):
    """At one level, the central differences of the whole volume; at mixed ones, a plain look-up of every neighbour."""
    code = lambda p: sum((c >> b & 1) << 3 * b + i for i, c in enumerate(p) for b in range(8))
    lods = {(x, y, z): (x + 2 * y + z) % 4 if mixed else 2 for x in range(2) for y in range(2) for z in range(2)}
    alphas = {(b, c): (code(b) * 7 + code(c) * code(c) * 3 + sum(c)) % 21 / 20 for b, k in lods.items() for c in [(x, y, z) for x in range(1 << k) for y in range(1 << k) for z in range(1 << k)] if (code(b) + code(c)) % 11}

    def at(v):
        if not all(0 <= c < 16 for c in v):
            return 0.0
        b = tuple(c // 8 for c in v)
        return alphas.get((b, tuple(c % 8 // (8 >> lods[b]) for c in v)), 0.0)

    want = {}
    for (b, c), own in alphas.items():
        stride = 8 >> lods[b]
        sides = [[at([8 * x + stride * (y + s * (i == j)) for j, (x, y) in enumerate(zip(b, c))]) for s in (1, -1)] for i in range(3)]
        want[code(b), code(c)] = tuple((p - m) / 2 for p, m in ([a if a > 0.05 else own for a in pair] for pair in sides))
    nodes = spark.createDataFrame([(code(b), lods[b], code(c), a) for (b, c), a in alphas.items()], "brick_id long, lod int, m long, alpha double")
    levels = spark.createDataFrame([(code(b), k) for b, k in lods.items()], "brick_id long, lod int")
    got = {(r.brick_id, r.m): (r.gx, r.gy, r.gz) for r in rays.lod_gradients(nodes, levels, 8, 16).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    some = nodes.filter("m % 3 = 0")
    few = {(r.brick_id, r.m): (r.gx, r.gy, r.gz) for r in rays.lod_gradients(nodes, levels, 8, 16, only=some).collect()}
    assert few == {k: v for k, v in got.items() if k[1] % 3 == 0}


def test_rays_stop_where_they_are_opaque(spark):
    """A ray through 16 bricks of one cell each: samples by slab fall with opacity, and are those of one pass over all."""
    path = spark.createDataFrame([(p, 0, k, k, 0, 8.0, 1, 8 * k, 0, 0, 4.0, 4.0, -4.0, 0.001, 0.001, 1.0, 0.0, 0.0) for p in range(2) for k in range(1)], "px long, py long, bseq long, brick_id long, lod int, stride double, cells long, bx long, by long, bz long, ox double, oy double, oz double, rx double, ry double, rz double, t_in double, t_out double").limit(0)
    assert rays.until_opaque(path, spark.createDataFrame([], "brick_id long, lod int, m long, r double, g double, b double, own double"))[0] is None
    rows = [(p, 0, k, 2 * k + p, 0, 8.0, 1, 8 * k, 0, 0, -1.0, 4.0, 4.0, 1.0, 1e-7, 1e-7, 8.0 * k + 1, 8.0 * k + 9) for p in range(2) for k in range(16)]
    path = spark.createDataFrame(rows, path.schema)
    cells = spark.createDataFrame([(2 * k + p, 0, 0, 0.1, 0.2, 0.3, (0.5, 0.08)[p]) for p in range(2) for k in range(16)], "brick_id long, lod int, m long, r double, g double, b double, own double")
    seen, counts = rays.until_opaque(path, cells)
    got = {(r.px, r.bseq): r.through for r in seen.collect()}
    alpha = {p: 1 - (1 - (0.5, 0.08)[p]) ** 8 for p in range(2)}
    want = {(p, k): (1 - alpha[p]) ** k for p in range(2) for k in range(16) if 1 - (1 - alpha[p]) ** k <= 0.95}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert counts == [3, 3, 0, 0] or sum(counts) == len(want) and counts[-1] == 0


def test_residents_are_decoded_anew(spark):
    resident = spark.createDataFrame([(f, b, 2) for f in range(4) for b in (5, 3)], "frame long, brick_id long, lod int")
    got = [(r.frame, r.brick_id) for r in view.redecode(resident, spark.createDataFrame([(2,), (9,)], "frame long")).collect()]
    assert got == [(2, 3), (2, 5)]


def test_bricks_meet_cameras_beyond_the_broadcast(spark, monkeypatch):
    few = sorted(map(tuple, registry.brick_lod(spark, SF).filter("frame < 20").collect()))
    monkeypatch.setattr(view, "SMALL", 1)
    assert sorted(map(tuple, registry.brick_lod(spark, SF).filter("frame < 20").collect())) == few


def test_recolouring_touches_only_what_holds_the_label(spark):
    bricks = registry.seg_bricks(spark, SF).cache()
    decoded = V.colored(bricks, V.transfer_function(bricks)).cache()
    changes = spark.createDataFrame([(5, 77), (9, None), (10_000, 1)], "label long, rgba long")
    told = V.recolored(decoded, V.label_index(bricks), changes).cache()
    holds = {r.brick_id for r in bricks.filter("label in (5, 9)").select("brick_id").distinct().collect()}
    assert {r.brick_id for r in told.select("brick_id").distinct().collect()} == holds and 0 < len(holds) < 64
    whole = {(r.brick_id, r.m): r.rgba for r in V.with_changes(decoded, V.label_index(bricks), changes).collect()}
    new = {5: 77, 9: None}
    assert whole == {(r.brick_id, r.m): new.get(r.label, r.rgba) for r in decoded.collect()}


def test_sketches_of_labels_up_the_tree(spark):
    """Estimates of every node against exact counts: as they are for few labels, within four standard errors for many, and alike however the bricks were dealt."""
    bricks = spark.range(512 * 400).select((F.col("id") % 512).alias("brick_id"), F.when(F.col("id") % 512 < 8, F.col("id") % 3).otherwise(F.col("id")).alias("label"))
    got = {(r.level, r.code): r.n_labels for r in V.distinct_by_level(V.label_sketches(bricks), 3).collect()}
    exact = {}
    for k in range(4):
        for r in bricks.groupBy(F.expr(f"shiftright(brick_id, {3 * k})").alias("code")).agg(F.countDistinct("label").alias("n")).collect():
            exact[k, r.code] = r.n
    assert got.keys() == exact.keys() and len(got) == 512 + 64 + 8 + 1
    assert all(abs(got[k] - n) <= (0 if n <= 400 else 4 * 1.04 / 256 * n) for k, n in exact.items())
    coarse = V.distinct_by_level(V.label_sketches(bricks.repartition(13), 12), 3).filter("level = 3").first().n_labels
    assert abs(coarse - exact[3, 0]) <= 4 * 1.04 / 64 * exact[3, 0]
    assert V.distinct_by_level(V.label_sketches(bricks.limit(0)), 3).count() == 0


def test_voxels_of_cells_are_not_broadcast(spark, tmp_path):
    """Only the seeds are dealt, once; voxels, whose size the planner takes to be that of the seeds, go to no driver."""
    keys = [*range(90), None]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    voxels = V.segmentation(spark, str(tmp_path))
    plan = voxels._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    got, g = {(r.x, r.y, r.z): r.label for r in voxels.collect()}, 32
    seeds = [(k, (7 * k + 3) % g, (11 * k + 5 + k // g) % g, (13 * k + 1 + k // g) % g) for k in keys if k is not None]
    assert len(got) == g**3
    for x, y, z in itertools.product(range(0, g, 3), range(0, g, 5), range(0, g, 2)):
        far, k = min(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, k) for k, a, b, c in seeds)
        assert got[x, y, z] == (k + 1 if far <= V.REACH**2 else 0)


def test_blends_of_points_take_one_row_each(spark):
    """Full, sparse and absent bricks, a missing value, places past the far faces: as a loop over the eight corners, without rows of corners."""
    code = lambda p: sum((c >> b & 1) << 3 * b + i for i, c in enumerate(p) for b in range(3))
    cells = {(b, lod, code((x, y, z))): (float((x + 3 * y + 5 * z + b) % 7), None if (x, y, z) == (1, 0, 0) else float(x)) for b, lod in ((0, 1), (0, 2), (5, 2)) for x in range(1 << lod) for y in range(1 << lod) for z in range(1 << lod) if b != 5 or (x + y * z) % 3}
    nodes = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "brick_id long, lod int, m long, r double, a double")
    places = [(b, lod, i * 0.37 % (1 << lod), i * 0.61 % (1 << lod), i * 0.25 % (1 << lod)) for i in range(40) for b, lod in ((0, 1), (0, 2), (5, 2), (9, 2))] + [(0, 2, 3.9, 3.9, 3.9), (0, 2, 2.0, 1.0, 0.0), (0, 2, None, 1.0, 1.0), (0, 2, -1.5, 0.0, 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, brick_id long, lod int, cx double, cy double, cz double")
    got = rays.trilinear(points, nodes, ("r", "a"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    rows = {x.id: (x.r, x.a) for x in got.collect()}
    assert len(rows) == len(places)
    for i, (b, lod, *at) in enumerate(places):
        total, sums = 0.0, [0.0, 0.0]
        for k in range(8) if None not in at and min(at) >= 0 else ():
            bits = [k >> j & 1 for j in range(3)]
            w = math.prod(c - math.floor(c) if t else 1 - c + math.floor(c) for c, t in zip(at, bits))
            found = cells.get((b, lod, code([min(math.floor(c) + t, (1 << lod) - 1) for c, t in zip(at, bits)])))
            if w > 0 and found:
                total += w
                sums = [s + w * (v or 0.0) for s, v in zip(sums, found)]
        assert rows[i] == pytest.approx(tuple(s / total if total else 0.0 for s in sums)), places[i]


def test_nodes_are_not_broadcast(spark):
    """Nodes and voxels of a volume grow with it, also where the planner takes them to be small."""
    nodes = spark.range(64).select(F.lit(0).cast("long").alias("brick_id"), F.lit(2).alias("lod"), F.col("id").alias("m"), (F.col("id") % 8 / 8.0).alias("alpha"))
    found = rays.lod_gradients(nodes, nodes.select("brick_id", "lod").distinct(), 8, 8)
    voxels = spark.range(64).select((F.col("id") % 4).alias("x"), (F.col("id").bitwiseAND(F.lit(12)) / 4).cast("long").alias("y"), F.floor(F.col("id") / 16).alias("z"), F.lit(0.5).alias("alpha"))
    points = voxels.select((F.col("x") + 4 * F.col("y") + 16 * F.col("z")).alias("id"), "x", "y", "z", *(F.lit(0.0).alias(f"n{c}") for c in "xyz"), F.lit(0.5).alias("through"))
    for df, key in ((found, "home_m"), (rays.shadows(points, voxels, (0.0, 1.0, 0.0), 4), "x#")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin" in line and key in line for line in plan.splitlines())
    assert found.count() == 64
