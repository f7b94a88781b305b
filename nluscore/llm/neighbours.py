"""Embedding near-duplicates by NN-descent.

A neighbour graph (k best neighbours a vector) starts from random-hyperplane buckets, cut into leaves
of bounded size, and is refined by neighbours-of-neighbours joins: the vectors around a node are
compared with each other and better neighbours replace worse ones, until a round adds hardly any link.
Lists that are saturated (all k neighbours are links) can't tell how many links a vector has: they
are enlarged to the vector's whole component, compared in blocks. Around a component's centre, vectors
within half the threshold's angle are all linked by the triangle inequality and are only counted; the
others are compared with everyone. Near copies can fill all k places of each other's lists and so hide the
links from one component to another: saturated vectors look for their k best neighbours in other
components, which are merged by the links found, until no link is new. Recall is audited against brute force on a bounded set of
queries, as a mean over vectors in classes of their own for small and large groups; more buckets are drawn
while a class is too low, and a class that stays too low is an error. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, need, stored

#: Neighbours a node, rows of a leaf, rows of a block, rounds of descent, recall asked for, turns of new buckets.
K, LEAF, BLOCK, ROUNDS, RECALL, TURNS = 8, 64, 512, 4, 0.99, 4
#: Queries of an audit: inside components above a block, and outside (many vectors there have no links).
AUDIT, AUDIT_OUTSIDE = 256, 1024


def nodes(vectors: DataFrame, id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes). rows: id, node (null for vectors that link with nothing). nodes: id, dim, v, v32, w.

    v: the unit vector's float64 bytes; v32 the same in float32; w: how many rows have this vector.
    """
    d = need(vectors, id_col, vec).toDF("id", "vec")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, low, dim = [], [], []
            for x in b.column("vec"):
                a = x.as_py()
                a = np.array(a, float) if a and all(c is not None for c in a) else np.zeros(0)
                top = np.abs(a).max() if len(a) else 0.0
                good = len(a) and np.isfinite(a).all() and top > 0
                if good:
                    a = a / top  # so that squares neither overflow nor vanish
                    a = a / np.sqrt(a @ a) + 0.0
                out.append(a.tobytes() if good else None)
                low.append(a.astype(np.float32).tobytes() if good else None)
                dim.append(len(a) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(dim, pa.int32()), pa.array(out, pa.binary()), pa.array(low, pa.binary())], names=["id", "dim", "v", "v32"])

    kind = d.schema["id"].dataType.simpleString()
    rows = stored(d.mapInArrow(unit, f"id {kind}, dim int, v binary, v32 binary"), "units")
    reps = stored(rows.where("v is not null").groupBy("v").agg(
        F.min("id").alias("id"), F.first("dim").alias("dim"), F.first("v32").alias("v32"), F.count("*").alias("w")), "nodes")
    return rows, reps


def _matrix(cells, dtype) -> np.ndarray:
    return np.stack([np.frombuffer(c, dtype) for c in cells])


def _top(ids: np.ndarray, m: np.ndarray, k: int, comps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best others, of other components where these are given: (src, dst, sim)."""
    s = m @ m.T
    np.fill_diagonal(s, -2)
    if comps is not None:
        s[comps[:, None] == comps[None, :]] = -2
    k = min(k, len(ids) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, best, 1).ravel()
    good = sim > -1.5
    return np.repeat(ids, k)[good], ids[best].ravel()[good], sim[good]


GROUP = "src bigint, dst bigint, sim float"


def _near(k: int):
    """Arrow step: groups of (id, v32) -> the k best pairs of each member; with (id, v32, c) pairs of two components c."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for g in b.column("g"):
                # a vector that is around twice counts once
                got = {int(x["id"]): x for x in g.as_py()}
                if len(got) > 1:
                    comps = [x.get("c") for x in got.values()]
                    comps = None if comps[0] is None else np.array(comps, np.int64)
                    if comps is None or (comps != comps[0]).any():
                        parts.append(_top(np.fromiter(got, np.int64, len(got)), _matrix([x["v32"] for x in got.values()], np.float32), k, comps))
            if parts:
                src, dst, sim = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim.astype(np.float32))], names=["src", "dst", "sim"])
    return run


def _member(reps: DataFrame) -> list[str]:
    """Columns that stand for a vector in a group; the component c only where ``reps`` has it."""
    return ["id", "v32"] + [c for c in reps.columns if c == "c"]


def seeds(reps: DataFrame, n: int, k: int, leaf: int, turn: int, threshold: float) -> DataFrame:
    """First neighbours: pairs that share a bucket of hyperplane signs in one of several tables.

    Bits grow with the logarithm of the rows, tables so that a pair at the threshold shares a bucket
    with a chance of about 0.97. With a column c only pairs of two components count. A bucket above 4 leaves (one of near copies) is dealt into leaves by hash.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / leaf))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if bits == 0 else max(4, math.ceil(math.log(0.03) / math.log(1 - meet)))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.array(b.column("dim"))
            out = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([turn, int(dim)]).standard_normal((int(dim), tables * max(1, bits))).astype(np.float32)
                at = np.nonzero(dims == dim)[0]
                m = _matrix([b.column("v32")[int(i)].as_py() for i in at], np.float32)
                sign = (m @ planes[dim] > 0).reshape(len(at), tables, -1)[:, :, :bits].astype(np.int64)
                out[at] = (sign << np.arange(bits)).sum(axis=2) if bits else 0
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(out.tolist(), pa.list_(pa.int64()))], names=[*names, "codes"])

    member = _member(reps)
    kinds = "dim int, id bigint, v32 binary" + ", c bigint" * ("c" in member)
    each = reps.select("dim", *member).mapInArrow(codes, f"{kinds}, codes array<bigint>")
    each = each.select("dim", *member, F.posexplode("codes").alias("t", "code"))
    keys = ["dim", "t", "code"]
    large = stored(each.drop("v32").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 4 * leaf), "large")
    each = each.join(large, keys, "left").withColumn(
        "piece", F.pmod(F.xxhash64("id", "t"), F.coalesce(F.ceil(F.col("n") / F.lit(leaf)), F.lit(1))))
    groups = each.groupBy(*keys, "piece").agg(F.collect_list(F.struct(*member)).alias("g"))
    return groups.select("g").mapInArrow(_near(k), GROUP)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of every node, written."""
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return stored(one.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "graph")


def descend(graph: DataFrame, reps: DataFrame, k: int, also: DataFrame | None = None) -> DataFrame:
    """One round: vectors around a node (neighbours, those in ``also`` too, and 2 k of those that have it as one) meet each other."""
    back = graph.select(F.col("dst").alias("mid"), F.col("src").alias("x"))
    draw = F.row_number().over(Window.partitionBy("mid").orderBy(F.xxhash64("mid", "x")))
    back = back.withColumn("r", draw).where(F.col("r") <= 2 * k).select("mid", "x")
    around = graph.select(F.col("src").alias("mid"), F.col("dst").alias("x")).unionByName(back)
    if also is not None:
        around = around.unionByName(also.select(F.col("src").alias("mid"), F.col("dst").alias("x")))
    member = _member(reps)
    held = around.distinct().join(reps.select(*member), F.col("x") == F.col("id"))
    groups = held.groupBy("mid").agg(F.collect_list(F.struct(*member)).alias("g"))
    return best(graph.unionByName(groups.select("g").mapInArrow(_near(k), GROUP)), k)


def refined(graph: DataFrame, reps: DataFrame, k: int, threshold: float, also: DataFrame | None = None) -> DataFrame:
    """Rounds of descent until one adds hardly any link."""
    count = graph.where(F.col("sim") >= threshold).count()
    for _ in range(ROUNDS):
        graph = descend(graph, reps, k, also)
        now = graph.where(F.col("sim") >= threshold).count()
        if now <= count * 1.001:
            break
        count = now
    return graph


def verified(graph: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of the graph whose cosine in double precision reaches the threshold, written."""
    pairs = graph.where(F.col("sim") >= threshold - 1e-4).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    a = reps.select(F.col("id").alias("a"), F.col("v").alias("va"))
    b = reps.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = [float(np.frombuffer(p, float) @ np.frombuffer(q, float)) >= threshold
                        for p, q in zip(x.column("va").to_pylist(), x.column("vb").to_pylist())]
                yield x.select(["a", "b"]).filter(pa.array(keep))

    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(check, "a bigint, b bigint"), "links")


def joined(graph: DataFrame, edges: DataFrame, reps: DataFrame, threshold: float, k: int, leaf: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges, components): ``edges`` with links between components that saturated lists had no place for.

    A link is missing from the graph only where the lists of both its ends are full of links. Those vectors
    get lists of neighbours in other components; the links found merge components, and vectors whose new
    list is full again go on, as their list can hide a third component, until no link is new.
    """
    lists = graph
    while True:
        comp = components(edges)
        full = lists.where(F.col("sim") >= threshold - 1e-4).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        some = reps.select("id", "dim", "v32").join(full.select("id"), "id").join(comp.select(F.col("node").alias("id"), F.col("component").alias("c")), "id")
        some = stored(some, "saturated")
        if len(some.select("c").distinct().take(2)) < 2:
            return edges, comp
        lists = best(seeds(some, some.count(), k, leaf, turn, threshold), k)
        lists = refined(lists, some, k, threshold, graph)
        new = verified(lists, reps, threshold)
        if new.isEmpty():
            return edges, comp
        edges = edges.unionByName(new)


def _count(threshold: float):
    """Arrow step: two sides of (id, v, w) -> links of each member; an empty second side means all pairs of the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = [], []
            for one, two in zip(batch.column("one"), batch.column("two")):
                p, q = one.as_py(), two.as_py()
                if not p:
                    continue
                mp, wp = _matrix([x["v"] for x in p], float), np.array([x["w"] for x in p], np.int64)
                if q:
                    near = mp @ _matrix([x["v"] for x in q], float).T >= threshold
                    wq = np.array([x["w"] for x in q], np.int64)
                    ids += [x["id"] for x in p] + [x["id"] for x in q]
                    links += [*(near @ wq).tolist(), *(wp @ near).tolist()]
                else:
                    near = mp @ mp.T >= threshold
                    np.fill_diagonal(near, False)
                    ids += [x["id"] for x in p]
                    links += (near @ wp).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["id", "links"])
    return run


def degrees(reps: DataFrame, comp: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links) of every node of a component: rows of other nodes at the threshold or above."""
    m = stored(reps.select("id", "dim", "v", "w").join(comp.withColumnRenamed("node", "id"), "id"), "members")
    sizes = stored(m.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    row = F.struct("id", "v", "w")
    none = F.array().cast("array<struct<id:bigint,v:binary,w:bigint>>")
    large = stored(sizes.where(F.col("n") > block), "large-components")
    small = m.join(large, "component", "left_anti").groupBy("component").agg(F.collect_list(row).alias("one")).select("one", none.alias("two"))
    counted = small.mapInArrow(_count(threshold), "id bigint, links bigint")
    if large.isEmpty():
        return counted
    # Large components: the centre, and each member's angle to it.
    big = m.join(large, "component")

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[int, np.ndarray] = {}
            for c, v in zip(b.column("component").to_pylist(), b.column("v").to_pylist()):
                v = np.frombuffer(v, float)
                sums[c] = sums.get(c, 0.0) + v
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sums[c].tolist() for c in keys], pa.list_(pa.float64()))], names=["component", "s"])

    part = big.select("component", "v").mapInArrow(coordinates, "component bigint, s array<double>")
    axis = part.select("component", F.posexplode("s").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    centre = axis.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select("component", F.col("s.x").alias("centre"))
    half = math.acos(threshold) / 2 - 1e-7

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = []
            for v, c in zip(b.column("v").to_pylist(), b.column("centre")):
                c = np.asarray(c.values.to_numpy(zero_copy_only=False))
                core.append(bool(math.acos(min(1.0, max(-1.0, float(np.frombuffer(v, float) @ c) / max(1e-300, float(np.sqrt(c @ c)))))) <= half))
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), b.column("v"), b.column("w"), b.column("n"), pa.array(core)],
                                             names=["component", "id", "v", "w", "n", "core"])

    placed = big.join(centre, "component").select("component", "id", "v", "w", "n", "centre").mapInArrow(
        angle, "component bigint, id bigint, v binary, w bigint, n bigint, core boolean")
    placed = stored(placed.withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(block)))), "placed")
    core = placed.where("core").groupBy("component").agg(F.sum("w").alias("all"))
    inner = placed.where("core").join(core, "component").select("id", (F.col("all") - F.col("w")).alias("links"))
    cells = placed.select("component", "core", "piece").distinct()
    rim = cells.where("not core").select("component", F.col("piece").alias("p"))
    other = cells.select("component", F.col("core").alias("core2"), F.col("piece").alias("p2"))
    pairs = rim.join(other, "component").where(F.col("core2") | (F.col("p") <= F.col("p2")))
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    self_pair = ~F.col("core2") & (F.col("p") == F.col("p2"))
    sides = pairs.select("component", F.lit(False).alias("core"), F.col("p").alias("piece"), "pair", F.lit(1).alias("side")).unionByName(
        pairs.where(~self_pair).select("component", F.col("core2").alias("core"), F.col("p2").alias("piece"), "pair", F.lit(2).alias("side")))
    blocks = placed.join(sides, ["component", "core", "piece"]).groupBy("pair").agg(
        F.collect_list(F.when(F.col("side") == 1, row)).alias("one"), F.collect_list(F.when(F.col("side") == 2, row)).alias("two"))
    across = blocks.select("one", "two").mapInArrow(_count(threshold), "id bigint, links bigint")
    return counted.unionByName(inner).unionByName(across).groupBy("id").agg(F.sum("links").alias("links"))


def recall(links: DataFrame, comp: DataFrame, reps: DataFrame, threshold: float, k: int, block: int) -> dict[str, float]:
    """Mean share of its links that an audited node was found to have, by class; nodes without links don't count.

    Nodes are picked by hash and compared with all nodes, those outside components of more than ``block``
    nodes on their own. In both, nodes with up to ``k`` links and nodes with more are classes: many links of
    a large group can't outweigh the lost links of a small one.
    """
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > block)
    inside = comp.join(sizes, "component").select(F.col("node").alias("id"), F.lit(True).alias("inside"))
    parts = stored(reps.select("id").join(inside, "id", "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside")), "audit-parts")
    counts = dict(parts.groupBy("inside").count().collect())
    draw, pick = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 30)), F.lit(False)
    for part, queries in ((True, AUDIT), (False, AUDIT_OUTSIDE)):
        pick = pick | ((F.col("inside") == part) & (draw < min(1.0, queries / max(1, counts.get(part, 0))) * (1 << 30)))
    asked = reps.select("id", "dim", "v").join(parts.where(pick), "id").collect()
    if not asked:
        return {}
    shared = reps.sparkSession.sparkContext.broadcast([(r.id, r.dim, bytes(r.v)) for r in asked])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for i, dim, v in shared.value:
            by_dim.setdefault(dim, []).append((i, v))
        side = {d: (np.array([i for i, _ in x], np.int64), _matrix([v for _, v in x], float)) for d, x in by_dim.items()}
        total: dict[int, int] = {}
        for b in batches:
            dims = np.array(b.column("dim"))
            for d, (ids, q) in side.items():
                all_at = np.nonzero(dims == d)[0]
                for at in np.split(all_at, range(block, len(all_at), block)) if len(all_at) else ():
                    m = _matrix([b.column("v")[int(i)].as_py() for i in at], float)
                    w = np.array(b.column("w"))[at]
                    for i, c in zip(ids.tolist(), ((q @ m.T >= threshold) @ w).tolist()):
                        total[i] = total.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["id", "there"])

    there = reps.select("id", "dim", "v", "w").mapInArrow(brute, "id bigint, there bigint").groupBy("id").agg(F.sum("there").alias("there"))
    seen = there.join(reps.select("id", "w"), "id").join(links, "id", "left").join(parts, "id").select(
        "inside", (F.col("there") - F.col("w")).alias("there"), F.coalesce("links", F.lit(0)).alias("found")).collect()
    shares: dict[str, list[float]] = {}
    for r in seen:
        if r.there:
            name = f"{'in' if r.inside else 'out'}side large components, {'up to' if r.there <= k else 'above'} {k} links"
            shares.setdefault(name, []).append(min(r.there, r.found) / r.there)
    return {name: sum(x) / len(x) for name, x in sorted(shares.items())}


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, k: int = K,
                    leaf: int = LEAF, block: int = BLOCK, target: float = RECALL, turns: int = TURNS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing. Equal vectors
    always link. Vectors of different length never do. Repeated ids are rows of their own that share
    the id. Links below the threshold in double precision are never made. RuntimeError with the measured
    figures when the audit's recall is below ``target`` in some class after all turns.
    """
    rows, reps = nodes(vectors, id_col, vec)
    n = reps.count()
    graph, links, edges = None, None, None
    for turn in range(turns):
        first = seeds(reps, n, k, leaf, turn, threshold)
        graph = best(first if graph is None else graph.unionByName(first), k)
        graph = refined(graph, reps, k, threshold)
        now = verified(graph, reps, threshold)
        edges, comp = joined(graph, now if edges is None else edges.unionByName(now), reps, threshold, k, leaf, turn)
        links = stored(degrees(reps, comp, threshold, block), "degrees")
        found = recall(links, comp, reps, threshold, k, block)
        if min(found.values(), default=1.0) >= target:
            break
    else:
        figures = "; ".join(f"{name}: {x:.4f}" for name, x in found.items())
        raise RuntimeError(f"near duplicates: recall below {target} after {turns} turns of buckets ({figures})")
    node = reps.select(F.col("v").alias("nv"), F.col("id").alias("node"), "w")
    named = (node.join(links.withColumnRenamed("id", "node"), "node", "left").join(comp, "node", "left")
             .select("nv", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.join(stored(named, "named"), rows["v"] == F.col("nv"), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
