"""Exact DBSCAN without forming all pairs of a dense region.

Clique cells: the space is cut into cells of side eps/sqrt(d) (slightly less)
over all d coordinates, so any two points of one cell are within eps.

* A cell holding at least ``min_samples`` points ("dense") is all core and
  internally connected: no pair of it is ever formed.
* A point of a sparse cell (fewer than ``min_samples`` points) is compared
  with the points of the neighbouring cells -- skipped or counted in bulk when
  the other cell's bounding box lies wholly beyond or within eps of it.  Each
  cell meets a bounded number of sparse cells, each with < min_samples
  points, so this work is linear in the data.
* Two neighbouring dense cells are connected when some pair is within eps:
  decided by bounding boxes, refined level by level (sub-cells of half the
  side) only where undecided, and brute-forced only between sub-cells whose
  size product is below ``brute_limit``.
* Clusters are connected components of the graph of cells holding a core
  point (far smaller than the point graph), numbered by their smallest core
  id; a border point takes the smallest cluster among its core neighbours.

Candidate cell pairs come from ``box_join.near_pairs`` over the *cell table*,
which splits on all coordinates -- a join of aggregates, not of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.box_join import box_max2, box_min2, near_pairs, sum_of
from panelkit.operators.common import materialise
from panelkit.operators.dbscan import connected_components
from panelkit.operators.ranking import with_global_index


def _sq(c: Column) -> Column:
    return c * c


def _dist2(x: Column, y: Column) -> Column:
    return sum_of(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))


def _index(x: Column, side: float) -> Column:
    return F.transform(x, lambda v: F.floor(v / F.lit(side)).cast("long"))


def _boxes(frame: DataFrame, keys: list[str], d: int) -> DataFrame:
    """count, smallest id, bounding box per key."""
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("mid"),
        F.array(*[F.min(F.element_at("x", i + 1)) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.element_at("x", i + 1)) for i in range(d)]).alias("hi"))


def dbscan_cells(points: DataFrame, eps: float, min_samples: int, id_col: str = "id", coords: str = "x",
                 brute_limit: int = 4096, max_levels: int = 40) -> DataFrame:
    """Labels ``(id, cluster, is_core)``; same result as the sequential
    algorithm with ids in row order (see module doc)."""
    eps = float(eps)
    eps2 = eps * eps
    pts0 = points.select(F.col(id_col).alias("id"), F.col(coords).cast("array<double>").alias("x"))
    d = int(pts0.select(F.max(F.size("x"))).first()[0] or 0)
    side = eps / math.sqrt(max(d, 1)) * (1.0 - 1e-9)
    pts = materialise(pts0.withColumn("cell", _index(F.col("x"), side)))

    cells = _boxes(pts, ["cell"], d).withColumn("dense", F.col("n") >= min_samples)
    cells = materialise(cells)

    # Cell pairs (A before B by smallest id) whose boxes are within eps.
    near = near_pairs(cells.select(F.col("mid").alias("key"), "lo", "hi"), eps2, d)
    sides = {e: cells.select(F.col("mid").alias(f"k{e}"), F.col("cell").alias(f"c{e}"), F.col("lo").alias(f"lo{e}"),
                             F.col("hi").alias(f"hi{e}"), F.col("n").alias(f"n{e}"), F.col("dense").alias(f"d{e}")) for e in "ab"}
    pairs = near.join(sides["a"], "ka").join(sides["b"], "kb").drop("ka", "kb")
    pairs = materialise(pairs.withColumn(
        "full", box_max2(F.col("loa"), F.col("hia"), F.col("lob"), F.col("hib")) <= F.lit(eps2)))

    # Sparse points against their neighbour cells (both directions of a pair).
    nbr = (pairs.select(F.col("ca").alias("cell"), F.col("cb").alias("oc"), F.col("lob").alias("olo"),
                        F.col("hib").alias("ohi"), F.col("nb").alias("on"))
           .unionByName(pairs.select(F.col("cb").alias("cell"), F.col("ca").alias("oc"),
                                     F.col("loa").alias("olo"), F.col("hia").alias("ohi"),
                                     F.col("na").alias("on"))))
    sparse_pts = pts.join(cells.where(~F.col("dense")).select("cell"), "cell", "left_semi")
    pc = sparse_pts.join(nbr, "cell")
    pmin2 = sum_of(F.transform(F.zip_with(F.col("x"), F.zip_with("olo", "ohi", lambda l, h: F.struct(
        l.alias("l"), h.alias("h"))), lambda v, b: F.greatest(F.lit(0.0), b["l"] - v, v - b["h"])), _sq))
    pmax2 = sum_of(F.transform(F.zip_with(F.col("x"), F.zip_with("olo", "ohi", lambda l, h: F.struct(
        l.alias("l"), h.alias("h"))), lambda v, b: F.greatest(F.abs(v - b["l"]), F.abs(b["h"] - v))), _sq))
    pc = materialise(pc.select("id", "cell", "oc", "on", pmin2.alias("_min2"), pmax2.alias("_max2"))
                     .where(F.col("_min2") <= F.lit(eps2)))
    full_adj = pc.where(F.col("_max2") <= F.lit(eps2)).select("id", "cell", "oc", "on")
    partial = pc.where(F.col("_max2") > F.lit(eps2)).select("id", "cell", "oc")
    others = pts.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("cell").alias("oc"))
    brute = (partial.join(pts.select("id", "x"), "id").join(others, "oc")
             .where(_dist2(F.col("x"), F.col("qx")) <= F.lit(eps2))
             .select("id", "cell", "oc", "qid"))
    brute = materialise(brute)

    own_n = cells.select("cell", F.col("n").alias("own"))
    counts = (sparse_pts.select("id", "cell").join(own_n, "cell")
              .join(full_adj.groupBy("id").agg(F.sum("on").alias("_f")), "id", "left")
              .join(brute.groupBy("id").agg(F.count(F.lit(1)).alias("_b")), "id", "left")
              .select("id", "cell", (F.col("own") + F.coalesce("_f", F.lit(0)) + F.coalesce("_b", F.lit(0)))
                      .alias("_cnt")))
    sparse_core = counts.select("id", "cell", (F.col("_cnt") >= min_samples).alias("is_core"))
    dense_core = pts.join(cells.where("dense").select("cell"), "cell").select("id", "cell", F.lit(True).alias("is_core"))
    flags = materialise(sparse_core.unionByName(dense_core))

    # Cell graph: a vertex per cell with a core point, named by its smallest core id.
    core_cells = flags.where("is_core").groupBy("cell").agg(F.min("id").alias("vid"))
    core_cells = materialise(core_cells)
    core_pts = flags.where("is_core").select("id", "cell")
    vid_of = core_cells.select(F.col("cell").alias("oc"), F.col("vid").alias("ovid"))
    e_full = (full_adj.join(core_pts.select("id"), "id", "left_semi")
              .join(core_cells, "cell").join(vid_of, "oc").select(F.col("vid").alias("a"), F.col("ovid").alias("b")))
    e_brute = (brute.join(core_pts.select("id"), "id", "left_semi")
               .join(core_pts.select(F.col("id").alias("qid")), "qid", "left_semi")
               .join(core_cells, "cell").join(vid_of, "oc").select(F.col("vid").alias("a"), F.col("ovid").alias("b")))
    e_dense = _dense_links(pts, pairs.where(F.col("da") & F.col("db")), side, eps2, brute_limit, max_levels, d)
    e_dense = (e_dense.join(core_cells.select(F.col("cell").alias("ca"), F.col("vid").alias("a")), "ca")
               .join(core_cells.select(F.col("cell").alias("cb"), F.col("vid").alias("b")), "cb").select("a", "b"))
    edges = e_full.unionByName(e_brute).unionByName(e_dense).where(F.col("a") != F.col("b")).distinct()

    comps = connected_components(core_cells.select(F.col("vid").alias("id")), edges)
    numbered = with_global_index(comps.select("comp").distinct(), ["comp"], "cluster")
    cell_cluster = materialise(core_cells.join(comps.withColumnRenamed("id", "vid"), "vid")
                               .join(numbered, "comp").select("cell", F.col("cluster").cast("int")))
    occ = cell_cluster.select(F.col("cell").alias("oc"), F.col("cluster").alias("_oc"))
    # Border candidates: own cell, wholly-near cells with a core, core neighbours found pairwise.
    cand = (flags.where(~F.col("is_core")).select("id", "cell").join(cell_cluster, "cell")
            .select("id", F.col("cluster").alias("_c"))
            .unionByName(full_adj.join(occ, "oc").select("id", F.col("_oc").alias("_c")))
            .unionByName(brute.join(core_pts.select(F.col("id").alias("qid")), "qid", "left_semi")
                         .join(occ, "oc").select("id", F.col("_oc").alias("_c"))))
    border = cand.groupBy("id").agg(F.min("_c").alias("_bc"))
    return (flags.join(cell_cluster, "cell", "left").join(border, "id", "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("is_core"), F.col("cluster")).otherwise(F.coalesce("_bc", F.lit(-1)))
                    .cast("int").alias("cluster"), "is_core"))


def _dense_links(pts: DataFrame, dd: DataFrame, side: float, eps2: float, brute_limit: int,
                 max_levels: int, d: int) -> DataFrame:
    """Pairs (ca, cb) of dense cells with some pair of points within eps."""
    spark = pts.sparkSession
    linked = dd.where("full").select("ca", "cb")
    todo = dd.where(~F.col("full")).select("ca", "cb", F.col("ca").alias("pa"), F.col("cb").alias("pb"))
    todo = materialise(todo)
    level = 0
    while todo.limit(1).count() > 0:
        level += 1
        s_l = side / (2 ** level)
        s_p = side / (2 ** (level - 1))
        involved = todo.select(F.col("ca").alias("cell")).unionByName(todo.select(F.col("cb").alias("cell"))).distinct()
        lp = (pts.join(involved, "cell", "left_semi")
              .select("id", "x", "cell",
                      (_index(F.col("x"), s_p) if level > 1 else F.col("cell")).alias("par"),
                      _index(F.col("x"), s_l).alias("sub")))
        lp = materialise(lp)
        subs = _boxes(lp, ["cell", "par", "sub"], d)
        a = subs.select(F.col("cell").alias("ca"), F.col("par").alias("pa"), F.col("sub").alias("sa"),
                        F.col("n").alias("na"), F.col("lo").alias("loa"), F.col("hi").alias("hia"))
        b = subs.select(F.col("cell").alias("cb"), F.col("par").alias("pb"), F.col("sub").alias("sb"),
                        F.col("n").alias("nb"), F.col("lo").alias("lob"), F.col("hi").alias("hib"))
        cand = (todo.join(a, ["ca", "pa"]).join(b, ["cb", "pb"])
                .where(box_min2(F.col("loa"), F.col("hia"), F.col("lob"), F.col("hib")) <= F.lit(eps2))
                .withColumn("_full", box_max2(F.col("loa"), F.col("hia"), F.col("lob"), F.col("hib")) <= F.lit(eps2)))
        cand = materialise(cand.select("ca", "cb", "sa", "sb", "na", "nb", "_full"))
        hit_full = cand.where("_full").select("ca", "cb")
        small = cand.where(~F.col("_full") & ((F.col("na") * F.col("nb") <= brute_limit) | F.lit(level >= max_levels)))
        pa_pts = lp.select(F.col("cell").alias("ca"), F.col("sub").alias("sa"), F.col("x").alias("xa"))
        pb_pts = lp.select(F.col("cell").alias("cb"), F.col("sub").alias("sb"), F.col("x").alias("xb"))
        hit_brute = (small.join(pa_pts, ["ca", "sa"]).join(pb_pts, ["cb", "sb"])
                     .where(_dist2(F.col("xa"), F.col("xb")) <= F.lit(eps2)).select("ca", "cb"))
        new_links = materialise(hit_full.unionByName(hit_brute).distinct())
        linked = linked.unionByName(new_links)
        rest = (cand.where(~F.col("_full") & (F.col("na") * F.col("nb") > brute_limit) & F.lit(level < max_levels))
                .join(new_links, ["ca", "cb"], "left_anti"))
        todo = materialise(rest.select("ca", "cb", F.col("sa").alias("pa"), F.col("sb").alias("pb")))
    return linked.distinct()
