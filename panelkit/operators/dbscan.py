"""DBSCAN by spatial partitioning, for one or many (eps, min_samples) settings at a time.

1. Points with the same coordinates are one weighted point; points are numbered in the order of their ids.
2. ``spatial.blocks`` partitions them once for all radii of the settings: halo points are sent to the groups whose
   box they can reach, node pairs wholly within a radius are settled in bulk, and all others are compared inside
   groups of two bounded blocks.
3. Neighbours are counted within every radius, first inside a point's own block, and in other blocks only for points
   that then lack neighbours for some setting; a point that has what all settings need is not compared further.
4. Core points are linked inside their own block first: each gets the root of its component there.  Then groups of two
   blocks link components, leaving out what is linked already, and return a forest of roots (never pairs) and, per
   point that is no core point, the roots it touches (fewer than min_samples).
5. The forests are merged by connected components on (root, setting), all settings in the same rounds.
6. Cluster numbers follow the smallest core id of each component (0, 1, ...), a border point takes the smallest
   cluster among its core neighbours, everything else is noise (-1).  For ids in row order this is exactly the
   labelling of the sequential algorithm.

Rows with a null id are left out; rows whose vector is null, empty, of another length than the longest, or holds a
null or NaN are noise.  ``dbscan_pairs`` is the direct formulation on explicit pairs, ``dbscan_cells`` the clique-cell
variant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import spatial
from panelkit.operators.common import in_few, materialise
from panelkit.operators.ranking import with_global_index
from panelkit.session import ensure_checkpoint_dir

SALTS = 8
# A distinct vector that more rows share is joined back by broadcast (n / HEAVY_SHARE bounds their number).
HEAVY_SHARE = 10_000


def _sound(points: DataFrame, id_col: str, coords: str) -> tuple[DataFrame, int]:
    """``id, x`` of the points that can have neighbours, and their number of coordinates."""
    pts = points.select(F.col(id_col).alias("id"), F.col(coords).cast("array<double>").alias("x"))
    d = int(pts.select(F.max(F.size("x"))).first()[0] or 0)
    return pts.where(F.col("id").isNotNull() & (F.size("x") == d) & (F.size("x") > 0)
                     & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))), d


def eps_neighbours(points: DataFrame, eps: float, id_col: str = "id", coords: str = "x") -> DataFrame:
    """Pairs ``(a, b, d2)`` with a < b and squared distance <= eps^2, over all coordinates."""
    pts, d = _sound(points, id_col, coords)
    numbered = with_global_index(pts, ["id"], "idx")  # stored
    n = numbered.count()
    if n == 0:
        return pts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d2"))
    made = spatial.blocks(numbered.select("idx", F.lit(1).cast("long").alias("w"), "x"), n, d, [float(eps)], materialise, opened=True)
    if made.bulk:  # pairs are asked for one by one, so nothing is settled in bulk
        made = made.opened()
    limit, radii = float(eps) * float(eps), made.radii
    # ids ride with their points: the pairs, which can be very many, are not joined or shuffled again
    named = made.points.join(numbered.select("idx", "id"), "idx")
    kind = named.schema["id"].dataType.simpleString()

    def find(left, right):
        same = left is right
        for i in range(0, len(left), spatial.SLAB):
            for j in range(i if same else 0, len(right), spatial.SLAB):
                d2 = spatial.distances2(left.x[i:i + spatial.SLAB], right.x[j:j + spatial.SLAB], radii)
                r, c = np.nonzero(d2 <= limit)
                near, r, c = d2[r, c], r + i, c + j
                if same:
                    keep = r < c
                    near, r, c = near[keep], r[keep], c[keep]
                swap = left.idx[r] > right.idx[c]
                ends = pa.chunked_array([*left.table.column("id").chunks, *right.table.column("id").chunks])
                r, c = np.where(swap, c + len(left), r), np.where(swap, r, c + len(left))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ends.take(pa.array(k)).chunks or [pa.array([], ends.type)]) for k in (r, c)]
                                                 + [pa.array(near)], names=["a", "b", "d2"])

    return made.by_group(named, find, f"a {kind}, b {kind}, d2 double")


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, comp)`` with comp the smallest id of the vertex's component;
    ``edges`` has columns ``a``, ``b`` (undirected).

    Each round (label ``L``, all joins on ids, all groupings partial):
    for every edge (u, v) the smaller label ``L(u)`` is offered to ``v`` and to
    the current root ``L(v)`` of v's tree (hooking whole trees at once), then
    every vertex jumps to its parent's label.  The round's labels are
    checkpointed with the previous ones, so the convergence test reads only
    the checkpoint."""
    spark = vertices.sparkSession
    ensure_checkpoint_dir(spark)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.checkpoint(eager=True)
    labels = vertices.select(F.col("id"), F.col("id").alias("comp")).checkpoint(eager=True)
    # a round has ten exchanges: each goes out of as many tasks as the counted rows need, not of one for every
    # shuffle partition (a task costs three files and a log entry however few rows it has)
    rows = both.count() + labels.count()
    both, labels = in_few(both, rows), in_few(labels, rows)
    for _ in range(max_rounds):
        la = labels.select(F.col("id").alias("a"), F.col("comp").alias("la"))
        lb = labels.select(F.col("id").alias("b"), F.col("comp").alias("lb"))
        e = in_few(in_few(both.join(la, "a"), rows).join(lb, "b").where(F.col("la") < F.col("lb")), rows)
        offers = (e.select(F.explode(F.array("b", "lb")).alias("id"), "la")
                  .groupBy("id").agg(F.min("la").alias("_m")))
        hooked = in_few(labels.join(offers, "id", "left")
                        .select("id", F.col("comp").alias("_old"),
                                F.least("comp", F.coalesce("_m", "comp")).alias("comp")), rows)
        # a label can be that of a third of all vertices: only distinct labels look up their own label (unique
        # on both sides), and the answer goes back to the vertices by (label, salt)
        roots = hooked.select("comp").distinct()
        parent = in_few(roots.join(hooked.select(F.col("id").alias("comp"), F.col("comp").alias("_pc")), "comp")
                        .where("_pc < comp"), rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        jumped = (in_few(hooked.withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(parent, ["comp", "_salt"], "left")
                         .select("id", "_old", F.coalesce("_pc", "comp").alias("comp")), rows)
                  .checkpoint(eager=True))
        changed = jumped.where(F.col("comp") != F.col("_old")).limit(1).count()
        labels = jumped.drop("_old")
        if changed == 0:
            return labels
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")


def dbscan_from_pairs(points: DataFrame, pairs: DataFrame, min_samples: int,
                      id_col: str = "id") -> DataFrame:
    """Labels ``(id, cluster, is_core)`` from the eps-neighbour pairs."""
    ids = points.select(F.col(id_col).alias("id"))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    deg = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_deg"))
    flagged = (ids.join(deg, "id", "left")
               .select("id", ((F.coalesce("_deg", F.lit(0)) + 1) >= min_samples).alias("is_core")))
    cores = flagged.where("is_core").select("id")
    core_edges = (pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi")
                  .join(cores.withColumnRenamed("id", "b"), "b", "left_semi"))
    comps = connected_components(cores, core_edges)
    numbered = with_global_index(comps.select("comp").distinct(), ["comp"], "cluster")
    core_cluster = comps.join(numbered, "comp").select("id", F.col("cluster").cast("int"))
    # Border points: smallest cluster among their core neighbours.
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    border = (both.join(core_cluster.withColumnRenamed("id", "b"), "b")
              .groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("_bc")))
    return (flagged.join(core_cluster, "id", "left").join(border, "id", "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("is_core"), F.col("cluster"))
                    .otherwise(F.coalesce(F.col("_bc"), F.lit(-1))).cast("int").alias("cluster"),
                    "is_core"))


def dbscan_pairs(points: DataFrame, eps: float, min_samples: int, id_col: str = "id", coords: str = "x") -> DataFrame:
    """DBSCAN from the explicit eps-neighbour pairs (quadratic in a dense
    neighbourhood; kept as the direct formulation and for small inputs)."""
    pairs = eps_neighbours(points, eps, id_col, coords).checkpoint(eager=True)
    return dbscan_from_pairs(points, pairs, min_samples, id_col)


# The settings of the original grid.
DEFAULT_GRID = ((2.0, 3), (2.5, 5), (2.7, 5), (3.0, 3))


def _slabs(rows: np.ndarray, cols: np.ndarray):
    for i in range(0, len(rows), spatial.SLAB):
        for j in range(0, len(cols), 4 * spatial.SLAB):
            yield rows[i:i + spatial.SLAB], cols[j:j + 4 * spatial.SLAB]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row number of each component so far) after linking rows ``a`` with rows ``b``."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        # from here on a link for every pair of components, not of points
        links = np.unique(np.minimum(la, lb)[apart] * len(label) + np.maximum(la, lb)[apart])
        a, b = links // len(label), links % len(label)
        np.minimum.at(label, b, a)
        while not (label[label] == label).all():
            label = label[label]


def _join_up(label: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray, r: float) -> np.ndarray:
    """Labels after linking all ``rows`` and ``cols`` within ``r``.  Rows and columns that already are in a slab's
    largest component are not compared with each other, so a connected block takes far fewer distances than pairs."""
    for i, j in _slabs(rows, cols):
        if rows is cols and j[-1] < i[0]:
            continue
        values, sizes = np.unique(np.concatenate([label[i], label[j]]), return_counts=True)
        big = values[sizes.argmax()]
        inside = label[i] == big
        for a, b in ((i[~inside], j), (i[inside], j[label[j] != big])):
            if len(a) and len(b):
                u, v = np.nonzero(spatial.distances2(x[a], x[b], (r,)) <= r * r)
                label = _merge(label, a[u], b[v])
    return label


def _count(known: np.ndarray, need: np.ndarray, x: np.ndarray, rows: np.ndarray, y: np.ndarray, w: np.ndarray, radii) -> np.ndarray:
    """Adds to ``known[row, radius]`` the weight of ``y`` within the radii, until a row has what it needs of all."""
    for at in range(0, len(rows), spatial.SLAB):
        i = rows[at:at + spatial.SLAB]
        for j in range(0, len(y), 4 * spatial.SLAB):
            i = i[(known[i] < need).any(axis=1)]
            if not len(i):
                break
            d2 = spatial.distances2(x[i], y[j:j + 4 * spatial.SLAB], radii)
            for k, r in enumerate(radii):
                known[i, k] += ((d2 <= r * r).astype(float) @ w[j:j + 4 * spatial.SLAB]).astype(np.int64)
    return known


def _own_counts(made: spatial.Blocks, bulk: np.ndarray, need: np.ndarray):
    """Per block: neighbours of its points in bulk and in the block itself, as far as they are needed."""
    compared, radii = np.array([n in near for n, near in enumerate(made.near)]), made.radii

    def find(rows):
        leaf, w = rows.numbers("leaf"), rows.numbers("w").astype(float)
        known = bulk[leaf].copy()
        if len(rows) and compared[leaf[0]]:
            known = _count(known, need, rows.x, np.arange(len(rows)), rows.x, w, radii)
        t = rows.table.select(["idx", "w", "x", "leaf"])
        yield from t.append_column("known", pa.array(list(known), pa.list_(pa.int64()))).combine_chunks().to_batches()
    return find


def _other_counts(need: np.ndarray, radii):
    """Per group of two blocks: further neighbours of the points that are still open."""
    def find(left, right):
        for mine, other in ((left, right), (right, left)):
            if not len(mine):
                continue
            rows = np.flatnonzero(mine.table.column("open").to_numpy())
            known = np.array(mine.table.column("known").to_pylist(), np.int64).reshape(len(mine), -1)
            more = _count(known.copy(), need, mine.x, rows, other.x, other.numbers("w").astype(float), radii) - known
            rows = rows[more[rows].any(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(mine.idx[rows]), *[pa.array(more[rows, k]) for k in range(len(radii))]],
                                             names=["idx", *[f"c{k}" for k in range(len(radii))]])
    return find


def _touched(s: int, r: float, x: np.ndarray, idx: np.ndarray, rest: np.ndarray, core: np.ndarray, root: np.ndarray):
    """(s, point, root) for the roots of the core points near each of the points that are none."""
    found = []
    for i, j in _slabs(rest, core):
        u, v = np.nonzero(spatial.distances2(x[i], x[j], (r,)) <= r * r)
        if len(u):
            found.append(np.unique(np.stack([idx[i[u]], root[j[v]]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return np.full(len(pairs), s), pairs[:, 0], pairs[:, 1]


def _own_roots(settings):
    """Per block and setting: the smallest core point of the component of each core point by the block's own links
    (-1: no core point), and the roots near the block's other points."""
    def find(rows):
        flags = rows.numbers("flags")
        roots = np.full((len(rows), len(settings)), -1, np.int64)
        near: dict = {}
        for s, (r, _) in enumerate(settings):
            is_core = (flags >> s) & 1 == 1
            core, rest = np.flatnonzero(is_core), np.flatnonzero(~is_core)
            if len(core):
                roots[core, s] = rows.idx[_join_up(np.arange(len(rows)), rows.x, core, core, r)[core]]
                for _, a, b in zip(*_touched(s, r, rows.x, rows.idx, rest, core, roots[:, s]), strict=True):
                    near.setdefault(a, []).append({"s": s, "root": int(b)})
        t = rows.table.select(["idx", "w", "x", "leaf", "flags"])
        t = t.append_column("roots", pa.array(list(roots), pa.list_(pa.int64())))
        kind = pa.list_(pa.struct([("s", pa.int32()), ("root", pa.int64())]))
        yield from t.append_column("near", pa.array([near.get(i, []) for i in rows.idx], kind)).combine_chunks().to_batches()
    return find


def _other_links(settings):
    """Per group of two blocks and setting: a forest of the links between their components, and roots near points
    that are no core points."""
    def find(left, right):
        if not len(left) or not len(right):
            return
        x, idx = np.concatenate([left.x, right.x]), np.concatenate([left.idx, right.idx])
        flags = np.concatenate([left.numbers("flags"), right.numbers("flags")])
        roots = np.array(left.table.column("roots").to_pylist() + right.table.column("roots").to_pylist(), np.int64)
        on_left = np.arange(len(x)) < len(left)
        for s, (r, _) in enumerate(settings):
            is_core = (flags >> s) & 1 == 1
            if not is_core.any():
                continue
            root = roots[:, s]
            core = np.flatnonzero(is_core)
            _, first, at = np.unique(root[core], return_index=True, return_inverse=True)
            label = np.arange(len(x))
            label[core] = core[first[at]]
            label = _join_up(label, x, core[on_left[core]], core[~on_left[core]], r)
            moved = core[first][label[core[first]] != core[first]]
            found = [(np.full(len(moved), s), np.zeros(len(moved), bool), root[moved], root[label[moved]])]
            for side in (on_left, ~on_left):
                k, a, b = _touched(s, r, x, idx, np.flatnonzero(~is_core & side), np.flatnonzero(is_core & ~side), root)
                found.append((k, np.ones(len(k), bool), a, b))
            for k, border, a, b in found:
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(border), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                     names=["s", "border", "a", "b"])
    return find


@dataclass
class _Bulk:
    """What node pairs wholly within a radius say, per leaf and setting (all of it bounded by the leaves)."""
    made: spatial.Blocks
    settings: tuple
    which: list[int]  # a setting's radius

    def counts(self) -> np.ndarray:
        """Weight of the bulk neighbours of each leaf's points within each radius."""
        out = np.zeros((len(self.made.weight), len(self.made.radii)), np.int64)
        total = np.concatenate([[0], np.cumsum(self.made.weight)])
        for (a0, a1), (b0, b1), inside in self.made.bulk:
            for k in np.flatnonzero(inside):
                out[a0:a1, k] += total[b1] - total[b0]
                if (a0, a1) != (b0, b1):
                    out[b0:b1, k] += total[a1] - total[a0]
        return out

    def partners(self, core: np.ndarray) -> tuple[list, list]:
        """``core[leaf, s]``: a core point of the leaf or -1.  Rows (leaf, s, partner point): all of the leaf's core
        points are linked to that point; and links (s, a, b) between leaves."""
        partner, links = [], []
        for s in range(len(self.settings)):
            mate, mine = np.full(len(core), -1), core[:, s]
            for (a0, a1), (b0, b1), inside in self.made.bulk:
                if not inside[self.which[s]]:
                    continue
                left, right = (np.arange(lo, hi)[mine[lo:hi] >= 0] for lo, hi in ((a0, a1), (b0, b1)))
                if len(left) and len(right):
                    mate[left], mate[right] = mine[right[0]], mine[left[0]]
                    links += [(s, int(mine[left[0]]), int(mine[x])) for x in {*left.tolist(), *right.tolist()} if x != left[0]]
            partner += [(int(n), s, int(mate[n])) for n in np.flatnonzero(mate >= 0)]
        return partner, list(dict.fromkeys(links))

    def borders(self, cluster: np.ndarray) -> list:
        """``cluster[leaf, s]``: smallest cluster of the leaf's core points or -1.  Rows (leaf, s, smallest cluster
        among bulk neighbours)."""
        out = []
        none = np.iinfo(np.int64).max
        for s in range(len(self.settings)):
            mine = np.where(cluster[:, s] < 0, none, cluster[:, s])
            best = np.full(len(mine), none)
            for (a0, a1), (b0, b1), inside in self.made.bulk:
                if inside[self.which[s]]:
                    best[a0:a1] = np.minimum(best[a0:a1], mine[b0:b1].min())
                    best[b0:b1] = np.minimum(best[b0:b1], mine[a0:a1].min())
            out += [(int(n), s, int(best[n])) for n in np.flatnonzero(best < none)]
        return out


def _per_leaf(rows: DataFrame, leaves: int, settings: int) -> np.ndarray:
    out = np.full((leaves, settings), -1, np.int64)
    for r in rows.groupBy("leaf", "s").agg(F.min("v").alias("v")).collect():  # leaves x settings
        out[r["leaf"], r["s"]] = r["v"]
    return out


def _open_blocks(made: spatial.Blocks, counted: DataFrame) -> np.ndarray:
    """Blocks that hold a point still short of neighbours (as many rows as blocks at most)."""
    start = np.concatenate([[0], np.cumsum(made.chop)])[:-1]
    rows = counted.where("open").select("leaf", F.pmod("idx", F.element_at(F.lit([int(v) for v in made.chop]), F.col("leaf") + 1)).alias("part")).distinct().collect()
    return np.array([start[r["leaf"]] + r["part"] for r in rows], np.int64)


def dbscan_settings(points: DataFrame, settings=DEFAULT_GRID, id_col: str = "id", coords: str = "x",
                    report: dict | None = None, block: int | None = None) -> DataFrame:
    """Labels of every (eps, min_samples) setting: ``eps, min_samples, id, cluster, is_core``.  ``report`` receives
    the number of distinct ``points``, ``leaves``, ``bulk`` node pairs and ``compared`` pairs a point (upper bound)."""
    spark = points.sparkSession
    settings = tuple((float(e), int(m)) for e, m in settings)
    radii = sorted({e for e, _ in settings})
    which = [radii.index(e) for e, _ in settings]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("eps"), F.lit(m).alias("min_samples"))
                               for s, (e, m) in enumerate(settings)])).alias("setting")
    everyone = points.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(coords).cast("array<double>").alias("x"))
    sound, d = _sound(points, id_col, coords)
    merged = sound.groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    numbered = with_global_index(merged, ["rep", "x"], "idx")  # stored
    n = numbered.count()
    if n == 0:
        return (everyone.select("id", each).select("setting.eps", "setting.min_samples", F.col("id").alias(id_col),
                                                   F.lit(-1).alias("cluster"), F.lit(False).alias("is_core")))
    made = spatial.blocks(numbered.select("idx", "w", "x"), n, d, radii, materialise, block)
    bulk = _Bulk(made, settings, which)
    leaves, kinds = len(made.weight), len(settings)
    if report is not None:
        report.update(points=n, leaves=leaves, bulk=len(made.bulk), compared=made.compared / n)

    need = np.array([max(m for e, m in settings if e == r) for r in radii])
    counted = materialise(made.by_block(made.points, _own_counts(made, bulk.counts(), need), "idx long, w long, x binary, leaf int, known array<long>"))
    counted = counted.withColumn("open", sum((F.when(F.col("known")[k] < int(v), 1).otherwise(0) for k, v in enumerate(need)), F.lit(0)) > 0)
    wanted = np.zeros(int(made.chop.sum()), bool)
    wanted[_open_blocks(made, counted)] = True
    total = [F.col("known")[k] for k in range(len(radii))]
    if wanted.any():
        more = (made.by_group(counted, _other_counts(need, made.radii), "idx long, " + ", ".join(f"c{k} long" for k in range(len(radii))), True, wanted)
                .groupBy("idx").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(radii))]))
        counted = counted.join(more, "idx", "left")
        total = [t + F.coalesce(f"c{k}", F.lit(0)) for k, t in enumerate(total)]
    flag = sum((F.when(total[which[s]] >= m, 1 << s).otherwise(0) for s, (_, m) in enumerate(settings)), F.lit(0)).cast("long")
    flagged = counted.select("idx", "w", "x", "leaf", flag.alias("flags"))

    rooted = materialise(made.by_block(flagged, _own_roots(settings), "idx long, w long, x binary, leaf int, flags long, roots array<long>, near array<struct<s:int,root:long>>"))
    found = materialise(made.by_group(rooted.drop("w", "near"), _other_links(settings), "s int, border boolean, a long, b long", True))
    key = lambda c, s="s": (F.col(c) * kinds + F.col(s)).cast("long")
    cores = rooted.select("idx", "leaf", F.posexplode("roots").alias("s", "root")).where("root >= 0")
    links = found.where("NOT border").select(key("a").alias("a"), key("b").alias("b"))
    vertices = cores.select(key("root").alias("id"))
    if made.bulk:
        partner, between = bulk.partners(_per_leaf(cores.withColumn("v", F.col("idx")), leaves, kinds))
        ends = spark.createDataFrame(list({(m, s) for _, s, m in partner} | {(v, s) for s, a, b in between for v in (a, b)}), "idx long, s int")
        partner = spark.createDataFrame(partner, "leaf int, s int, mate long")  # at most leaves x settings rows
        between = spark.createDataFrame(between, "s int, a long, b long")
        ends = cores.join(F.broadcast(ends), ["idx", "s"])
        links = (links.unionByName(cores.join(F.broadcast(partner), ["leaf", "s"]).select(key("root").alias("a"), key("mate").alias("b")))
                 .unionByName(between.select(key("a").alias("a"), key("b").alias("b")))
                 .unionByName(ends.select(key("idx").alias("a"), key("root").alias("b"))))
        vertices = vertices.unionByName(ends.select(key("idx").alias("id")))
    comps = connected_components(vertices.distinct(), links.where("a <> b").distinct())
    comps = comps.withColumn("s", F.pmod("id", F.lit(kinds)).cast("int"))
    numbers = with_global_index(comps.select("s", "comp").distinct(), ["s", "comp"], "cluster", ["s"])
    # a component can hold a third of all points: its number goes to them by (root, salt)
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    of_root = materialise(comps.drop("s").withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALTS)))
                          .join(numbers.drop("s").withColumn("_salt", salted), ["comp", "_salt"])
                          .select("id", F.col("cluster").cast("int").alias("cluster"), salted.alias("_salt")))
    at_root = lambda rows: (rows.withColumn("id", key("root")).withColumn("_salt", F.pmod(F.hash("idx"), F.lit(SALTS)))
                            .join(of_root, ["id", "_salt"]))
    core_of = materialise(at_root(cores).select("idx", "s", "cluster"))
    touched = (rooted.select("idx", F.explode("near").alias("n")).select("idx", "n.s", "n.root")
               .unionByName(found.where("border").select(F.col("a").alias("idx"), "s", F.col("b").alias("root"))))
    offers = at_root(touched).select("idx", "s", "cluster")
    if made.bulk:
        at_leaf = core_of.join(rooted.select("idx", "leaf"), "idx").select("leaf", "s", F.col("cluster").alias("v"))
        near = spark.createDataFrame(bulk.borders(_per_leaf(at_leaf, leaves, kinds)), "leaf int, s int, cluster int")
        offers = offers.unionByName(rooted.select("idx", "leaf").join(F.broadcast(near), "leaf").select("idx", "s", "cluster"))
    border = offers.groupBy("idx", "s").agg(F.min("cluster").alias("cluster"))
    labels = (core_of.withColumn("is_core", F.lit(True))
              .unionByName(border.join(core_of, ["idx", "s"], "left_anti").withColumn("is_core", F.lit(False))))
    per_point = labels.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("cluster", "is_core")))).alias("got"))
    known = numbered.select("idx", "x", "w").join(per_point, "idx").select("x", "w", "got")
    # rows find their vector; vectors that very many rows share are few and go by broadcast
    heavy = F.col("w") > max(1000, everyone.count() // HEAVY_SHARE)
    known = materialise(known.withColumn("heavy", heavy))
    common = F.broadcast(known.where("heavy").select("x", F.col("got").alias("g1"), F.lit(True).alias("hot")))
    tagged = everyone.join(common, "x", "left")
    rest = (tagged.where("hot IS NULL").join(known.where("NOT heavy").select("x", "got"), "x", "left").select("id", "got")
            .unionByName(tagged.where("hot").select("id", F.col("g1").alias("got"))))
    mine = F.col("got")[F.col("setting.s")]
    return rest.select("id", "got", each).select(
        "setting.eps", "setting.min_samples", F.col("id").alias(id_col), F.coalesce(mine["cluster"], F.lit(-1)).alias("cluster"),
        F.coalesce(mine["is_core"], F.lit(False)).alias("is_core"))


def dbscan(points: DataFrame, eps: float, min_samples: int, id_col: str = "id", coords: str = "x",
           report: dict | None = None) -> DataFrame:
    """Labels ``(id, cluster, is_core)`` of one setting."""
    return dbscan_settings(points, ((eps, min_samples),), id_col, coords, report).drop("eps", "min_samples")


def dbscan_grid(points: DataFrame, settings=DEFAULT_GRID, id_col: str = "id", coords: str = "x") -> DataFrame:
    """Cluster and noise counts for several (eps, min_samples) settings."""
    c = F.col("cluster")
    return dbscan_settings(points, settings, id_col, coords).groupBy("eps", "min_samples").agg(
        F.count_distinct(F.when(c != -1, c)).cast("int").alias("n_clusters"),
        F.sum(F.when(c == -1, 1).otherwise(0)).cast("int").alias("n_noise"))


def dbscan_grid_profile(points: DataFrame, settings=DEFAULT_GRID, id_col: str = "id", coords: str = "x",
                        digits: int = 2) -> DataFrame:
    """Mean of every coordinate (``dim``) per setting and cluster, noise dropped."""
    labels = dbscan_settings(points, settings, id_col, coords).where("cluster <> -1")
    # the vector, not its coordinates, meets the labels: rows a coordinate exist only before the partial means
    long = labels.join(points.select(id_col, coords), id_col).select("eps", "min_samples", "cluster", F.posexplode(coords).alias("dim", "v"))
    scale = F.lit(float(10 ** digits))
    return (long.groupBy("eps", "min_samples", "cluster", "dim")
            .agg((F.floor(F.avg("v") * scale + F.lit(0.5)).cast("double") / scale).alias("mean")))
