"""Near-duplicate groups by min-max hashing.

Each document's set of distinct word shingles is hashed to 64 bits; under each of ``PERMUTATIONS`` linear
permutations both the smallest and the largest value are kept, so 64 evaluations give a signature of 128
values.  A band holds the minima and maxima of two permutations (4 values); documents that share a band are
candidates.  At the threshold similarity 0.8 a pair misses all 32 bands with probability (1 - 0.8**4)**32,
about 5e-8.

Links are confirmed on full sets, never on signatures:

1. Documents with the same set are one class (grouped by a 128-bit digest, map-side combined), named by the
   digest.  Copies are not expanded.  Classes that share an id are linked: they are one document.
2. ``HUB_ROUNDS`` times: each bucket of classes that are not all connected yet elects a hub by hash, and
   every other member is checked against it; confirmed links are joined into components.  A group of n near
   copies so costs about n checks, not n * n.
3. Buckets that still hold different components are checked exactly.  Classes that such buckets connect form a
   cluster.  A class can only have a link when the threshold's share of its shingles occurs in another class of its
   cluster; all others (texts that merely share a passage) leave here.  What remains is ordered by set size and cut
   into blocks of ``BLOCK``; pairs of blocks whose sizes allow a link are dealt by (cluster, i, j), and a task
   counts all intersections of its two blocks by one matrix product and returns only links that join two
   components.  No pair becomes a row, and no candidate pair between two components is left unchecked, so no link
   between different texts is lost.

Buckets are never collected: every step is a partial aggregate or a join dealt by (band, value) whose hot
keys Spark can split, and sets travel only for classes that are candidates.  What an exchange leaves is merged into
as many partitions as its counted rows need (``in_few``): the many small steps would else write more files than rows.

Defined cases: a null or empty text has an empty set, links with nothing and is its own component; a row with
a null id links with nothing, has a null component and is kept; rows that share an id are one document, which
has the links of all its texts; repeated rows get equal results; texts are taken whole; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import broadcast_if_small, cut, map_columns, small_batches, stage
from panelkit.operators.common import in_few
from panelkit.operators.dbscan import connected_components
from panelkit.operators.ranking import with_global_index

SHINGLE, SIMILARITY = 4, 80  # words; per cent
PERMUTATIONS, PER_BAND = 64, 2
HUB_ROUNDS = 2
BLOCK = 1024
SALTS = 8
SETS_A_TASK = 2048  # rows that carry whole sets
SEED = 20_240_229


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles (A-Z lower-cased; the whole sequence
    as one shingle when it is shorter)."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    mixed = np.zeros(len(words) - k + 1, np.uint64)
    for i, m in enumerate(_odd(k, SEED)):
        mixed += hashes[i:len(words) - k + 1 + i] * m
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


_MULTIPLY, _ADD = _odd(PERMUTATIONS, SEED + 1)[:, None], _odd(PERMUTATIONS, SEED + 2)[:, None]
_MIX = _odd(2 * PER_BAND, SEED + 3)
_BLOCK = 1024


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a non-empty set under each permutation: shape (2, PERMUTATIONS)."""
    low = high = None
    for i in range(0, len(values), _BLOCK):  # memory stays bounded for very long texts
        v = values[i:i + _BLOCK] * _MULTIPLY
        v += _ADD
        a, b = v.min(axis=1), v.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high])


def band_values(values: np.ndarray) -> np.ndarray:
    """One 64-bit value per band."""
    s = signature(values).reshape(2, PERMUTATIONS // PER_BAND, PER_BAND)
    out = np.zeros(PERMUTATIONS // PER_BAND, np.uint64)
    for i in range(PER_BAND):
        for j in range(2):
            out += s[j, :, i] * _MIX[2 * i + j]
            out ^= out >> np.uint64(31)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per row: ``doc``, ``n`` (set size), ``key`` (digest of the set, null if empty), ``bands``."""
    def run(**cols):
        out = {"doc": cols["doc"], "n": [], "key": [], "bands": []}
        for t in cols["text"]:
            s = shingle_set(t, k)
            out["n"].append(len(s))
            out["key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(band_values(s).view(np.int64) if len(s) else None)
        return out

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_columns(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), run,
                       f"doc {kind}, n long, key binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """Stored ``(key, words)`` of the wanted classes ``(id, doc)``: their whole sets, as sorted 64-bit hashes; the
    text is that of a document of the class."""
    texts = (docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
             .join(broadcast_if_small(wanted.select("doc"), n_wanted), "doc", "left_semi"))

    def run(text):
        sets = [shingle_set(t, k).tobytes() for t in text]
        return {"key": [xxhash.xxh3_128_digest(s) for s in sets], "words": sets}

    sets = map_columns(texts.select("text"), run, "key binary, words binary")
    return stage(sets.join(broadcast_if_small(wanted.select(F.col("id").alias("key")), n_wanted), "key", "left_semi")
                 .dropDuplicates(["key"]), "shingle-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs ``(a, b)`` whose full sets reach the threshold."""
    kind, n_pairs = pairs.schema["a"].dataType.simpleString(), pairs.count()
    one = in_few(pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a"), n_pairs, SETS_A_TASK)
    joined = (one
              .join(sets.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return in_few(joined, n_pairs, SETS_A_TASK).mapInArrow(check, f"a {kind}, b {kind}")


def _intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, exactly (float32 counts to 2**24)."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for i in range(0, len(shared), columns):
        part = shared[i:i + columns]
        sides = []
        for sets in (left, right):
            x = np.zeros((len(sets), len(part)), np.float32)
            for r, s in enumerate(sets):
                mine = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, mine)
                x[r, at[part[at] == mine]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _joining_links(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Two blocks of a cluster (or one with itself): links that join components, a forest of them."""
        rows = t.to_pydict()
        block = np.array(rows["block"])
        sides = [np.flatnonzero(block == b) for b in (rows["i"][0], rows["j"][0])]
        sets = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        size = np.array([len(x) for x in sets])
        left, right = sides
        found = []
        if len(left) and len(right):
            both = _intersections([sets[k] for k in left], [sets[k] for k in right])
            linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            parent: dict = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for p, q in zip(*np.nonzero(linked), strict=True):
                x, y = root(rows["comp"][left[p]]), root(rows["comp"][right[q]])
                if x != y:
                    parent[x] = y
                    found.append((rows["rep"][left[p]], rows["rep"][right[q]]))
        kind = t.schema.field("rep").type
        return pa.table({"a": pa.array([x for x, _ in found], kind), "b": pa.array([x for _, x in found], kind)})
    return run


def linkable(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The classes of ``named`` (cluster, rep, comp, n) of whose shingles enough occur in another class of their
    cluster: a link needs ``percent`` of the union, so of each set, in common."""
    kind = named.schema["cluster"].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes = np.array([len(w) // 8 for w in b.column("words").to_pylist()])
            rows = np.repeat(np.arange(b.num_rows), sizes)
            words = np.frombuffer(b"".join(b.column("words").to_pylist()), np.int64)
            for i in range(0, len(rows), 1 << 16):
                part = b.select(["cluster", "rep"]).take(pa.array(rows[i:i + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words[i:i + (1 << 16)])], ["cluster", "rep", "word"])

    words = (named.join(sets.withColumnRenamed("key", "rep"), "rep").select("cluster", "rep", "words")
             .mapInArrow(run, f"cluster {kind}, rep binary, word long"))
    common = words.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("cluster", "word")
    shared = words.join(common, ["cluster", "word"], "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    return stage(named.join(shared, "rep").where(100 * F.col("shared") >= percent * F.col("n")).drop("shared"), "linkable")


def block_links(named: DataFrame, sets: DataFrame, percent: int, block: int | None = None) -> DataFrame:
    """Links between components within each cluster of ``named`` (cluster, rep, comp, n)."""
    placed = with_global_index(named, ["cluster", "n", "rep"], "at", ["cluster"])
    placed = placed.withColumn("block", F.floor(F.col("at") / (block or BLOCK)).cast("int")).drop("at")
    spans = cut(placed.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    one = spans.select("cluster", F.col("block").alias("i"), F.col("hi").alias("hi_i"))
    other = spans.select("cluster", F.col("block").alias("j"), F.col("lo").alias("lo_j"))
    pairs = one.join(other, "cluster").where((F.col("i") <= F.col("j")) & (100 * F.col("hi_i") >= percent * F.col("lo_j"))).select("cluster", "i", "j")
    sides = pairs.withColumn("block", F.col("i")).unionByName(pairs.where("i < j").withColumn("block", F.col("j")))
    dealt = (placed.join(sides, ["cluster", "block"]).join(sets.withColumnRenamed("key", "rep"), "rep")
             .select("cluster", "i", "j", "block", "rep", "comp", "words").repartition("cluster", "i", "j"))
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_joining_links(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``."""
    rows = stage(sketches(docs, id_col, text_col, shingle), "sketches")
    known = rows.where("key IS NOT NULL AND doc IS NOT NULL")
    n_rows = rows.count()
    # a class is named by its set's digest; ``doc`` is its smallest id
    classes = stage(in_few(known.groupBy("key").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands")), n_rows)
                    .withColumnRenamed("key", "rep"), "classes")
    # classes of one document, where ids repeat with different texts
    texts_of = in_few(known.groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z"), n_rows).select("doc", "a")
    same_doc = cut(in_few(in_few(known.join(texts_of, "doc"), n_rows).where("key <> a").select("a", F.col("key").alias("b")).distinct(), n_rows))
    buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    n_buckets = classes.count() * (PERMUTATIONS // PER_BAND)
    spread = (buckets.groupBy("band", "value").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
              .select("band", "value"))
    members = stage(in_few(buckets.join(cut(in_few(spread, n_buckets)), ["band", "value"]), n_buckets), "buckets")
    n_members = members.count()
    ends = same_doc.select(F.col("a").alias("rep")).unionByName(same_doc.select(F.col("b").alias("rep")))
    vertices = cut(in_few(members.select("rep").unionByName(ends).distinct(), n_rows).withColumnRenamed("rep", "id"))
    n_vertices = vertices.count()
    small_batches(docs.sparkSession)
    wanted = in_few(members.select(F.col("rep").alias("id")).distinct(), n_vertices)
    wanted = cut(in_few(wanted.join(classes.select(F.col("rep").alias("id"), "doc"), "id"), n_vertices))
    sets = full_sets(docs, wanted, n_vertices, id_col, text_col, shingle)
    labels = vertices.select("id", F.col("id").alias("comp"))
    tried = None
    links = None if same_doc.isEmpty() else same_doc
    if links is not None:
        labels = cut(connected_components(vertices, links))

    def add(pairs: DataFrame):
        """Confirms new pairs and joins components; pairs whose sizes alone rule a link out are passed over."""
        nonlocal tried
        pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        pairs = in_few(pairs, n_members).distinct()
        if tried is not None:
            pairs = in_few(pairs, n_members).join(tried, ["a", "b"], "left_anti")
        pairs = stage(in_few(pairs, n_members), "pairs")
        if pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        join_up(stage(confirmed(pairs, sets, percent), "links"))

    def join_up(good: DataFrame):
        nonlocal links, labels
        links = good if links is None else links.unionByName(good)
        labels = cut(connected_components(vertices, links))

    def labelled() -> DataFrame:
        return in_few(members.join(labels, members["rep"] == labels["id"]).drop("id"), n_members)

    def ordered(x, nx, y, ny):
        first = F.col(x) < F.col(y)
        pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
        return [pick(x, y).alias("a"), pick(y, x).alias("b"), pick(nx, ny).alias("na"), pick(ny, nx).alias("nb")]

    for turn in range(HUB_ROUNDS):
        mixed = labelled()
        hubs = (mixed.groupBy("band", "value")
                .agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n")).alias("hub"),
                     F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                .where("lo <> hi").select("band", "value", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
        hubs = stage(in_few(hubs, n_members), "hubs")
        own = labels.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
        add(in_few(mixed.join(hubs, ["band", "value"]), n_members).join(own, "hub").where("comp <> hub_comp")
            .select(*ordered("rep", "n", "hub", "hub_n")))

    mixed = labelled()
    still = stage(in_few(mixed.groupBy("band", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), n_members)
                  .where("lo <> hi").select("band", "value"), "mixed")
    left = stage(in_few(mixed.join(still, ["band", "value"]), n_members), "left")
    n_left = left.count()
    # clusters: classes that mixed buckets connect
    star = in_few(left.groupBy("band", "value").agg(F.min("rep").alias("b")), n_left)
    star = in_few(left.join(cut(star), ["band", "value"]), n_left).select(F.col("rep").alias("a"), "b").distinct().where("a <> b")
    star = in_few(star, n_left)
    classes_left = cut(in_few(left.select("rep", "n", "comp").distinct(), n_left))
    clusters = connected_components(classes_left.select(F.col("rep").alias("id")), star)
    named = cut(in_few(classes_left.join(clusters.select(F.col("id").alias("rep"), F.col("comp").alias("cluster")), "rep"), n_left))
    open_classes = linkable(named, sets, percent)
    if not open_classes.isEmpty():
        join_up(stage(block_links(open_classes, sets, percent), "block-links"))

    # a component's name is the smallest id of its classes
    placed = in_few(classes.select("rep", "doc").join(labels.withColumnRenamed("id", "rep"), "rep"), n_rows)
    names = placed.groupBy("comp").agg(F.min("doc").alias("name"))
    names = in_few(names, n_rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a component can be a third of all
    named = (placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).join(names, ["comp", "salt"]).select("rep", "name"))
    named = (in_few(classes.select("rep", "doc").join(in_few(named, n_rows), "rep", "left"), n_rows)
             .select(F.col("rep").alias("key"), F.coalesce("name", "doc").alias("comp")))
    return (rows.join(named, "key", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
