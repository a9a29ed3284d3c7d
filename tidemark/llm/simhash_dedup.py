"""SimHash near-duplicates: fingerprints, links within a Hamming radius, groups.

Method: a binary trie joined with itself.  Node pairs are traversed together,
differing bits are added up, and a pair whose sum exceeds the radius is pruned.
To spread the trie over tasks, five rotations of the fingerprint give five tries;
two fingerprints within four bits agree on at least one of the five disjoint
blocks, so in one rotation they lie under the same top node, and each task joins
the subtrees of its own top nodes only.  A top node with over ``SPLIT``
fingerprints is dealt again, in the same way, by blocks of its remaining bits.

Tasks report links that span what is connected, never all pairs.  Groups are then
found by alternating large-star and small-star steps on the links; every step is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, discarded, each_part, normal, part_of, parts_held, small_batches, unboxed, written

RADIUS = 4
BLOCKS = (0, 13, 26, 39, 52)  # where the blocks start; the first HEAD bits of each are the key
HEAD = 12
SUB_BLOCKS, SUB_HEAD = (0, 10, 20, 30, 40), 10  # within the 52 bits below the key
SPLIT = 20_000
SALT = 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the text, unsigned."""
    whole, at = normal(text.lower())
    w = len(at) - 1
    if not w:
        return 0
    n = max(1, w - shingle + 1)
    start, end = at[:n], at[min(shingle, w) :] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(whole[a:z], 42) for a, z in zip(start[k : k + (1 << 15)].tolist(), end[k : k + (1 << 15)].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py() or b"") for t in text.cast(pa.binary())], np.uint64).view(np.int64))


# --- the trie, one rotation at a time ---------------------------------------------


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        parent[i] = parent[up]
        i = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def trie_links(keys: np.ndarray, depth: int, radius: int = RADIUS, leaf: int = 64, most: int = 1 << 16) -> np.ndarray:
    """For each of the sorted distinct ``keys`` (uint64) the position of the least
    key that links connect it with; only keys with equal first ``depth`` bits are
    compared.

    A first pass within one bit joins what lies close together; the full pass then
    also prunes node pairs that are connected throughout, so a dense group of near
    copies does not cost the square of its size.
    """
    parent = np.arange(len(keys))
    for near in sorted({min(1, radius), radius}):
        _traverse(keys, parent, depth, near, leaf, most)
    return _roots(parent, np.arange(len(keys)))


def _traverse(keys: np.ndarray, parent: np.ndarray, depth: int, radius: int, leaf: int, most: int) -> None:
    root = _roots(parent, np.arange(len(keys)))
    changes = np.zeros(len(keys) + 1, np.int32)
    np.cumsum(root[1:] != root[:-1], out=changes[1 : len(keys)])  # equal at two places: one group in between
    head = keys >> np.uint64(64 - depth)
    lo = np.flatnonzero(np.append(True, head[1:] != head[:-1])).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
    hi = np.append(lo[1:], np.int32(len(keys))).astype(np.int32)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(63 - depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, a, b, c, d, gone = stack.pop()
        if len(a) > most:
            for k in range(0, len(a), most):
                stack.append((bit, *(x[k : k + most].copy() for x in (a, b, c, d, gone))))
            continue
        joined = (changes[a] == changes[b - 1]) & (changes[c] == changes[d - 1]) & (root[a] == root[c])
        small = ((b - a).astype(np.int64) * (d - c) <= leaf) & ~joined
        if bit < 0:
            small = ~joined
        if small.any():
            _compare(keys, parent, *(x[small].astype(np.int64) for x in (a, b, c, d)), radius)
        big = ~small & ~joined
        if not big.any():
            continue
        a, b, c, d, gone = a[big], b[big], c[big], d[big], gone[big]
        step = np.uint64(1) << np.uint64(bit)
        above = ~((step << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        m = np.clip(np.searchsorted(keys, (keys[a] & above) | step), a, b).astype(np.int32)
        n = np.clip(np.searchsorted(keys, (keys[c] & above) | step), c, d).astype(np.int32)
        same = (a == c) & (b == d)
        every = np.ones(len(a), bool)
        pairs = (
            (a, m, c, n, gone, every),
            (m, b, n, d, gone, every),
            (a, m, n, d, gone + 1, every),
            (m, b, c, n, gone + 1, ~same),  # of a node and itself, the mirror image is the pair above
        )
        out: tuple[list, ...] = ([], [], [], [], [])
        for p, q, r, s, g, ok in pairs:
            ok = ok & (q > p) & (s > r) & (g <= radius) & ~((p == r) & (q == s) & (q - p == 1))
            for x, y in zip(out, (p, q, r, s, g)):
                x.append(y[ok])
        stack.append((bit - 1, *(np.concatenate(x) for x in out)))


def _compare(keys, parent, a, b, c, d, radius, most: int = 1 << 18) -> None:
    """Links between all keys of small node pairs, a slice of the pairs at a time."""
    size = (b - a) * (d - c)
    upto = np.cumsum(size)
    k = 0
    while k < len(a):
        done = upto[k - 1] if k else 0
        z = max(k + 1, int(np.searchsorted(upto, done + most, "right")))
        n, w = size[k:z], (d - c)[k:z]
        row = np.repeat(np.arange(z - k), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[k:z][row] + at // w[row], c[k:z][row] + at % w[row]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= radius
        near &= i != j
        _unite(parent, i[near], j[near])
        k = z


_LINKS = "u long, v long"


def _join_tries():
    """Links between the fingerprints of a partition sorted by (part, turned)."""

    def links(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        part, key, fp = (t.column(c).to_numpy() for c in ("part", "turned", "fp"))
        for p in np.unique(part):
            mine = part == p
            root = trie_links(key[mine].view(np.uint64) ^ np.uint64(1 << 63), HEAD + SUB_HEAD * (p >= len(BLOCKS)))
            f = fp[mine]
            ok = root != np.arange(len(f))
            yield pa.RecordBatch.from_arrays([pa.array(f[ok]), pa.array(f[root[ok]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            part, head = b.column("part").to_numpy(), b.column("head").to_numpy()
            if held and size > 1 << 19 and (held[-1].column("part")[-1].as_py(), held[-1].column("head")[-1].as_py()) != (part[0], head[0]):
                yield from links(held)
                held, size = [], 0
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (head[1:] != head[:-1])) + 1
            if held and size > 1 << 19 and len(cuts):
                yield from links([*held, b.slice(0, int(cuts[0]))])
                b, held, size = b.slice(int(cuts[0])), [], 0
            held.append(b)
            size += b.num_rows
        if held:
            yield from links(held)

    return run


def _turn(x, by: int, width: int = 64):
    """The lowest ``width`` bits of x, rotated left."""
    if by == 0:
        return x
    low = F.shiftrightunsigned(x, width - by)
    return (F.shiftleft(x, by) if width == 64 else F.shiftleft(x, by).bitwiseAND(F.lit((1 << width) - 1))).bitwiseOR(low)


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints of column ``fp`` exactly
    as all pairs within ``RADIUS`` bits do."""
    key = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _turn(F.col("fp"), b).alias("turned")) for p, b in enumerate(BLOCKS)]))
    first = fps.select("fp", key.alias("k")).select("fp", "k.part", "k.turned").withColumn("head", F.shiftrightunsigned("turned", 64 - HEAD))
    crowds = first.groupBy("part", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("part", "head", F.lit(True).alias("crowd"))
    first = first.join(crowds, ["part", "head"], "left")
    width = 64 - HEAD
    below = F.col("turned").bitwiseAND(F.lit((1 << width) - 1))
    top = F.col("turned").bitwiseXOR(below)
    key = F.explode(F.array(*[F.struct((F.col("part") * len(SUB_BLOCKS) + (len(BLOCKS) + s)).alias("part"), top.bitwiseOR(_turn(below, b, width)).alias("turned")) for s, b in enumerate(SUB_BLOCKS)]))
    again = first.where("crowd").select("fp", key.alias("k")).select("fp", "k.part", "k.turned").withColumn("head", F.shiftrightunsigned("turned", 64 - HEAD - SUB_HEAD))
    dealt = first.where("crowd is null").select("fp", "part", "turned", "head").unionByName(again)
    return dealt.repartition("part", "head").sortWithinPartitions("part", "turned").mapInArrow(_join_tries(), _LINKS)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root): every linked node with the least node it is connected with.

    Large-star and small-star steps in turn, until the links stay as they are; a
    step joins each node's links with their minimum, so that a node with many links
    is one row on one side and can be split on the other.
    """
    edges, before = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discarded(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError("the links did not settle")


def fingerprints(docs: DataFrame, text_col: str = "text") -> Column:
    """SimHash of a text column as a signed long."""
    return F.arrow_udf(_fingerprints, "long")(F.col(text_col).cast("string"))


def groups_of(rows: DataFrame, split: int = SPLIT) -> DataFrame:
    """(fp, component_id, held) for each distinct ``fp`` of stored (_id, fp, _part)."""
    nodes = rows.groupBy("fp").agg(F.min("_id").alias("least"), parts_held(F.col("_part")).alias("held"))
    roots = components(links(nodes.select("fp"), split))
    linked = nodes.join(roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct()), F.col("fp") == F.col("u")).select("fp", "least", "root")
    # a group may hold a third of all fingerprints, so its rows are dealt to SALT slices
    slice_ = F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int").alias("_salt")
    least = linked.groupBy("root", slice_).agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    joined = linked.select("fp", "root", slice_).join(least, ["root", "_salt"]).select("fp", "component_id", F.lit(True).alias("_linked"))
    # fingerprints without a link are groups of their own
    return nodes.join(joined, "fp", "left").select("fp", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "held")


def _grouped(rows: DataFrame, split: int) -> DataFrame:
    """Stored ``rows`` (_id, fp, ...) with their component_id.  A fingerprint may be that of
    very many copies, so its rows are dealt in SALT parts."""
    rows = rows.withColumn("_part", part_of(SALT, *rows.columns))
    groups = groups_of(rows, split).select("fp", "component_id", each_part("held", SALT).alias("_part"))
    return rows.join(groups, ["fp", "_part"]).drop("_part")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(id_col, fingerprint long, component_id): one row per row of ``docs``, whose other
    columns may have any name.

    ``component_id`` is the smallest id that links reach, the row's own included; ids may
    be of any type that has an order.  Null and empty texts have fingerprint zero and are
    linked like any other; very long texts are read whole, a part at a time.  Rows
    without an id take part; their group's id is null only if no member has one.
    Repeated rows get equal results; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col(id_col).alias("_id"), fingerprints(docs, text_col).alias("fp")), "fingerprints")
    return _grouped(rows, split).select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """``docs`` without the rows of a group but one: that with the smallest id, of rows
    with that id the one with the least digest of its columns, so that reruns agree.
    Rows without an id stay if their whole group has none, equal ones once.

    Ids, digests (of 128 bits) and fingerprints decide; the texts travel once, to the
    join with the decision.  Column names are free; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    every = [*cols, *[c.isNull() for c in cols]]
    d = boxed(docs, _id=F.col(id_col), fp=fingerprints(docs, text_col), _k=F.xxhash64(*every), _l=F.xxhash64(F.lit(1), *every))
    rows = written(d.select("_id", "fp", "_k", "_l"), "fingerprints")
    best = _grouped(rows, split).where(F.col("_id").eqNullSafe(F.col("component_id")))
    one = best.where("_id is not null").groupBy("_id").agg(F.min(F.struct("_k", "_l")).alias("k")).select("k._k", "k._l")
    stays = one.unionByName(best.where("_id is null").select("_k", "_l").distinct()).withColumn("_stays", F.lit(True))
    # one shuffle of the texts serves the join and the choice among equal rows
    kept = d.select("_row", "_k", "_l").join(stays, ["_k", "_l"])
    return unboxed(kept.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_l").orderBy("_k"))).where("_n = 1"))


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
