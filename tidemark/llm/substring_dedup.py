"""Removal of word windows that an earlier document already has.

A window is ``window`` consecutive words of one document.  A word goes if any
window that covers it has the same words as a window of a document with a
smaller id.  Windows are judged on the input.

Method: super-k-mer partitioning.  The minimiser of a window is the least hash of
its ``MER``-word runs; consecutive windows with one minimiser are one super-k-mer,
packed as the string of its words.  Equal windows have equal minimisers, so

1.  minimisers alone (no text) are counted; one that a single document has cannot
    hold a shared window, and its text never travels;
2.  the packed strings of the others go to the bucket of their minimiser, where
    exact ranks of word runs are built by sorting and give, for every distinct
    window, the least document id;
3.  minimisers with over ``HOT`` super-k-mers would make a large bucket.  Their windows
    are cut again under a longer minimiser (``LONG_MER`` words), which tells apart
    passages that have but a few words in common, and those pieces go to their buckets
    as packed strings too;
4.  what is over ``HOT`` even then is a passage that very many documents share.  There
    the minimiser is the whole window, a super-k-mer is one window, and a bucket holds
    copies of one string: a 128-bit BLAKE2b digest stands for it, counted with partial
    aggregation before the shuffle.
    All ways count all windows.

Documents are shuffled by id, once; nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, WordBlock, each_part, mix, normal, overlapping, part_of, parts_held, row_spans, small_batches, string_buffers

MER, LONG_MER = 8, 32
HOT = 1024
SALTS = 32  # parts, at most 63, of a minimiser or digest that very many documents have
LONGEST = 256


def _minimisers(block: WordBlock, window: int, most: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer; windows
    are numbered by their first word in the block."""
    h, size = block.hashes, 1
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    mer = 1
    while mer * 2 <= min(most, window):
        mer *= 2
    while size < mer:
        h = mix(h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:])
        size *= 2
    span, size = window - mer + 1, 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if span > size:
        h = np.minimum(h[: len(h) - (span - size)], h[span - size :])
    last = np.repeat(block.first[1:], np.diff(block.first))[: len(h)]
    valid = np.flatnonzero(np.arange(len(h)) + window <= last)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    m = h[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (m[1:] != m[:-1]) | (valid[1:] != valid[:-1] + 1) | (last[valid][1:] != last[valid][:-1])
    at = np.flatnonzero(new)
    inside = np.arange(len(valid)) - np.repeat(at, np.diff(np.append(at, len(valid))))
    at = np.flatnonzero(inside % LONGEST == 0)
    return valid[at], np.diff(np.append(at, len(valid))), m[at]


_LIGHT = "mini long, _id long, _key long, start int, n int"


def _light(window: int):
    """Rows of super-k-mers without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("_id").to_numpy(zero_copy_only=False), b.column("_key").to_numpy(zero_copy_only=False)
            data, offsets = string_buffers(b.column("_text"))
            for lo, hi in row_spans(offsets):
                d = data[offsets[lo] : offsets[hi]]
                parts = overlapping(d, window - 1) if len(d) > LONG and hi - lo == 1 else [(0, WordBlock(d, offsets[lo : hi + 1] - offsets[lo]), True)]
                for word, block, _ in parts:
                    first, n, mini = _minimisers(block, window)
                    row = np.searchsorted(block.first, first, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini.view(np.int64)), pa.array(ids[lo + row]), pa.array(keys[lo + row]), pa.array((word + first - block.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["mini", "_id", "_key", "start", "n"],
                    )

    return run


def _again(window: int, most: int = 1 << 20):
    """Rows like those of ``_light`` for the marked super-k-mers, under longer minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, i, k, marks in zip(b.column("_text").cast(pa.binary()), b.column("_id").to_pylist(), b.column("_key").to_pylist(), b.column("marks")):
                whole, at = normal(text.as_py())
                parts, starts, size = [], [], 0
                for m in marks.as_py():
                    parts.append(whole[at[m["start"]] : at[m["start"] + m["n"] + window - 1] - 1])
                    starts.append(m["start"])
                    size += len(parts[-1])
                    if size > most:
                        yield cut(parts, starts, i, k)
                        parts, starts, size = [], [], 0
                yield cut(parts, starts, i, k)

    def cut(parts: list[bytes], starts: list[int], i: int, k: int) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, parts)])
        block = WordBlock(np.frombuffer(b"".join(parts), np.uint8), offsets)
        first, n, mini = _minimisers(block, window, LONG_MER)
        row = np.searchsorted(block.first, first, "right") - 1
        start = np.array(starts, np.int64)[row] + first - block.first[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(mini.view(np.int64)), pa.array([i] * len(n), pa.int64()), pa.array([k] * len(n), pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
            ["mini", "_id", "_key", "start", "n"],
        )

    return run


_PACKED = "mini long, _id long, _key long, start int, n int, packed binary"


def _cut(window: int):
    """Packed strings of the marked super-k-mers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for text, i, k, marks in zip(b.column("_text").cast(pa.binary()), b.column("_id").to_pylist(), b.column("_key").to_pylist(), b.column("marks")):
                whole, at = normal(text.as_py())
                for m in marks.as_py():
                    packed = whole[at[m["start"]] : at[m["start"] + m["n"] + window - 1] - 1]
                    for c, v in zip(out, (m["mini"], i, k, m["start"], m["n"], packed)):
                        c.append(v)
                    size += len(packed)
                if size > 1 << 21:
                    yield _batch(out)
                    out, size = [[], [], [], [], [], []], 0
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["mini", "_id", "_key", "start", "n", "packed"])

    return run


_DIGESTS = "digest binary, _id long, _key long, starts array<int>"


def _digests(window: int):
    """One row per document and distinct window of its marked super-k-mers: the
    digest of the window's words, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, i, k, marks in zip(b.column("_text").cast(pa.binary()), b.column("_id").to_pylist(), b.column("_key").to_pylist(), b.column("marks")):
                whole, at = normal(text.as_py())
                found: defaultdict = defaultdict(list)
                for m in marks.as_py():
                    for s in range(m["start"], m["start"] + m["n"]):
                        found[hashlib.blake2b(whole[at[s] : at[s + window] - 1], digest_size=16).digest()].append(s)
                for c, v in zip(out, (found.keys(), [i] * len(found), [k] * len(found), found.values())):
                    c += v
                if len(out[0]) > 10_000:
                    yield _batch(out)
                    out = [[], [], [], []]
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["digest", "_id", "_key", "starts"])

    return run


def _ranks(words: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers at two positions if and only if the ``window`` words that
    start there are equal: ranks of longer and longer runs, each made by sorting
    packed ranks of shorter ones.  Positions whose run leaves the array get -1."""
    rank, size = words.astype(np.int64), 1
    while size < window:
        bits = max(1, int(rank.max()).bit_length()) if len(rank) else 1
        parts = max(2, min(63 // bits, -(-window // size)))
        longer = min(window, parts * size)
        n = len(rank) - (longer - size)
        if n <= 0:
            return np.full(len(words), -1, np.int64)
        key = np.zeros(n, np.int64)
        for p in range(parts):
            shift = min(p * size, longer - size)  # the last part may overlap the one before it
            key = (key << bits) | rank[shift : shift + n]
        _, rank = np.unique(key, return_inverse=True)
        size = longer
    return np.append(rank, np.full(len(words) - len(rank), -1, np.int64))


_SPANS = "_id long, _key long, lo int, hi int"


def _bucket(window: int, most: int = 1 << 20):
    """Spans of repeated words, from packed strings sorted by minimiser."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        ids, keys = t.column("_id").to_numpy(), t.column("_key").to_numpy()
        start, n = t.column("start").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64)
        number: defaultdict = defaultdict(count().__next__)
        total = int((n + window - 1).sum())
        codes = np.fromiter((number[w] for p in t.column("packed") for w in p.as_py().split(b" ")), np.int64, total)
        rank = _ranks(codes, window)
        base = np.cumsum(n + window - 1) - (n + window - 1)
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mine = rank[base[row] + inside]
        least = np.full(int(mine.max()) + 1 if len(mine) else 1, np.iinfo(np.int64).max)
        np.minimum.at(least, mine, ids[row])
        hit = np.flatnonzero(ids[row] > least[mine])
        if not len(hit):
            return pa.RecordBatch.from_arrays([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["_id", "_key", "lo", "hi"])
        r, s = row[hit], (start[row] + inside)[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(hit)) - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[r[a]]), pa.array(keys[r[a]]), pa.array(s[a].astype(np.int32)), pa.array((s[z] + window).astype(np.int32))], ["_id", "_key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            mini = b.column("mini").to_numpy()
            _, off = string_buffers(b.column("packed"))
            cuts = np.flatnonzero(mini[1:] != mini[:-1]) + 1  # a minimiser's rows stay together
            lo = 0
            if held and held[-1].column("mini")[-1].as_py() != mini[0] and size > most:
                yield spans(held)
                held, size = [], 0
            for c in cuts.tolist():
                if size + off[c] - off[lo] > most:
                    yield spans([*held, b.slice(lo, c - lo)])
                    held, size, lo = [], 0, c
            held.append(b.slice(lo))
            size += int(off[-1] - off[lo])
        if held:
            yield spans(held)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _has, _text, _rest).  Neither key is ever null, so that the joins
    below put no filter of their own on the documents and one shuffle of the texts
    serves them all; ``_key`` tells rows with one id and different texts apart."""
    i, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "dedup")])
    return docs.select(F.coalesce(i, F.lit(0)).alias("_id"), F.xxhash64(text, i.isNull()).alias("_key"), (i.isNotNull() & text.isNotNull()).alias("_has"), text.alias("_text"), rest.alias("_rest"))


def repeated_spans(d: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """(_id, _key, lo, hi): word ranges of a document that a document with a smaller
    id has too, from rows made by ``_keyed``.  Rows without id or text have none."""
    light = d.where("_has").select("_id", "_key", "_text").mapInArrow(_light(window), _LIGHT)
    d = d.drop("_has")  # as below, where the texts are needed once more: the same columns, so the same shuffle

    # a minimiser or digest that very many documents have is dealt in parts by document, so
    # that no shuffle brings all of its rows together
    part = part_of(SALTS, "_id", "_key")

    def marks(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("part", part)
        held = parts_held(F.col("part")).alias("held")
        shared = rows.groupBy("mini").agg(F.count(F.lit(1)).alias("rows"), F.min("_id").alias("a"), F.max("_id").alias("z"), held).where("a < z")
        shared = shared.select("mini", (F.col("rows") > hot).alias("hot"), each_part("held", SALTS).alias("part"))
        return rows.join(shared, ["mini", "part"]).groupBy("_id", "_key", "hot").agg(F.collect_set(F.struct("start", "n", "mini")).alias("marks"))

    def marked(found: DataFrame) -> DataFrame:
        return d.join(found.drop("hot"), ["_id", "_key"])

    short = marks(light)
    long = marks(marked(short.where("hot")).mapInArrow(_again(window), _LIGHT))
    calm = marked(short.where("not hot").unionByName(long.where("not hot"))).mapInArrow(_cut(window), _PACKED)
    calm = calm.repartition("mini").sortWithinPartitions("mini").mapInArrow(_bucket(window), _SPANS)
    each = marked(long.where("hot")).mapInArrow(_digests(window), _DIGESTS).withColumn("part", part)
    parts = each.groupBy("digest", "part").agg(F.min("_id").alias("a"), F.max("_id").alias("z"))
    owner = parts.groupBy("digest").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.collect_list("part").alias("parts")).where("a < z")
    burnt = each.join(owner.select("digest", "a", F.explode("parts").alias("part")), ["digest", "part"]).where("_id > a")
    burnt = burnt.select("_id", "_key", F.explode("starts").alias("lo")).withColumn("hi", F.col("lo") + window)
    return calm.unionByName(burnt)


_KEPT = "struct<n_words:long,n_removed:long,kept:string>"


def _keep(text: pa.Array, spans: pa.Array) -> pa.Array:
    counts, gone, kept = [], [], []
    for t, s in zip(text.cast(pa.binary()), spans):
        whole, at = normal(t.as_py() or b"")
        n, s = len(at) - 1, s.as_py()
        out, removed = [whole], 0
        if s:
            out, end = [], 0
            for x in [*sorted(s, key=lambda x: (x["lo"], x["hi"])), {"lo": n, "hi": n}]:
                if x["lo"] > end:
                    out.append(whole[at[end] : at[x["lo"]] - 1])
                    removed -= x["lo"] - end
                end = max(end, x["hi"])
            removed += n
        counts.append(n)
        gone.append(removed)
        kept.append(b" ".join(out))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` with the columns ``dedup.n_words``, ``dedup.n_removed`` and
    ``dedup.kept`` (the words that stay, joined by one space) in one struct
    ``dedup``; an input column of that name is replaced.

    Null text: no words, ``kept`` empty.  Texts shorter than a window lose
    nothing; very long ones are read whole, a part at a time.  Rows with one id never
    remove each other's words; rows without an id are left alone.  Ids are integers
    (others raise).  Other columns pass through under any name; an empty table gives an
    empty one.
    """
    small_batches(docs.sparkSession)
    d = _keyed(docs, id_col, text_col)
    spans = repeated_spans(d, window, hot).groupBy("_id", "_key").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    out = d.join(spans, ["_id", "_key"], "left").select("_rest", "_text", F.arrow_udf(_keep, _KEPT)("_text", "_spans").alias("dedup"))
    return out.select(*[(F.col("_text") if c == text_col else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns if c != "dedup"], "dedup")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
        FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50),
own AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN own USING (k), unnest(generate_series(0, 49)) AS s(j)
        WHERE win.doc_id > first_doc),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS g,
         CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(ps, i)] END AS k
         FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
