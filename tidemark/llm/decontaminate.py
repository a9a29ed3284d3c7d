"""Benchmark items inside documents.

Words are compared bare: lower case, without ASCII punctuation.  The shingles of a
text are its runs of ``SHINGLE`` words (of a shorter text, the whole of it); the
similarity of two texts is the weighted Jaccard of their shingles, each weighing as
often as it occurs.  An item is in a document if a window of as many words as the
item has reaches ``SIMILARITY``.

Method: SimHash of item-sized windows.  Every window that holds at least one shingle
of an item of its size gets a fingerprint (the similarity of any other window is
zero, so none is lost).  Fingerprints of items stand in multi-index tables of eight
8-bit blocks: two fingerprints within ``RADIUS`` = 15 bits differ by at most one bit
in some block, and each item is entered under its block value and the eight values
one bit away, so that one look-up for each block finds all of them.  Candidates
within the radius are then verified with the exact similarity.

At similarity 0.8 about ten of 64 bits differ, with a standard deviation of three, so
some pairs above the threshold lie beyond the radius.  The shingles that windows share
with each item not found whole are therefore counted as well: the similarity fixes how
many they must share at least, so every pair that reaches the threshold is found.

Documents are scanned once and not shuffled.  Items are broadcast in blocks of at
most ``BLOCK_BYTES`` of text, one scan of the documents for each block.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE, LONG, WordBlock, mix, overlapping, row_spans, small_batches, string_buffers

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCK_BYTES = 8 << 20  # of items' text; an index is about ten times as large
_SIEVE = 20
_BAGS = 4096  # of items, kept by a worker
_STEP = 4096


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words."""
    out = h
    for j in range(1, k):
        out = mix(out[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[j:])
    return out


def _simhash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """SimHash of hashes[lo[i]:hi[i]] for each i."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    ones = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    return np.packbits(2 * (ones[hi] - ones[lo]) > (hi - lo)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def bare_words(text: str) -> list[bytes]:
    return pc.utf8_lower(pa.scalar(text)).as_py().encode().translate(bytes(32 if BARE[b] else b for b in range(256))).split()


def bag(words: list[bytes]) -> Counter:
    k = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items())
    every = a.total() + b.total() - both
    return both / every if every else 0.0


class Index:
    """Items by the shingles they hold and by the blocks of their fingerprints.

    All tables are sorted arrays: about 290 bytes for each item and 45 for each of its
    shingles, so the index is of the order of ten times the text of its items.  Bags of
    shingles are made from an item's words when a candidate is verified.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, sizes, prints = [], [], [], []
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, text in items:
            words = bare_words(text or "")
            if not words:
                continue
            data = np.frombuffer(b" ".join(words), np.uint8)
            h = WordBlock(data, np.array([0, len(data)])).hashes
            runs = _runs(h, min(SHINGLE, len(words)))
            keys, times = np.unique(runs, return_counts=True)
            held[len(words)].append((keys, np.full(len(keys), len(self.ids), np.int32), times.astype(np.int32)))
            self.ids.append(i)
            self.words.append(data.tobytes())
            sizes.append(len(words))
            prints.append(int(_simhash(runs, np.array([0]), np.array([len(runs)]))[0]))
        self.size, self.prints = np.array(sizes, np.int64), np.array(prints, np.uint64)
        #: by size: for each block and value, the items under it (a value's own and those one bit away)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        near = np.append(0, 1 << np.arange(8)).astype(np.uint64)
        for size in held:
            n = np.flatnonzero(self.size == size).astype(np.int32)
            self.tables[size] = []
            for block in range(8):
                values = (((self.prints[n] >> np.uint64(8 * block)) & np.uint64(255))[:, None] ^ near).ravel()
                order = np.argsort(values, kind="stable")
                self.tables[size].append((np.searchsorted(values[order], np.arange(257, dtype=np.uint64)), np.repeat(n, 9)[order]))
        #: by size: shingles, where the holders of each begin, and which item holds it how often
        self.holders = {}
        for size, parts in held.items():
            key, item, times = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.holders[size] = (keys, np.r_[first, len(order)], item[order], times[order])
        #: by words in a shingle: shingles, where the sizes of items that hold each begin, and the sizes
        self.anchors = {}
        for k in {min(SHINGLE, size) for size in held}:
            own = [(self.holders[size][0], size) for size in sorted(held) if min(SHINGLE, size) == k]
            key, of = np.concatenate([x for x, _ in own]), np.concatenate([np.full(len(x), size, np.int32) for x, size in own])
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[keys & np.uint64((1 << _SIEVE) - 1)] = True
            self.anchors[k] = (keys, np.r_[first, len(order)], of[order], sieve)
        self._bags: dict[int, Counter] = {}

    def bag(self, n: int) -> Counter:
        if n not in self._bags:
            if len(self._bags) >= _BAGS:
                self._bags.clear()
            self._bags[n] = bag(self.words[n].split(b" "))
        return self._bags[n]

    def candidates(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) within the radius, for items of ``size`` words."""
        out = []
        for part in range(0, len(prints), _STEP):
            f = prints[part : part + _STEP]
            found = []
            for block, (first, items) in enumerate(self.tables[size]):
                v = ((f >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)
                many = first[v + 1] - first[v]
                w = np.repeat(np.arange(len(f)), many)
                n = items[np.repeat(first[v] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
                near = np.bitwise_count(self.prints[n] ^ f[w]) <= RADIUS
                found.append(w[near] * np.int64(len(self.ids)) + n[near])
            pairs = np.unique(np.concatenate(found))
            out += zip((part + pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist())
        return out

    def shared(self, places: np.ndarray, hashes: np.ndarray, size: int, n_shingles: int, lo: int, hi: int, threshold: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, [(shared shingles, first word)], the most first), for items of ``size``
        words and windows of ``n_shingles`` that begin in [lo, hi] and share enough.

        ``places`` ascend and hold all shingles of those windows that an item of the size
        has.  The j-th place adds to the windows from it back to the one that already
        has the shingle as often as the item, so each adds an interval of windows.
        """
        total = size - min(SHINGLE, size) + 1
        need = max(1, math.ceil(threshold * (n_shingles + total) / (1 + threshold) - 1e-9))
        if len(places) < need:
            return
        full = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < n_shingles)
        if not len(full):
            return
        cover = np.zeros(len(places) + 1, np.int64)
        np.add.at(cover, full, 1)
        np.add.at(cover, full + need, -1)
        inside = np.cumsum(cover)[:-1] > 0
        places, hashes = places[inside], hashes[inside]
        keys, first, holder, times = self.holders[size]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a in range(lo, hi + 1, _STEP):
            z = min(a + _STEP - 1, hi)
            here = slice(*np.searchsorted(places, [a, z + n_shingles]))
            p, at = places[here], np.searchsorted(keys, hashes[here])
            many = first[at + 1] - first[at]
            if not len(p):
                continue
            entry = np.repeat(first[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            p, item = np.repeat(p, many), holder[entry]
            _, which, hits = np.unique(item, return_inverse=True, return_counts=True)
            p, item, entry = (x[hits[which] >= need] for x in (p, item, entry))
            order = np.lexsort((p, entry))  # an entry is one shingle of one item
            p, item, entry = p[order], item[order], entry[order]
            before = np.arange(len(p)) - times[entry]
            same = (before >= 0) & (entry[before] == entry)
            begin = np.maximum(np.maximum(p - n_shingles + 1, a), np.where(same, p[before] + 1, a))
            end = np.minimum(p, z)
            good = begin <= end
            item, begin, end = item[good], begin[good], end[good]
            who, at, step = np.r_[item, item], np.r_[begin, end + 1], np.repeat([1, -1], len(item))
            order = np.lexsort((at, who))
            who, at, n = who[order], at[order], np.cumsum(step[order])
            last = np.r_[(who[1:] != who[:-1]) | (at[1:] != at[:-1]), True] if len(who) else np.zeros(0, bool)
            for i, s, x in zip(who[last & (n >= need)].tolist(), at[last & (n >= need)].tolist(), n[last & (n >= need)].tolist()):
                found[i].append((x, s))
        for i, windows in found.items():
            yield i, sorted(windows, key=lambda w: (-w[0], w[1]))


def _windows(index: Index, block: WordBlock, threshold: float, whole: bool = True) -> Iterator[tuple[int, int, tuple]]:
    """(row, number of the item, (- similarity, first word, last word + 1)), the best window
    of each item.  A row shorter than an item is compared as it is, but not so where the
    rows are parts of a text (``whole`` is false)."""
    by_row: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    runs = {}
    for k, (keys, of, sizes, sieve) in index.anchors.items():
        if len(block.hashes) < k:
            continue
        runs[k] = s = _runs(block.hashes, k)
        maybe = np.flatnonzero(sieve[s & np.uint64((1 << _SIEVE) - 1)])
        at = np.searchsorted(keys, s[maybe])
        hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == s[maybe])
        maybe, at = maybe[hit], at[hit]
        row = np.searchsorted(block.first, maybe, "right") - 1
        inside = maybe + k <= block.first[row + 1]
        for p, a, r in zip(maybe[inside].tolist(), at[inside].tolist(), row[inside].tolist()):
            for size in sizes[of[a] : of[a + 1]].tolist():
                by_row[r][k, size].append(p)
    for r, groups in by_row.items():
        lo, hi = int(block.first[r]), int(block.first[r + 1])
        body = block.data
        words = [body[a:z].tobytes() for a, z in zip(block.starts[lo:hi].tolist(), block.ends[lo:hi].tolist())]
        best: dict[int, tuple] = {}
        for (k, size), places in groups.items():
            if hi - lo < size and not whole:
                continue
            size_here = min(size, hi - lo)
            p = np.unique(np.array(places))
            starts = np.unique((p[:, None] - np.arange(size_here - k + 1)).ravel())
            starts = starts[(starts >= lo) & (starts + size_here <= hi)]
            a, z = int(starts[0]), int(starts[-1]) + size_here - k + 1
            for part in np.array_split(starts, -(-len(starts) // 4096)):
                a, z = int(part[0]), int(part[-1]) + size_here - k + 1
                f = _simhash(runs[k][a:z], part - a, part - a + size_here - k + 1)
                for w, n in index.candidates(f, size):
                    s = int(part[w]) - lo
                    x = similarity(bag(words[s : s + size_here]), index.bag(n))
                    if x >= threshold and (n not in best or (-x, s) < best[n][:2]):
                        best[n] = (-x, s, s + size_here)
            n_shingles = size_here - k + 1
            for n, windows in index.shared(p, runs[k][p], size, n_shingles, lo, hi - size_here, threshold):
                if n in best and best[n][0] == -1:  # equal windows have equal fingerprints
                    continue
                for both, s in windows:
                    s -= lo
                    x = similarity(bag(words[s : s + size_here]), index.bag(n))
                    if x >= threshold and (n not in best or (-x, s) < best[n][:2]):
                        best[n] = (-x, s, s + size_here)
                    if x == both / (n_shingles + index.bag(n).total() - both):  # not so if hashes collide
                        break
        for n, found in best.items():
            yield r, n, found


def _texts(index: Index, text: pa.Array, threshold: float) -> Iterator[tuple[int, dict[int, tuple]]]:
    """(row, best window by item) of the rows that hold an item; a very long text is worked
    on in parts that overlap by the longest item."""
    data, offsets = string_buffers(pc.utf8_lower(text))
    for lo, hi in row_spans(offsets):
        d = data[offsets[lo] : offsets[hi]]
        rows: dict[int, dict[int, tuple]] = defaultdict(dict)
        if len(d) > LONG and hi - lo == 1:
            for word, block, last in overlapping(d, max(int(index.size.max(initial=1)) - 1, 0), LONG, BARE):
                for _, n, (x, s, e) in _windows(index, block, threshold, word == 0 and last):
                    found = (x, s + word, e + word)
                    if n not in rows[lo] or found < rows[lo][n]:
                        rows[lo][n] = found
        else:
            for r, n, found in _windows(index, WordBlock(d, offsets[lo : hi + 1] - offsets[lo], BARE), threshold):
                rows[lo + r][n] = found
        yield from rows.items()


def _scan(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            found = [(r, index.ids[n], -x, s, e) for r, best in _texts(index, b.column("_text"), threshold) for n, (x, s, e) in best.items()]
            if found:
                r, *rest = zip(*found)
                columns = [pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(r)), *columns], ["_id", "_item", "similarity", "start_word", "end_word"])

    return run


def _leaks(shared, threshold: float):
    def run(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for r, best in _texts(shared.value, text, threshold):
            out[r] = bool(best)
        return pa.array(out)

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_id, similarity, start_word, end_word): each item in each document
    at its best window, of equal ones the first; words count from 0, bare words as above.

    Null or empty texts and items hold nothing.  Of items with equal text each is
    reported.  Repeated document rows are reported as often as they occur.  Very long
    texts are read whole, a part at a time.  Document ids may be of any type, item ids
    are integers (others raise); other columns are ignored, whatever they are called,
    but ``id_col`` may not be ``item_id``.  Empty tables give an empty result.
    """
    if id_col == "item_id":
        raise ValueError("the result has a column item_id already")
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    out = None
    for index in _indices(docs, items, item_col, item_text, block_bytes):
        found = d.mapInArrow(_scan(index, threshold), f"_id {d.schema['_id'].dataType.simpleString()}, _item long, similarity double, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"_id": id_col, "_item": "item_id"})


def _indices(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, block_bytes: int) -> Iterator:
    """Broadcast indices of the items, in blocks of at most about ``block_bytes`` of text,
    each of which reaches the driver and is about ten times as large as an index."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else items
        yield spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in block.collect()]))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item: a filter, without a shuffle.
    Null and empty texts stay, as do all texts if there is no item; column names are free."""
    for index in _indices(docs, items, item_col, item_text, block_bytes):
        leak = F.arrow_udf(_leaks(index, threshold), "boolean")(F.col(text_col).cast("string"))
        docs = docs.where(~leak)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items)
