"""Fill-in-the-middle examples: a text's prefix, middle and suffix put in another order.

A text is cut into units (a word with the white space before it; white space at the end
is one more).  Two numbers drawn from a digest of seed and id say after how many units
the prefix and the middle end.  ``psm`` writes prefix, suffix, middle, each after its
marker; ``spm`` writes suffix, prefix, middle; ``plain`` leaves the text as it is: empty
texts, texts that hold a marker, and the share that the digest leaves out.

Method: secondary-sort assembly.  Texts become pieces of whole units of about ``CHUNK``
bytes, keyed by document and place in the output.  One shuffle brings the pieces of a
document together, each partition is sorted by document and place, and a walk over the
sorted stream writes the output piece by piece: into an incremental digest, or joined
to a text.  The same walk reads the markers of its own output and gives every piece its
place in the original; sorted again by that, in the same partition, the pieces stream
into the digest of the restored text.  No document has to fit in memory for its digests,
and a lost executor's partitions are sorted again from the shuffle.

Rows that repeat an id and a text share pieces; each gets a row of its own.  They are
dealt by the input partition they come from, so a row repeated very often is no hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, LONG, small_batches

MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = "42", 50, 80
CHUNK = 1 << 16
PARTS = 64
_BATCH = 4 << 20
_UNIT_END = re.compile(rb"(?<=[^\t-\r ])[\t-\r ]")
#: which part a marker opens, as its place in the original: prefix, middle, suffix
_PREFIX, _MIDDLE, _SUFFIX = range(3)
_MARKS = {_PREFIX: b"<P>", _MIDDLE: b"<M>", _SUFFIX: b"<S>"}
_ORDER = {"psm": (_PREFIX, _SUFFIX, _MIDDLE), "spm": (_SUFFIX, _PREFIX, _MIDDLE)}
_LAST = 1 << 62
_DOC = ["_id", "_key", "_part"]
OUT = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")


def _word_ends(data: memoryview, at: int) -> np.ndarray:
    """Places in ``data`` where a word ends, of those in the part of ``LONG`` bytes from ``at``."""
    here = ~_SPACE[np.frombuffer(data[at : at + LONG + 1], np.uint8)]
    n = min(LONG, len(data) - at)
    after = np.append(here[1:], False) if at + n == len(data) else here[1:]
    return np.flatnonzero(here[:n] & ~after[:n]) + at + 1


def unit_ends(data: bytes, *asked) -> tuple[int, list[int]]:
    """(number of units, byte at which each of the asked units ends); ``asked`` are functions
    of that number.  A part of the text is looked at at a time."""
    view = memoryview(data)
    counts = [len(_word_ends(view, at)) for at in range(0, len(data), LONG)]
    upto = np.cumsum([0, *counts])
    words = int(upto[-1])
    n = words + bool(data and _SPACE[data[-1]])
    out = []
    for f in asked:
        k = f(n)
        part = int(np.searchsorted(upto, k)) - 1
        out.append(0 if k == 0 else len(data) if k > words else int(_word_ends(view, part * LONG)[k - 1 - upto[part]]))
    return n, out


def code_points(data: bytes, start: int, end: int) -> int:
    """Code points in data[start:end] of UTF-8."""
    view = memoryview(data)
    return sum(int(np.count_nonzero((np.frombuffer(view[a : min(a + LONG, end)], np.uint8) & 0xC0) != 0x80)) for a in range(start, end, LONG))


def _chunks(data: bytes, start: int, end: int) -> Iterator[bytes]:
    """data[start:end] in pieces of whole units; at least one, which may be empty."""
    while end - start > CHUNK:
        stop = _UNIT_END.search(data, start + CHUNK, end)
        if not stop:
            break
        yield data[start : stop.start()]
        start = stop.start()
    yield data[start:end]


def example(data: bytes, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, list[tuple[int | None, int, int]]]:
    """(units, form, parts in the order of the output): a part is the place of its marker
    (None: no marker) and where it begins and ends."""
    n, (a, b) = unit_ends(data, lambda n: min(h[0] % (n + 1), h[1] % (n + 1)), lambda n: max(h[0] % (n + 1), h[1] % (n + 1)))
    if not data or any(m.encode() in data for m in MARKERS) or h[2] % 100 >= rate:
        return n, "plain", [(None, 0, len(data))]
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    spans = {_PREFIX: (0, a), _MIDDLE: (a, b), _SUFFIX: (b, len(data))}
    return n, form, [(p, *spans[p]) for p in _ORDER[form]]


_TYPES = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}


class _Rows:
    """Rows for Spark, given out as a batch once they hold enough bytes."""

    def __init__(self, columns: str):
        self.fields = [(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))]
        self.rows: list[tuple] = []
        self.boxes: list[pa.Array] = []
        self.size = 0

    def read(self, batch: pa.RecordBatch) -> None:
        """From now on ``at`` means rows of this batch."""
        self.boxes = [*(self.boxes if self.rows else ()), batch.column("_row")]

    def add(self, row: tuple, size: int, at: int | None = None) -> None:
        """A row, which takes the input row ``at`` along."""
        self.rows.append((*row, None if at is None else at + sum(map(len, self.boxes[:-1]))))
        self.size += size + 100

    def batch(self) -> pa.RecordBatch:
        *cols, at = zip(*self.rows)
        arrays = [pa.array(c, kind) for (_, kind), c in zip(self.fields, cols)]
        arrays.append(pa.concat_arrays(self.boxes).take(pa.array(at, pa.int64())))
        self.rows, self.size, self.boxes = [], 0, self.boxes[-1:]
        return pa.RecordBatch.from_arrays(arrays, names=[*[name for name, _ in self.fields], "_row"])

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size >= _BATCH:
            yield self.batch()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.batch()


def _with_row(columns: str, d: DataFrame) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(columns).fields, T.StructField("_row", d.schema["_row"].dataType)])


def _cut(rate: int, spm_rate: int):
    """Rows of texts to rows of pieces; a document's last piece carries its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(PIECES)
        for b in batches:
            ids, keys, parts, *hs = (b.column(c).to_pylist() for c in (*_DOC, "h1", "h2", "h3", "h4"))
            texts = b.column("_text")
            out.read(b)
            for i in range(b.num_rows):
                data = texts[i].as_py()
                n, form, spans = example(data, tuple(h[i] for h in hs), rate, spm_rate)
                chars = {p: code_points(data, s, e) for p, s, e in spans if p in (_PREFIX, _MIDDLE)}
                pos = 0
                for k, (mark, start, end) in enumerate(spans):
                    for piece in _chunks(data, start, end):
                        start += len(piece)
                        last = k == len(spans) - 1 and start == end
                        said = (n, chars.get(_PREFIX), chars.get(_MIDDLE)) if last else (None,) * 3
                        out.add((ids[i], keys[i], parts[i], pos, form, mark, piece, *said), len(piece), i if last else None)
                        pos, mark = pos + 1, None
                        yield from out.full()
        yield from out.rest()

    return run


PIECES = "_id string, _key binary, _part int, pos long, form string, mark int, piece binary, n long, prefix_chars long, middle_chars long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The outputs in pieces: document (_id, _key, _part), place ``pos``, ``form``, the marker
    before the piece (``mark``) and the piece's bytes; the last one has the numbers of the
    document and ``_row``, the input row without its text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), own), 256)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    rest = F.struct(F.lit(True).alias(""), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row")
    d = docs.select(rest, text.cast("binary").alias("_text"), own.alias("_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("_key"), (F.spark_partition_id() % PARTS).alias("_part"), *[part(k).alias(f"h{k + 1}") for k in range(4)])
    return d.mapInArrow(_cut(rate, spm_rate), _with_row(PIECES, d))


def _assemble(whole: bool):
    """Walk over sorted pieces: the output's digest (or, with ``whole``, its text) for each
    row of a document, and for every piece its place in the original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, doc = _Rows(WALKED), None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in (*_DOC, "pos", "form", "mark", "n", "prefix_chars", "middle_chars")}
            data = b.column("piece")
            out.read(b)
            for i in range(b.num_rows):
                key = tuple(cols[c][i] for c in _DOC)
                if key != doc:
                    doc, at, digest, part, text = key, -1, hashlib.sha256(), 0, []
                if cols["pos"][i] != at:  # rows that repeat a document repeat its pieces
                    at, piece, mark = cols["pos"][i], data[i].as_py(), cols["mark"][i]
                    if mark is not None:
                        part = mark
                        digest.update(_MARKS[mark])
                        text += [_MARKS[mark]] if whole else []
                    digest.update(piece)
                    if whole:
                        text.append(piece)
                    else:
                        out.add((*key, (part << 40) + at, piece, *[None] * 6), len(piece))
                if cols["n"][i] is not None:
                    if whole:
                        text = [b"".join(text)]
                    said = (text[0] if whole else None, cols["n"][i], cols["form"][i], cols["prefix_chars"][i], cols["middle_chars"][i], digest.hexdigest())
                    out.add((*key, _LAST, *said), len(text[0]) if whole else 0, i)
                yield from out.full()
        yield from out.rest()

    return run


WALKED = "_id string, _key binary, _part int, rank long, piece binary, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def _walked(cut: DataFrame, whole: bool) -> DataFrame:
    return cut.repartition(*_DOC).sortWithinPartitions(*_DOC, "pos").mapInArrow(_assemble(whole), _with_row(WALKED, cut))


RESTORED = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk over pieces in the order of the original: a row, with both digests, for each of a document's."""
    out, doc = _Rows(RESTORED), None
    names = ("n", "form", "prefix_chars", "middle_chars", "output_sha256")
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in (*_DOC, *names)}
        data = b.column("piece")
        out.read(b)
        for i in range(b.num_rows):
            key = tuple(cols[c][i] for c in _DOC)
            if key != doc:
                doc, digest = key, hashlib.sha256()
            if cols["n"][i] is None:
                digest.update(data[i].as_py())
            else:
                out.add((*[cols[c][i] for c in names], digest.hexdigest()), 0, i)
                yield from out.full()
    yield from out.rest()


def _opened(d: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    keep = [c for c in docs.columns if c in d.schema["_row"].dataType.names and c not in OUT]
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], *names)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` without the text, with n (units), form, prefix_chars, middle_chars (null if
    plain) and ``output``, the example; these replace input columns of their names, and
    other columns pass through under any name.

    Null and empty texts give an empty plain example; a null id counts as the empty one;
    ids may be of any type; repeated rows get equal examples; an empty table gives an
    empty one.  Only here a very long text is joined whole, as a row of the result.
    """
    d = _walked(pieces(docs, id_col, text_col, seed, rate, spm_rate), True)
    return _opened(d.withColumn("output", F.col("piece").cast("string")), docs, "n", "form", "prefix_chars", "middle_chars", "output")


def checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As ``fill_in_middle``, with the digests of the output and of the text restored from
    it (lowercase hex SHA-256) in place of the example; very long texts stream through in
    pieces."""
    d = _walked(pieces(docs, id_col, text_col, seed, rate, spm_rate), False).sortWithinPartitions(*_DOC, "rank")
    return _opened(d.mapInArrow(_restored, _with_row(RESTORED, d)), docs, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
k AS (SELECT *, len(u)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS a, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS z FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(a || m || z) AS restored_sha256 FROM p
"""
