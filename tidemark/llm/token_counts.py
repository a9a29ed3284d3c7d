"""Token counts of whole texts, with the library that a vocabulary file belongs to.

Method: batch encoding in Arrow functions that return lengths only.  Batches are
balanced by bytes: Spark hands over Arrow batches of bounded bytes, and texts are
encoded in slices of about ``SLICE`` bytes of UTF-8, whatever the number of rows.

Where the vocabulary drops white space before it splits words (its normalizer changes
no more than white space, case and composition, and its pre-tokenizer keeps only what
matches a pattern without white space), no token and no special string spans white
space, so a text may be split at any ASCII white space without changing its count.
Then a long text is cut there into slices, each of which alone is made a list of
words; pieces that are not in a worker's bounded table are encoded in batches, and a
text's count is the sum over its slices.  Other vocabularies encode texts whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "word_bpe_49k.json"
SLICE = 1 << 20
KNOWN = 1 << 19  # pieces that a worker remembers
LONG_PIECE = 48  # bytes; longer ones are not remembered
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _keeps_spaces_apart(normalizer: dict | None) -> bool:
    """Whether a normalizer changes pieces between white space without looking beyond them."""
    if not normalizer:
        return True
    if normalizer.get("type") == "Sequence":
        return all(map(_keeps_spaces_apart, normalizer.get("normalizers") or ()))
    if normalizer.get("type") == "Replace":
        return (normalizer.get("pattern") or {}).get("Regex") == r"\s+" and normalizer.get("content") == " "
    return normalizer.get("type") in ("NFC", "Lowercase")


def splits_at_spaces(config: dict) -> bool:
    """Whether the vocabulary file drops white space between pieces."""
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    joined = any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or any(c.isspace() for c in t["content"]) for t in config.get("added_tokens") or ())
    plain = pattern and all(p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or p.startswith("'") and p[1:].isalpha() for p in pattern.split("|"))
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(removed and plain and not joined and not config.get("post_processor") and _keeps_spaces_apart(config.get("normalizer")))


def slices(texts: Iterator[bytes], cut: bool, most: int = SLICE) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (text number, part of it) of about ``most`` bytes each.  With ``cut``, texts
    are cut after white space; a word longer than ``most`` stays whole."""
    part: list[tuple[int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            end = len(t)
            if cut and end - at > most:
                stop = _SPACE.search(t, at + most)
                end = stop.end() if stop else end
            part.append((k, t[at:end]))
            size += end - at
            at = end or 1
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


_loaded: dict[str, object] = {}


class _Counter:
    """Counts for one vocabulary file; one in each worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.pieces, self.encode = False, lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.pieces = splits_at_spaces(json.load(f))
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.encode = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def batches(self, pieces: list[bytes]) -> list[int]:
        """Token counts of pieces, a slice of about equal bytes at a time."""
        return [n for part in slices(pieces, False) for n in self.encode([p.decode() for _, p in part])]

    def words(self, parts: list[bytes]) -> list[int]:
        """Token counts of parts that may be split at white space."""
        words = [t.split() for t in parts]
        flat = list(chain.from_iterable(words))
        new = list(set(flat) - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = list(set(flat))
        here = dict(zip(new, self.batches(new)))
        short = {w: n for w, n in here.items() if len(w) <= LONG_PIECE}
        self.known |= short
        table = self.known if len(short) == len(here) else self.known | here
        counts = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(np.fromiter(map(table.__getitem__, flat), np.int64, len(flat)), out=counts[1:])
        ends = np.cumsum([len(w) for w in words])
        return np.diff(counts[np.append(0, ends)]).tolist()

    def count(self, texts: Iterator[bytes], n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for part in slices(texts, self.pieces):
            own = self.words([t for _, t in part]) if self.pieces else self.encode([t.decode() for _, t in part])
            np.add.at(out, [k for k, _ in part], own)
        return out


def _counts(path: str):
    def run(text: pa.Array) -> pa.Array:
        # looked up by module name, so that a worker keeps its table between batches and tasks
        from tidemark.llm import token_counts as here

        if path not in here._loaded:
            here._loaded[path] = here._Counter(path)
        return pa.array(here._loaded[path].count((t.as_py() or b"" for t in text.cast(pa.binary())), len(text)))

    return run


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (boolean), which replace
    input columns of these names.  Null text counts as empty; repeated rows get equal
    counts; empty tables give empty results.  Very long texts are counted in slices.
    Special strings inside texts count as the library's default has it."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    d = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), F.arrow_udf(_counts(path), "long")(text).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
