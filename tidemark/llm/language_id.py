"""Language identification with character language models.

Method: one interpolated Kneser-Ney model of order 4 per language, over letters in
lower case with everything else as one space.  Models of all languages share sorted
hash arrays: for every character n-gram the languages that have it with their finished
log-probabilities, and for every context the languages that have it with their back-off
weights.  A text goes to the language with the lowest cross-entropy per character.

The score is the softmax of the cross-entropies at a temperature fitted on calibration
rows; ``rejected`` marks texts whose cross-entropy is above nearly all calibration rows
of the predicted language, so that they are probably in none of the learned ones.

Learning uses at most about ``2 * SAMPLE`` whole documents per language, drawn by a hash
of id and text, and at most about ``SAMPLE_BYTES`` of text over all languages, shared
equally.  Of what that gives, each language keeps its most frequent n-grams, at most
``ENTRIES`` over all languages, so the model that is broadcast has a bounded size, whatever
the number of languages.  Calibration works out sums and quantiles where the rows are;
the driver gets a row for each language.  n-grams are packed in 64 bits, sixteen for each
character, and hashed by a bijection, so look-ups are exact; letters beyond the basic
plane share 6,144 codes.

Very long texts are scored and counted a part at a time, with three characters carried
over, so memory does not grow with a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, mix, small_batches, written

ORDER = 4
SAMPLE = 400  # half the documents drawn per language, of which a quarter calibrate
SAMPLE_BYTES = 64 << 20  # of text drawn over all languages
ENTRIES = 1 << 21  # n-grams of the highest order, added up over languages
REJECT = 0.999
TEMPERATURES = np.geomspace(0.05, 2, 40)
UNKNOWN = "und"
CHUNK = 1 << 18
START = "\x01"  # three stand before a text; in a text it is white space

_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """BMP code point -> letter in lower case, or space; 1 marks the start of a text."""
    if not _fold:
        out = np.full(1 << 16, 32, np.uint64)
        for c in range(1 << 16):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        out[1] = 1
        _fold.append(out)
    return _fold[0]


def _letters(text: str) -> np.ndarray:
    """One code per character: the letter in lower case, or space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points > 0xFFFF
    c = _folded()[np.where(high, 32, points)]
    if high.any():
        c[high] = [0xE000 + ord(x) % 0x1800 if x.isalpha() else 32 for x in map(chr, points[high].tolist())]
    return c


def _packed(c: np.ndarray) -> np.ndarray:
    g = c.copy()
    for k in range(1, ORDER):
        g[k:] |= c[:-k] << np.uint64(16 * k)
    return g


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-gram, text number) of each predicted character, and letters per text."""
    c = _letters("".join(START * 3 + t.replace(START, " ") + " " for t in texts))
    row = np.repeat(np.arange(len(texts)), [len(t) + 4 for t in texts])
    letters = np.bincount(row[c > 32], minlength=len(texts))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, row = c[keep], row[keep]
    said = c != 1
    return _packed(c)[said], row[said], letters


def _long_codes(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """As ``_codes`` for one text, a part at a time: (packed 4-grams, letters)."""
    before = np.ones(ORDER - 1, np.uint64)
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK].replace(START, " ") + (" " if at + CHUNK >= len(text) else "")
        c = _letters(part)
        letters = int((c > 32).sum())
        c = np.append(before, c[(c != 32) | (np.append(before[-1], c[:-1]) != 32)])
        before = c[-(ORDER - 1) :]
        yield _packed(c)[ORDER - 1 :], letters


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about ``CHUNK`` characters; a longer text by itself."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class HashArray:
    """Sorted hashes with an index by their leading bits."""

    def __init__(self, codes: np.ndarray):
        h = mix(codes.astype(np.uint64))
        self.order = np.argsort(h)
        self.h = np.append(h[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(1, int(len(codes)).bit_length() + 1)
        self.start = np.searchsorted(self.h[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position in the sorted order, or -1."""
        h = mix(codes)
        at = self.start[h >> np.uint64(64 - self.bits)].astype(np.int64)
        found = self.h[at]
        todo = np.flatnonzero(found < h)
        while len(todo):
            at[todo] += 1
            found[todo] = self.h[at[todo]]
            todo = todo[found[todo] < h[todo]]
        at[(found != h) | (at >= len(self.h) - 1)] = -1
        return at


class Entries:
    """Values of (code, language) pairs, those of a code side by side."""

    def __init__(self, codes: np.ndarray, langs: np.ndarray, values: np.ndarray):
        own, at = np.unique(codes, return_inverse=True)
        self.hashes = HashArray(own)
        place = np.empty(len(own), np.int64)
        place[self.hashes.order] = np.arange(len(own))
        order = np.argsort(place[at], kind="stable")
        self.langs, self.values = langs[order].astype(np.int32), values[order].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place[at], minlength=len(own)))])
        del self.hashes.order

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the code asked, language, value) of all pairs of these codes."""
        at = self.hashes.find(codes)
        asked = np.flatnonzero(at >= 0)
        start, n = self.first[at[asked]], self.first[at[asked] + 1] - self.first[at[asked]]
        pairs = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(asked, n), self.langs[pairs], self.values[pairs]


class Model:
    """Interpolated Kneser-Ney for several languages over shared tables of what each has."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.masks = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
        letters = [np.unique(counts[lang][0] & self.masks[1]) for lang in self.langs]
        self.vocabulary = len(np.unique(np.concatenate(letters))) + 1 if letters else 1
        parts: dict[tuple[str, int], list] = {(kind, k): [] for kind in ("logs", "weight") for k in range(1, ORDER + 1)}
        for j, lang in enumerate(self.langs):
            grams = {ORDER: counts[lang]}
            for k in range(ORDER - 1, 0, -1):  # below the top, how many characters come before
                grams[k] = np.unique(grams[k + 1][0] & self.masks[k], return_counts=True)
            below = None
            for k in range(1, ORDER + 1):
                c, m = grams[k]
                once, twice = int((m == 1).sum()), int((m == 2).sum())
                d = once / (once + 2 * twice) if once and twice else 0.5
                heads, at = np.unique(c >> np.uint64(16) if k > 1 else np.zeros(len(c), np.uint64), return_inverse=True)
                total, kinds = np.bincount(at, weights=m), np.bincount(at)
                lam = d * kinds / total
                # an n-gram's end is an n-gram of the same language
                lower = below[1][np.searchsorted(below[0], c & self.masks[k - 1])] if k > 1 else 1 / self.vocabulary
                p = np.maximum(m - d, 0) / total[at] + lam[at] * lower
                below = c, p
                parts["logs", k].append((c, j, np.log(p)))
                parts["weight", k].append((heads, j, np.log(lam)))
        joined = lambda rows: Entries(np.concatenate([c for c, _, _ in rows]), np.repeat([j for _, j, _ in rows], [len(c) for c, _, _ in rows]), np.concatenate([v for _, _, v in rows]))
        self.logs = {k: joined(parts["logs", k]) for k in range(1, ORDER + 1) if self.langs}
        self.weight = {k: joined(parts["weight", k]) for k in range(1, ORDER + 1) if self.langs}

    def logp(self, codes: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probabilities in each language of the last character of each k-gram: where the
        language has it, as stored, elsewhere that of the shorter one and the weight."""
        if not k:
            return np.full((len(codes), len(self.langs)), -math.log(self.vocabulary), np.float32)
        out = self.logp(codes & self.masks[k - 1], k - 1)
        at, lang, w = self.weight[k].of(codes >> np.uint64(16) if k > 1 else np.zeros(len(codes), np.uint64))
        out[at, lang] += w
        at, lang, p = self.logs[k].of(codes)
        out[at, lang] = p
        return out

    def sums(self, codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Log-probabilities in each language, added up over the k-grams of each row."""
        out, step = np.zeros((rows, len(self.langs))), max(1, (1 << 22) // max(len(self.langs), 1))
        for lo in range(0, len(codes), step):
            own, at = np.unique(codes[lo : lo + step], return_inverse=True)
            p, r = self.logp(own), row[lo : lo + step]
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(r, weights=p[at, j], minlength=rows)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text in each language, letters)."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for lo, hi in _groups(texts):
            if len(texts[lo]) > CHUNK:
                n = 0
                for g, some in _long_codes(texts[lo]):
                    out[lo] -= self.sums(g, np.zeros(len(g), np.int64), 1)[0]
                    n, letters[lo] = n + len(g), letters[lo] + some
                out[lo] /= max(n, 1)
                continue
            g, row, letters[lo:hi] = _codes(texts[lo:hi])
            n = np.maximum(np.bincount(row, minlength=hi - lo), 1)
            out[lo:hi] = -self.sums(g, row, hi - lo) / n[:, None]
        return out, letters


def _softmax(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -(entropy - entropy.min(axis=1, keepdims=True)) / temperature
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, texts = np.array(b.column("_lang").to_pylist(), object), b.column("_text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs) if x == lang]
            for g in (g for lo, hi in _groups(mine) for g in ((x for x, _ in _long_codes(mine[lo])) if len(mine[lo]) > CHUNK else (_codes(mine[lo:hi])[0],))):
                codes, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])


def losses(own: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Log loss of each row's own language at every one of TEMPERATURES."""
    at = np.arange(len(own))
    return np.stack([-np.log(np.maximum(_softmax(entropy, t)[at, own], 1e-12)) for t in TEMPERATURES], axis=1)


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {lang: j for j, lang in enumerate(model.langs)}
        for b in batches:
            known = [k for k, lang in enumerate(b.column("_lang").to_pylist()) if lang in number]
            if known:
                b = b.take(pa.array(known))
                own = np.array([number[x] for x in b.column("_lang").to_pylist()])
                e, _ = model.entropies(b.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("_lang"), pa.array(e[np.arange(len(own)), own]), pa.array(list(losses(own, e)), pa.list_(pa.float64()))], ["lang", "own", "loss"])

    return run


def calibrated(held: DataFrame) -> tuple[float, dict[str, float]]:
    """(temperature of the least mean loss, cross-entropy above which a language rejects) of
    rows (lang, own, loss): their language, its cross-entropy, losses at TEMPERATURES.  A row
    for each language comes to the driver."""
    sums = [F.sum(F.col("loss")[k]).alias(f"s{k}") for k in range(len(TEMPERATURES))]
    rows = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile("own", F.lit(REJECT)).alias("most"), F.stddev_pop("own").alias("spread"), *sums).collect()
    if not rows:
        return 0.1, {}
    total = [math.fsum(r[f"s{k}"] for r in rows) for k in range(len(TEMPERATURES))]
    return float(TEMPERATURES[int(np.argmin(total))]), {r["lang"]: r["most"] + 3 * r["spread"] for r in rows if r["n"] >= 20}


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, entries: int = ENTRIES):
    """(broadcast model, temperature, least cross-entropy at which a language rejects).

    ``labelled`` rows without language, text or letters teach nothing; of each language
    at least one row is counted, so that every language can be predicted.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    d = labelled.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("_h")).where("_lang is not null and _text is not null")
    key = F.pmod("_h", F.lit(1 << 20))
    seen = d.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_text").cast("double")).alias("size"), F.min_by("_h", F.struct(key, F.col("_h"))).alias("_first"))
    seen = written(seen, "languages")
    if not (languages := seen.count()):
        return None, 1.0, {}
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"), F.lit(sample_bytes / languages) / F.greatest("size", F.lit(1.0)))
    d = d.join(seen.select("_lang", "_first", share.alias("_share")), "_lang")
    is_first = F.col("_h") == F.col("_first")
    d = d.where(is_first | (key < F.col("_share") * (1 << 20))).withColumn("_half", (F.pmod(F.shiftright("_h", 32), F.lit(4)) == 0) & ~is_first)
    grams = d.where("not _half").select("_lang", "_text").mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = grams.withColumn("_place", place).where(F.col("_place") <= max(1, entries // languages)).select("lang", "code", "n").toArrow()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    lang, code, n = langs.indices.to_numpy(), rows.column("code").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    counts = {}
    for j, name in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(lang == j)
        mine = mine[np.argsort(code[mine])]
        counts[name] = code[mine], n[mine]
    if not counts:
        return None, 1.0, {}
    shared = spark.sparkContext.broadcast(Model(counts))
    held = d.where("_half").select("_lang", "_text").mapInArrow(_measured(shared), "lang string, own double, loss array<double>")
    found = calibrated(held)
    discarded(seen)
    return shared, *found


_OUT = "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>"


def _predict(shared, temperature: float, limits: dict):
    def run(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        model = shared.value if shared is not None else None
        lang, score, entropy, out = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        if model is not None and texts:
            e, letters = model.entropies([t or "" for t in texts])
            best, p = e.argmin(axis=1), _softmax(e, temperature)
            for k in np.flatnonzero(letters).tolist():
                lang[k], score[k], entropy[k] = model.langs[best[k]], float(p[k, best[k]]), float(e[k, best[k]])
                out[k] = entropy[k] > limits.get(lang[k], math.inf)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(out, pa.bool_())], ["lang_pred", "score", "entropy", "rejected"])

    return run


def identify(docs: DataFrame, fitted, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` of lang_pred, score, entropy and rejected, which
    replaces an input column of that name; other columns pass through under any name.

    Texts that are null or have no letter are ``und`` with score 0, as are all texts
    if nothing could be learned.  Ties go to the first language in code point order.
    Repeated rows get equal results; very long texts count whole, a part at a time; an
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("language", F.arrow_udf(_predict(*fitted), _OUT)(F.col(text_col).cast("string")))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    fitted = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), fitted).select("doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")
