"""Text operators: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, language_id, quality_classifier, quality_rules, registry, simhash_dedup, source_mixing, substring_dedup, token_counts, warc_archive

SF = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


LONG = " ".join(f"w{k}" for k in range(200))
CASES = [
    (1, LONG, "en", "a", 1),
    (2, "pre " + LONG, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "x " * 3000, "en", "b", 1),
    (6, "x " * 3000, "en", "b", 1),
    (6, "x " * 3000, "en", "b", 1),
    (None, LONG, "en", "b", 1),
    (7, "été   <|endoftext|> A\x0bB\x85C", "fr", "c", 9),
    (8, "\t\n ", "fr", "c", 3),
    (9, " ".join(f"w{k}" for k in range(120)) + " other end", "de", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def brute_removed(rows, n=50):
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 1024])
def test_substring_dedup(docs, hot):
    d = substring_dedup.substring_dedup(docs.withColumns({"start": F.lit(1), "marks": F.lit(2), "_rest": F.lit(3), "dedup": F.lit(4)}), hot=hot)
    assert {"start", "marks", "_rest", "n_chars"} <= set(d.columns)
    got = Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in d.collect())
    assert got == brute_removed([(c[0], c[1]) for c in CASES])


def test_substring_random(spark):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 40, 400) for _ in range(4)]
    rows = []
    for i in range(60):
        b = base[rng.integers(0, 4)]
        a = int(rng.integers(0, 300))
        rows.append((i, " ".join(f"t{x}" for x in np.r_[rng.integers(0, 40, 30), b[a : a + int(rng.integers(20, 100))], rng.integers(0, 40, 20)])))
    for window, hot in ((50, 1024), (50, 12), (50, 1), (7, 1024), (7, 12), (1, 1024)):
        d = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, hot=hot)
        got = Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in d.collect())
        assert got == brute_removed(rows, window)


def test_substring_common_phrase(spark):
    """One phrase of thirty words stands in all documents: its minimisers are hot, the longer ones are not."""
    rng = np.random.default_rng(6)
    phrase, passage = [f"p{x}" for x in range(30)], [f"q{x}" for x in range(70)]
    rows = []
    for i in range(80):
        own = [f"w{i}x{x}" for x in range(90)]
        a = int(rng.integers(0, 80))
        rows.append((i, " ".join([*own[:a], *phrase, *own[a:], *(passage[i % 7 :] if i % 9 == 0 else [])])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (40, 4):
        d = substring_dedup.substring_dedup(table, hot=hot)
        got = Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in d.collect())
        assert got == brute_removed(rows)
    light = pa.RecordBatch.from_pylist([{"_id": i, "_key": i, "_text": t} for i, t in rows])
    rows_of = lambda bs: Counter(m for b in bs for m in b.column("mini").to_pylist())
    short = [b for b in substring_dedup._light(50)(iter([light]))]
    hottest, most = rows_of(short).most_common(1)[0]
    marks = [{"_id": i, "_key": i, "_text": t, "marks": [{"start": s, "n": n} for b in short for m, k, s, n in zip(*(b.column(c).to_pylist() for c in ("mini", "_id", "start", "n"))) if k == i and m == hottest]} for i, t in rows]
    assert most > 20 and max(rows_of(substring_dedup._again(50)(iter([pa.RecordBatch.from_pylist(marks)]))).values()) < most / 4


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert simhash_dedup.simhash_groups(empty).count() == 0
    assert simhash_dedup.one_of_each(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert quality_rules.ledger(empty).count() == 0
    assert source_mixing.mixed(empty).count() == 0
    fitted = language_id.fit(empty)
    assert language_id.identify(empty, fitted).count() == 0
    stats = quality_classifier.document_statistics(empty)
    q = quality_classifier.fit(quality_classifier.with_labels(stats, labels))
    assert quality_classifier.scored(empty, q).count() == 0


def test_nothing_to_learn(docs, spark):
    out = language_id.identify(docs, language_id.fit(docs.limit(0))).collect()
    assert {r["language"]["lang_pred"] for r in out} == {"und"} and all(r["language"]["score"] == 0 for r in out)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    q = quality_classifier.fit(quality_classifier.with_labels(quality_classifier.document_statistics(docs), labels))
    assert {r["quality_score"] for r in quality_classifier.scored(docs, q).collect()} == {1.0}


def brute_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    got = keyed(simhash_dedup.simhash_groups(docs.withColumn("fp", F.lit(1))), ["doc_id", "fingerprint", "component_id"])
    prints = [(c[0], brute_fingerprint(c[1])) for c in CASES]
    ids = {}
    for i, f in prints:
        reach, grown = {f}, True
        while grown:
            more = {g for _, g in prints if any((g ^ x).bit_count() <= 4 for x in reach)}
            grown, reach = more != reach, more | reach
        ids[f] = min((j for j, g in prints if g in reach and j is not None), default=None)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == Counter((i, signed(f), ids[f]) for i, f in prints)


def test_simhash_matches_spark_hash(spark):
    d = spark.createDataFrame([("a b c d",), ("é",)], "t string").select("t", F.xxhash64("t").alias("h"))
    for r in d.collect():
        assert r["h"] == np.uint64(xxhash.xxh64_intdigest(r["t"].encode(), seed=42)).astype(np.int64)


@pytest.mark.parametrize("split", [3, 20_000])
def test_trie_join_is_exact(spark, split):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = [seeds]
    for _ in range(12):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in seeds], np.uint64)
        x.append(x[rng.integers(0, len(x))] ^ flips)
    x = np.unique(np.concatenate(x))
    parent = np.arange(len(x))
    for k in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 4)
        simhash_dedup._unite(parent, np.full(len(near), k), near)
    want = simhash_dedup._roots(parent, np.arange(len(x)))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    root = {r["u"]: r["root"] for r in simhash_dedup.components(simhash_dedup.links(df, split)).collect()}
    got = [root.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


def test_one_of_each(docs):
    kept = [r["doc_id"] for r in simhash_dedup.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for c in (1, 2, 3, 5, 7, 9) if c in kept}) and len(kept) == len(set(kept)) and 3 in kept and 4 not in kept and 6 not in kept


def brute_leaks(rows, items):
    out = {}
    for i, t in rows:
        w = decontaminate.bare_words(t or "")
        for j, u in items:
            v = decontaminate.bare_words(u or "")
            if not v or not w:
                continue
            best = max((decontaminate.similarity(decontaminate.bag(w[s : s + len(v)]), decontaminate.bag(v)) for s in range(max(1, len(w) - len(v) + 1))), default=0)
            if best >= 0.8:
                out[i, j] = round(best, 9)
    return out


def test_leaks_edges(spark, docs):
    items = [(1, "W3, w4; w5 W6 w7. w8 w9 w10"), (2, None), (3, ""), (4, "x x x x x x x"), (5, "ÉTÉ"), (6, "w3 w4 w5 w6 w7 w8 w9 w10"), (7, "nowhere to be found in any of these")]
    t = spark.createDataFrame(items, "item_id long, text string")
    rows = [(c[0], c[1]) for c in CASES if c[0] != 6 and c[0] is not None]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "similarity": F.lit(2)})
    for size in (1, 1 << 20):
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contamination(d, t, block_bytes=size).collect()}
        assert got == brute_leaks(rows, items) and (1, 1) in got and (1, 6) in got and (7, 5) in got
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, t).collect()} == {3, 4, 8}


def test_leaks_with_edits(spark):
    """Items with words changed: every pair above the threshold, and none below."""
    rng = np.random.default_rng(8)
    items, rows = [], []
    for k in range(120):
        n = int(rng.integers(15, 90))
        w = [f"v{x}" for x in rng.integers(0, 5000, n)]
        items.append((k, " ".join(w)))
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.choice([0, n - 1, rng.integers(0, n)]))] = "changed"
        rows.append((k, " ".join([*(f"u{x}" for x in rng.integers(0, 5000, 40)), *w, *(f"u{x}" for x in rng.integers(0, 5000, 40))])))
    want = {}
    for (i, t), item in zip(rows, items):
        want |= brute_leaks([(i, t)], [item])
    d, t = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contamination(d, t).collect()}
    assert got == want and len(want) > 60


def test_leaks_beyond_the_radius():
    """Every pair at the threshold is found, also those whose fingerprints are far apart."""
    rng = np.random.default_rng(31)
    for k in range(600):
        w = [f"v{x}" for x in rng.integers(0, 5000, 49)]
        item = (k, " ".join(w))
        w[int(rng.integers(6, 43))] = "changed"
        row = (k, " ".join([*(f"u{x}" for x in rng.integers(0, 5000, 20)), *w, *(f"u{x}" for x in rng.integers(0, 5000, 20))]))
        index = decontaminate.Index([item])
        got = {(k, index.ids[n]): round(-x, 9) for _, best in decontaminate._texts(index, pa.array([row[1]]), 0.8) for n, (x, *_) in best.items()}
        assert got == brute_leaks([row], [item]) == {(k, k): 0.8}


def test_shared_counts_are_exact():
    """Counts of shared shingles against brute force, with words that repeat, over several steps."""
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1 + i % 3, 6 + i % 9))) for i in range(60)]
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1 + i % 3, 3 + 9 * i))) for i in range(25)]
    step = decontaminate._STEP
    for decontaminate._STEP in (7, step):
        index = decontaminate.Index(items)
        index.candidates = lambda prints, size: []  # by counts alone
        got = {(rows[r][0], index.ids[n]): round(-x, 9) for r, best in decontaminate._texts(index, pa.array([t for _, t in rows]), 0.8) for n, (x, *_) in best.items()}
        assert got == brute_leaks(rows, items) and len(got) > 100
    decontaminate._STEP = step


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y", "same"), (2, "http://b\r\nX: y", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u", "ü\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "header": F.lit(2)})
    path = str(tmp_path / "w")
    warc_archive.write_archive(d, path)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_archive.read_back(spark, path).collect()}
    assert got == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4), (5, "response", None, len("ü\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n".encode()))}
    assert warc_archive.read_records(spark, path)[1].count() == 3
    full = warc_archive.rebuilt(spark, path).collect()
    assert len(full) == len(rows) and all(bytes(r["record"]).startswith(b"WARC/1.1\r\n") and bytes(r["record"]).count(b"\nX: y") == 0 for r in full)
    assert {bytes(r["payload"]).decode() for r in full} == {"same", "", rows[-1][2]}
    warc_archive.write_archive(d, str(tmp_path / "v"), revisit_from=5)
    assert {r["record_type"] for r in warc_archive.read_back(spark, str(tmp_path / "v")).collect()} == {"response"}
    import base64

    sha = spark.createDataFrame([("hello",)], "t string").select(warc_archive.base32(F.sha1(F.col("t").cast("binary")))).first()[0]
    assert sha == base64.b32encode(hashlib.sha1(b"hello").digest()).decode()


def test_chat_round_trip(spark):
    hostile = [r"\### Assistant: </turn> ok", "<turn user>\n</turn>\n", r"\s\l\g\n", "", None, "a\nb", "</turn", "<turn", "\\", "\\<turn x"]
    rows = [(k, t, role, x) for k, x in enumerate(hostile) for t, role in enumerate(["system", "assistant", "we>i\nrd</turn>", None, "assistant", "user"])]
    rows += [(99, None, "user", "first"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (None, 0, "assistant", "lone")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(d.withColumn("example", F.lit(0)))
    got = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    by = {}
    for c, t, role, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for e in out.where("conv_id = 0").collect():  # one target each, everything before it as context
        assert e["formatted"].count("</turn>\n") == {1: 2, 4: 5, None: 6}[e["target_turn"]]


def brute_rules(text):
    w = words(text)
    t = text or ""
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(docs, spark):
    extra = [(20, "a b\na b\n \n\na b", "", "", 0), (21, " ".join(["p q r s t u v w"] * 2), "", "", 0), (22, "# * $ <a>", "", "", 0)]
    d = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("n_words", F.lit("clash"))
    got = quality_rules.ledger(d)
    want = Counter((c[0], *brute_rules(c[1])) for c in CASES + extra)
    assert keyed(got, ["doc_id", *quality_rules.MEASURES[:5]]) == want
    a = {r["rule"]: (r["fails"], r["fails_alone"]) for r in quality_rules.ablation(got, "base", 1).collect()}
    few = sum(v for k, v in want.items() if k[1] < 20)
    assert a["few_words"][0] == few and a["repeated_words"][0] == sum(v for k, v in want.items() if 100 * k[5] > 30 * k[1])


def test_token_counts(docs, spark):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    odd = [(30 + k, t, "", "", 0) for k, t in enumerate(["a<|endoftext|>b <|startoftext|>", "x ́y é it's  DON'T 12 3", "İΣ ΣaΣ .", "\x1cq\x85w ﻿", "l​m　n", "y" * 5000])]
    d = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("n_tokens", F.lit("clash"))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = tokenizers.Tokenizer.from_file(P.path(name))
        got = keyed(token_counts.token_counts(d, P.path(name)), ["doc_id", "n_bytes", "n_tokens"])
        assert got == Counter((c[0], len((c[1] or "").encode()), len(t.encode(c[1] or "", add_special_tokens=False))) for c in CASES + odd)
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = keyed(token_counts.token_counts(d, P.path("piece_bpe_32k.model")), ["doc_id", "n_tokens"])
    assert got == Counter((c[0], len(sp.encode(c[1] or ""))) for c in CASES + odd)


def test_mixing(docs, spark):
    d = docs.withColumns({"size": F.lit("clash"), "u": F.lit(0), "words": F.lit(0)})
    out = source_mixing.mixed(d).collect()
    assert len(out) == len(CASES) and sorted(map(str, out)) == sorted(map(str, source_mixing.mixed(d).collect()))
    size = Counter()
    for c in CASES:
        size[c[3]] += len(words(c[1]))
    for r in out:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * size[r["source"]]
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - 1.5 * sum(size.values())) < 1e-6


def test_mixing_targets(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{k:02d}": int(x) for k, x in enumerate(rng.pareto(1, 15) * 1000 + 1)}
    t = {r["source"]: r["target"] for r in source_mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()}
    weight = dict(zip(sorted(sizes), [3, 1, 2] * 5))
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]
        if not over:
            break
        full |= set(over)
    for s in sizes:
        assert t[s] == pytest.approx(2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_))


def test_mixing_buckets_come_near(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 37 % 211).cast("int")).alias("text"))
    for bucket in (64, 1 << 20):
        got = source_mixing.mixed(d, bucket=bucket).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
        assert all(abs(r["t"] - r["target"]) <= 110 for r in got)


@here
def test_language_held_out(spark):
    x = language_id.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in x if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97 and all(0 <= r["score"] <= 1 for r in x)


def test_language_edges(docs):
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == (not letters)


def test_kneser_ney_sums_to_one():
    texts = {"a": ["hello there world", "she sells sea shells"], "b": ["bonjour le monde", "il vend des coquillages"]}
    counts = {k: np.unique(language_id._codes(v)[0], return_counts=True) for k, v in texts.items()}
    m = language_id.Model(counts)
    chars = np.unique(np.concatenate([c[0] & np.uint64(0xFFFF) for c in counts.values()]))
    for context in ("she", "bon", "zzz"):
        head = np.uint64(0)
        for c in context:
            head = (head << np.uint64(16)) | np.uint64(ord(c))
        p = np.exp(m.logp((head << np.uint64(16)) | chars).astype(float))
        unseen = np.exp(m.logp(np.array([(head << np.uint64(16)) | np.uint64(0x4E00)], np.uint64)).astype(float))
        assert np.allclose(p.sum(axis=0) + unseen[0], 1, atol=1e-5)


@here
def test_quality_held_out(spark):
    x = quality_classifier.op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in x if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in x)


def test_isotonic_is_monotone():
    x = np.arange(50.0)
    y = np.r_[np.linspace(0, 1, 25), np.linspace(0.4, 1, 25)]
    _, v = quality_classifier.isotonic(x, y, np.ones(50))
    assert (np.diff(v) > 0).all() and len(v) < 50


@here
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM read_parquet('{SF}/{f}')")
    got, want = registry.queries()[name](spark, SF), c.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((tidy(r) for r in got.select(order).collect()), key=str)
    b = sorted((tidy(r[want.columns.index(k)] for k in order) for r in want.fetchall()), key=str)
    assert a == b


# --- very long texts --------------------------------------------------------------


def long_text(size, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}x" for k in range(5000)])
    out = " ".join(vocabulary[rng.integers(0, 5000, size // 6)])
    return out.replace(" w7x ", "\n").replace(" w8x ", "  \t")


def test_parts_equal_the_whole(monkeypatch):
    from tidemark.llm import common

    text = long_text(400_000) + " same same same " + "Z" * 90_000 + " end É"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = common.WordBlock(data, np.array([0, len(data)]))
    for overlap in (0, 2, 49):
        n, hashes = 0, []
        for word, block, last in common.overlapping(data, overlap, 20_000):
            assert word == (n - overlap if n else 0) or not overlap
            hashes.append(block.hashes[n - word :])
            n = word + len(block.hashes)
        assert last and (np.concatenate(hashes) == whole.hashes).all()
    assert common.normal(b" a \t\nb ")[0] == b"a b"
    monkeypatch.setattr(common, "LONG", 5000)
    out, at = common.normal(text.encode())
    assert out.split(b" ") == text.encode().split() and all(out[a : b - 1] == w for a, b, w in zip(at[:-1], at[1:], text.encode().split()))
    # statistics
    want = quality_classifier.statistics(whole)
    assert np.allclose(quality_classifier.long_statistics(data, 10_000), want)
    # characters
    g, _, letters = language_id._codes([text])
    monkeypatch.setattr(language_id, "CHUNK", 7001)
    parts = list(language_id._long_codes(text))
    assert (np.concatenate([x for x, _ in parts]) == g).all() and sum(n for _, n in parts) == letters[0]
    # fingerprints
    assert simhash_dedup.fingerprint(text.encode()) == brute_fingerprint(text)


def test_windows_of_parts(monkeypatch):
    from tidemark.llm import common

    text = long_text(60_000, 3)
    w = text.split()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["_id", "_key", "_text"])
    take = lambda: {(m, s + k) for b in substring_dedup._light(50)(iter([batch])) for m, s, n in zip(*(b.column(c).to_pylist() for c in ("mini", "start", "n"))) for k in range(n)}
    want = take()
    item = (1, " ".join(w[3000:3060]))
    at = lambda: [(r, best) for r, best in decontaminate._texts(decontaminate.Index([item, (2, "w1x")]), pa.array([text, "w1x", "none"]), 0.8)]
    found = at()
    for m in (substring_dedup, decontaminate):
        monkeypatch.setattr(m, "LONG", 4000)
    assert take() == want and len(want) == len(w) - 49
    monkeypatch.setattr(decontaminate, "row_spans", lambda offsets: common.row_spans(offsets, 4000))
    assert at() == found and found[0][1][0] == (-1.0, 3000, 3060) and found[1] == (1, {1: (-1.0, 0, 1)})


def test_token_slices():
    texts = [b"a b c", b"", b"x" * 50 + b" y", b"z\t" * 40]
    for cut in (True, False):
        for most in (1, 7, 1000):
            got = {}
            for part in token_counts.slices(iter(texts), cut, most):
                for k, t in part:
                    got[k] = got.get(k, b"") + t
                assert most == 1000 or len(part) == 1 or sum(len(t) for _, t in part[:-1]) < most
            assert [got[k] for k in range(4)] == texts
    assert not token_counts.splits_at_spaces({"normalizer": {"type": "Prepend", "prepend": "_"}}) and not token_counts._keeps_spaces_apart({"type": "Strip"})


LARGE = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[2])
from tidemark.llm import decontaminate, language_id, quality_classifier, simhash_dedup, substring_dedup
rng = np.random.default_rng(1)
text = pa.array([(" ".join(f"w{x}" for x in rng.integers(0, 9999, 170_000)) + " ") * 64])
size = text.nbytes
which = sys.argv[1]
if which == "op1":
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), text], ["_id", "_key", "_text"])
    assert sum(b.num_rows for b in substring_dedup._light(50)(iter([batch])))
    substring_dedup._keep(text, pa.array([[{"lo": 5, "hi": 900}]]))
elif which == "op2":
    list(decontaminate._texts(decontaminate.Index([(1, "v1 v2 v3 v4 v5 v6 v7")]), text, 0.8))
elif which == "op4":
    simhash_dedup._fingerprints(text)
elif which == "op9":
    model = language_id.Model({k: np.unique(language_id._codes([v])[0], return_counts=True) for k, v in {"a": "hello there", "b": "bon jour"}.items()})
    model.entropies(text.to_pylist())
elif which == "op10":
    quality_classifier.all_statistics(text)
print(size >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("which", ["op1", "op2", "op4", "op9", "op10"])
def test_memory_of_a_very_long_text(which):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", LARGE, which, root], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert int(out[0]) >= 60 and int(out[1]) < 1024, out


# --- names, ids, ties, empty tables -----------------------------------------------

CLASHES = ("_fp", "fp", "_stays", "_own", "_row", "_id", "_k", "_n", "dedup", "quality_score", "language", "size", "u", "b", "edge", "a.b", "_rest", "_text", "_hashes", "item_id")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def test_clashing_names(spark, clashing, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same = lambda d: Counter((r["doc_id"], r["text"], r["n_chars"]) for r in d.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, plain = stage(spark, clashing, str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert same(out) == same(plain)
        kept = [c for c in clashing.columns if k < 4 or c not in source_mixing._OUT]
        assert out.columns[: len(kept)] == kept
        assert all(r[c] == n for r in out.collect() for n, c in enumerate(CLASHES) if c in kept)
    for d in (quality_rules.ledger(clashing), language_id.identify(clashing, language_id.fit(clashing)), quality_classifier.scored(clashing, None), source_mixing.mixed(clashing)):
        assert d.count() == len(CASES) and {"a.b", "_row", "_text"} <= set(d.columns)
    with pytest.raises(ValueError):
        decontaminate.contamination(docs.withColumnRenamed("doc_id", "item_id"), spark.createDataFrame([], "item_id long, text string"), id_col="item_id")


def test_empty_stages(spark, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    path = str(tmp_path / "w")
    warc_archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_archive.read_back(spark, path).count() == 0
    assert chat_format.read_back(chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert token_counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0


def test_ids_of_other_types(spark, docs):
    d = docs.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    number = lambda x: int(x[2:])
    plain = {r["doc_id"]: r["component_id"] for r in simhash_dedup.simhash_groups(docs.where("doc_id is not null")).collect()}
    assert {number(r["doc_id"]): number(r["component_id"]) for r in simhash_dedup.simhash_groups(d).collect()} == plain
    assert simhash_dedup.one_of_each(d).count() == simhash_dedup.one_of_each(docs.where("doc_id is not null")).count()
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(d, items).collect()} == {"d-1", "d-2", "d-9"}
    labels = spark.createDataFrame([("d-1", 1), ("d-5", 0)], "doc_id string, quality int")
    fitted = quality_classifier.fit(quality_classifier.with_labels(quality_classifier.document_statistics(d), labels))
    assert quality_classifier.scored(d, fitted).count() == d.count() == source_mixing.mixed(d).count()


def test_ties_are_decided_alike(spark):
    rows = [(1, "b b b", "en", "x", 1), (1, "a a a", "en", "x", 1), (1, "a a a", "de", "x", 1), (None, "lone words here", "en", "y", 1), (None, "lone words here", "en", "y", 1), (None, "a a a", "en", "x", 1)]
    out = [Counter(tuple(r) for r in simhash_dedup.one_of_each(spark.createDataFrame(order, SCHEMA)).collect()) for order in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert out[0] == out[1] == out[2] and out[0].total() == 2 and out[0][rows[3]] == 1


# --- models against brute force ---------------------------------------------------


def test_kneser_ney_against_brute_force():
    texts = {"a": ["hello there world", "she sells sea shells"], "b": ["bonjour le monde", "il vend des coquillages"]}
    m = language_id.Model({k: np.unique(language_id._codes(v)[0], return_counts=True) for k, v in texts.items()})
    strings = {k: ["\x01" * 3 + t + " " for t in v] for k, v in texts.items()}
    grams = {k: Counter(s[i - 3 : i + 1] for s in v for i in range(3, len(s))) for k, v in strings.items()}
    vocabulary = len({g[-1] for c in grams.values() for g in c}) + 1

    def p(lang, g):
        if not g:
            return 1 / vocabulary
        counts = grams[lang]
        for _ in range(4 - len(g)):
            counts = Counter(x[1:] for x in counts)
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        own = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(lang, g[1:])
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(lang, g[1:])

    for t in ("the sea", "le monde est la", "zq!"):
        s = "\x01" * 3 + t.replace("!", " ").replace("  ", " ") + " "
        s = s.replace("  ", " ")
        e, _ = m.entropies([t])
        want = [-np.mean([np.log(p(lang, s[i - 3 : i + 1])) for i in range(3, len(s))]) for lang in m.langs]
        assert np.allclose(e[0], want, atol=1e-4)


def test_ridge_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "word", "tale", "fine"], int(rng.integers(30, 90)))) + "." for _ in range(60)] + ["$$ ## 99 " * int(rng.integers(2, 30)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    fitted = quality_classifier.fit(quality_classifier.with_labels(quality_classifier.document_statistics(d), labels)).value
    import zlib

    fold = np.array([zlib.crc32(str(k).encode()) % 4 for k in range(120)])
    stats = quality_classifier.all_statistics(pa.array(texts))
    use = stats[fold != 2]
    z = quality_classifier.Scorer(use.mean(axis=0), np.where(use.std(axis=0) > 1e-9, use.std(axis=0), 1.0))
    x, y = z.features(stats[(fold != 2) & (fold != 3)]), (np.arange(120) < 60)[(fold != 2) & (fold != 3)].astype(float)
    m = x.shape[1] - 1
    beta = np.linalg.solve(x.T @ x + quality_classifier.RIDGE * len(x) * np.diag([1.0] * m + [1e-6]), x.T @ y)
    assert np.allclose(fitted.raw(stats), z.features(stats) @ beta, atol=1e-6)
    assert (fitted.probability(stats[:60]) > 0.7).mean() > 0.9 and (fitted.probability(stats[60:]) < 0.7).all()


@here
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs_seen = seen.toPandas()
        before = {r["doc_id"]: r["text"] for r in seen.collect()}
        seen = stage(spark, seen, SF).cache()
        after = {r["doc_id"]: r["text"] for r in seen.collect()}
        assert set(after) <= set(before) and len(after) > 0.7 * len(before) and seen.count() == len(after)
        if k == 0:
            stats = quality_classifier.document_statistics(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            fitted = quality_classifier.fit(quality_classifier.with_labels(stats, spark.read.parquet(f"{SF}/labels.parquet"))).value
            score = np.round(fitted.probability(quality_classifier.all_statistics(pa.array(before.values()))), 9)
            assert set(after) == {i for i, x in zip(before, score) if x >= 0.7}
        if k == 4:
            c = duckdb.connect()
            documents = docs_seen  # noqa: F841  (read by name)
            want = {i: (taken // size if size else None) for i, size, _, _, taken in c.sql(source_mixing.ORACLE).fetchall()}
            assert {i for i, n in want.items() if n} <= set(after) and all(r["copies"] == want[r["doc_id"]] for r in seen.collect() if r["size"])
        if k == 1:
            f = {i: brute_fingerprint(t) for i, t in after.items()}
            assert not any((f[i] ^ f[j]).bit_count() <= 4 for i in f for j in f if i < j)
        if k == 2:
            want = {i: kept if gone else before[i] for (i, _, gone, kept), _ in brute_removed(list(before.items())).items()}
            assert after == {i: t for i, t in want.items() if t or before[i] == t}
        if k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {i for i, _ in brute_leaks(list(before.items()), items)}
        if k < 4:
            assert set(seen.columns) == set(docs.columns)
    assert set(rows) >= set(after) and {"copies", "taken"} <= set(seen.columns)
