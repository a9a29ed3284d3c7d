"""Fill-in-the-middle, HTML extraction and importance resampling: brute force and edge cases."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, html_extraction, importance_resampling
from tidemark.llm.common import numbered, ranged

SF = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SCHEMA = "doc_id long, text string, source string"
DOCS = [
    (1, "the quick  brown\tfox jumps over the lazy dog and the cat ", "a"),
    (2, None, None),
    (3, "", "a"),
    (4, " \n\t", "b"),
    (5, "has a <S> marker inside of it", "b"),
    (5, "has a <S> marker inside of it", "b"),
    (6, "été 漢字 " * 40, "b"),
    (6, "other text under the same id", "b"),
    (None, "no id but words to move around here and there " * 9, None),
    (7, "x" * 200_000 + " tail", "c"),
    (8, " ".join(f"w{k}" for k in range(60_000)), "c"),
    (9, "\x00odd\x0b\x0c\r\x85 characters\xa0here <P", "c"),
] + [(100 + k, f"number {k} of many plain documents " * (k % 5 + 1), "d") for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def same_rows(df, want):
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


# --- fill in the middle -----------------------------------------------------------


def brute_example(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_examples_and_their_restoration(docs):
    want = [(i, s, *brute_example(i, t)) for i, t, s in DOCS]
    assert {w[3] for w in want} == {"plain", "psm", "spm"}
    same_rows(fill_in_middle.fill_in_middle(docs).select("doc_id", "source", "n", "form", "prefix_chars", "middle_chars", "output"), want)
    same_rows(fill_in_middle.checked(docs).select("doc_id", "n", "form", "output_sha256", "restored_sha256"), [(i, n, f, digest(o), digest(t)) for (i, t, _), (_, _, n, f, _, _, o) in zip(DOCS, want)])


@pytest.mark.parametrize("chunk,part,batch", [(1, 1, 1), (7, 3, 300), (64, 50, 5000)])
def test_examples_in_small_pieces(spark, monkeypatch, chunk, part, batch):
    """Texts of many pieces, parts and batches (pieces are made where the tasks run, so the walk is called here)."""
    rng = random.Random(chunk)
    for name, v in (("CHUNK", chunk), ("LONG", part), ("_BATCH", batch)):
        monkeypatch.setattr(fill_in_middle, name, v)
    for _ in range(200):
        text = "".join(rng.choice([" ", "\t", "a", "bc", "é", "漢"]) for _ in range(rng.randint(0, 40)))
        i = rng.randint(0, 10**6)
        n, form, a, m, out = brute_example(i, text)
        h = hashlib.sha256(f"42:{i}".encode()).hexdigest()
        data = text.encode()
        got_n, got_form, spans = fill_in_middle.example(data, tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4)))
        assert (got_n, got_form) == (n, form)
        built = b"".join((fill_in_middle._MARKS[mark] if mark is not None else b"") + b"".join(fill_in_middle._chunks(data, s, e)) for mark, s, e in spans)
        assert built.decode() == out
        if form != "plain":
            chars = {mark: fill_in_middle.code_points(data, s, e) for mark, s, e in spans}
            assert (chars[0], chars[1]) == (a, m)


def test_rates_decide_the_forms(docs):
    forms = lambda **kw: Counter(r["form"] for r in fill_in_middle.checked(docs, **kw).collect())
    assert forms(rate=0) == {"plain": len(DOCS)}
    assert set(forms(rate=100, spm_rate=100)) == {"plain", "spm"} and set(forms(rate=100, spm_rate=0)) == {"plain", "psm"}


def test_fill_in_middle_names_and_empty_tables(spark, docs):
    odd = docs.withColumns({c: F.lit(k) for k, c in enumerate(("_id", "_key", "_part", "pos", "piece", "_row", "rank", "n", "form", "a.b"))}).withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    d = fill_in_middle.fill_in_middle(odd)
    assert {"_id", "_key", "_row", "rank", "a.b", "m", "output"} <= set(d.columns) and d.columns.count("n") == 1
    assert d.where("_part = 2 and `a.b` = 9 and m['x'] = 1").count() == len(DOCS)
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_in_middle.fill_in_middle(empty).count() == 0 and fill_in_middle.checked(empty).count() == 0
    named = spark.createDataFrame([("é", "one two three")], "name string, body string")
    assert fill_in_middle.fill_in_middle(named, "name", "body").first()["n"] == 3


# --- html -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>x &amp; y</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="ad">buy</div><!-- <p>no</p> -->
<div id="cookie-notice">we use cookies</div><article class="post no-sidebar"><header><h1>T &lt;1&gt; &eacute;&#233;</h1><p>by me</p></header>
<p><b>Hello  there.<br><p>One <span class="ad">x</span>two &amp;
 three<ul><li>i1<li>i2</ul><section class="comments"><p>nice</section><form><label>l</label><input value="v>"></form>
<table><tr><td>a<td>b<tr><td>c</table><div hidden>h</div><div style="display: none">d</div>tail</article><aside>s</aside><footer>&copy; x</footer>"""


def kept(page):
    found = html_extraction.lines(page)
    most = max((said for said, _ in found), default=0)
    return [t for said, t in found if said >= html_extraction.UNSAID and said == most]


def test_lines_of_a_page():
    assert kept(PAGE) == ["T <1> éé", "Hello there.", "One two & three", "i1", "i2", "a b", "c", "tail"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("just text", ["just text"]),
        ("a < b & c &lt; d", ["a < b & c < d"]),
        ("<p>one<p>two", ["one", "two"]),
        ("<head><title>t</title><p>no body tag", ["no body tag"]),
        ("<nav>menu<article><p>left open</article>", ["left open"]),
        ("<form id=page><main><p>wrapped</main></form>", ["wrapped"]),
        ("<script>if (a < b) { '</p>' }", []),
        ("<p>x</p><script>never closed <p>y", ["x"]),
        ("<article><p>a <a title='>'>link</a> b</article>", ["a link b"]),
        ("<article><p>A</p><div class='related-posts'><article>B</article></div></article>", ["A"]),
        ("<div role=navigation>n</div><div role=main><p>m</div>", ["m"]),
        ("<div itemprop=articleBody>body</div><p>else", ["body"]),
        ("<article>&nbsp; &#x41;&#0; \x0b\x0c x</article>", ["A� x"]),
        ("<article><p>cut of<a href='", ["cut of"]),
        ("<article><b>bold</p> on</b> and on</article>", ["bold", "on and on"]),
    ],
)
def test_odd_markup(page, want):
    assert kept(page) == want


def longest(a, b):
    length = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            length[i + 1, j + 1] = length[i, j] + 1 if x == y else max(length[i, j + 1], length[i + 1, j])
    return length[-1, -1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(400):
        most = rng.choice([1, 3, 8, 200])
        a, b = ([rng.randint(0, most) for _ in range(rng.randint(0, 30))] for _ in range(2))
        both = html_extraction.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
        found, rest = [x for x, k in zip(a, both) if k], iter(b)
        assert all(x in rest for x in found) and len(found) == longest(a, b)


def test_template_lines_go_where_no_article_is_declared(spark):
    """A template without telling tags: what neighbours share goes, what a page has of its own stays;
    copies do not delete each other, and declared articles keep what they share."""
    site = lambda k, body: f"<div>Site name</div><div>Section</div>{body}<div>Contact us</div><div>Part {k // 4}</div>"
    body = lambda k: f"<div>Title {k}</div><p>First words of {k}</p><p>Shared quote</p>" if k % 5 == 2 else f"<div>Title {k}</div><p>Text of {k}</p>"
    pages = [(k, f"https://Example.org/a/{k:03d}.html?x=1#top", site(0, body(k))) for k in range(20)]
    pages += [(50, "https://example.org/a/050", site(0, body(50))), (51, "https://example.org/a/050/", site(0, body(50))), (50, "https://example.org/a/050", site(0, body(50)))]
    pages += [(k, f"http://other.net/{k}", f"<div>Top</div><article><h1>H {k}</h1><p>Same in all</p></article>") for k in (70, 71)]
    pages += [(80, None, site(1, "<p>no url</p>")), (81, "not a url", None), (82, "http://lonely.com", "<p>alone</p>"), (None, "http://lonely2.com", "<p>no id</p>")]
    d = html_extraction.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5))
    got = {}
    for r in d.collect():
        got.setdefault(r["page_id"], set()).add((r["text"], r["n_chars"]))
    own = lambda k: "\n\n".join([f"Title {k}", f"First words of {k}", "Shared quote"] if k % 5 == 2 else [f"Title {k}", f"Text of {k}"])
    for k in range(20):
        assert got[k] == {(own(k), len(own(k)))}
    assert got[50] == got[51] and {t for t, _ in got[50]} == {own(50)}
    assert {t for t, _ in got[70]} == {"H 70\n\nSame in all"} and {t for t, _ in got[71]} == {"H 71\n\nSame in all"}
    assert {t for t, _ in got[80]} == {"Site name\n\nSection\n\nno url\n\nContact us\n\nPart 0"}
    assert got[81] == {("", 0)} and got[82] == {("alone", 5)} and got[None] == {("no id", 5)}
    assert d.count() == len(pages)


def test_neighbours_over_many_ranges(spark):
    """Against a sort of all pages; one host has most of them."""
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.7 else f"h{rng.randint(0, 9)}", [f"p{rng.randint(0, 30)}" for _ in range(rng.randint(0, 3))]) for k in range(400)]
    d = spark.createDataFrame(rows, "_key long, host string, path array<string>").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = ranged(d, "urls", F.asc("host"), F.asc("path"), F.asc("_key"))
        assert table.select("_block").distinct().count() > 5
        got = {r["_key"]: (r["near"], r["far"]) for r in html_extraction.neighbours(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for k, r in enumerate(order):
        p = order[k - 1] if k and order[k - 1][1] == r[1] else None
        n = order[k + 1] if k + 1 < len(order) and order[k + 1][1] == r[1] else None
        both = [p, n] if n is None or (p is not None and alike(r[2], n[2]) <= alike(r[2], p[2])) else [n, p]
        assert got[r[0]] == tuple(None if x is None else x[0] for x in both), r


def test_html_names_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, "http://a.b/d", "<p>x</p>")], "page_id long, url string, html string")
    d = html_extraction.extracted(pages.withColumns({c: F.lit(k) for k, c in enumerate(("_row", "_key", "_id", "host", "path", "text", "packed", "near", "a.b"))}).withColumn("m", F.create_map(F.lit(1), F.lit(2))))
    assert {"_row", "_key", "host", "a.b", "m"} <= set(d.columns) and d.where("_key = 1 and `a.b` = 8").count() == 2
    assert html_extraction.extracted(pages.where("false")).count() == 0


@here
def test_html_of_the_tables(spark):
    """Every page against an independent reading of this template."""
    import html

    want = {}
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want[i] = "\n\n".join(b for b in blocks if b)
    from tidemark.llm import registry

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in registry.queries()["op12_html_extraction"](spark, SF).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and any(want.values())


# --- importance resampling --------------------------------------------------------


def brute_features(text, ngram=1):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(w[k : k + n]) for n in range(1, ngram + 1) for k in range(len(w) - n + 1)], len(w)


def brute_scores(docs, target, ngram=1, buckets=10_000):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, c in ((docs, s), (target, t)):
        for text in texts:
            c.update(map(b, brute_features(text[1] if isinstance(text, tuple) else text, ngram)[0]))
    whole, aimed = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (whole + buckets) / ((s[k] + 1) * (aimed + buckets))))
    out = []
    for i, text in docs:
        f, words = brute_features(text, ngram)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(b(x)) for x in f)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    return out


def brute_ranks(rows, rate=10, least=20):
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: math.floor(rate * len(fit) / 100)])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def random_docs(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(["Alpha", "beta", "gamma!", "Ärger", "x1", "y-z", "漢"]) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def taken(r):
    d = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return d.select("_id", "n_features", "weight", "score", F.when(F.col("first") + F.col("k") <= F.col("draw"), F.col("first") + F.col("k")))


@pytest.mark.parametrize("ngram,width", [(1, 0.005), (1, 1e-9), (2, 0.2), (3, 2.0)])
def test_importance_ranks(spark, ngram, width):
    rows = random_docs(300) + [(None, None), (901, ""), (902, "A " * 50), (903, None)]
    target = [("beta beta gamma x1",), (None,), ("漢 beta",)]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string")
    array = importance_resampling.fitted(docs, aim, ngram=ngram)
    same_rows(taken(importance_resampling.ranks(docs, array, ngram=ngram, width=width)), brute_ranks(brute_scores(rows, [t[0] for t in target], ngram)))


def test_importance_ties_and_repeats(spark):
    """Rows that repeat an id and a text take places in a row, and may be cut by the sample's end."""
    rows = [(1, "same words " * 20)] * 25 + random_docs(40, 3) + [(k % 3, "other words " * 15) for k in range(9)]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([("same",)], "text string")
    got = taken(importance_resampling.ranks(docs, importance_resampling.fitted(docs, aim), rate=30)).collect()
    want = brute_scores(rows, ["same"])
    assert Counter(tuple(r)[:4] for r in got) == Counter(w[:4] for w in want)
    fit = [w for w in want if w[4] >= 20]
    places = sorted((r[4], r[3]) for r in got if r[4] is not None)
    assert [p for p, _ in places] == list(range(1, math.floor(0.3 * len(fit)) + 1))
    assert [s for _, s in places] == sorted((w[3] for w in fit), reverse=True)[: len(places)]


def test_importance_sample_is_the_head(spark):
    rows = random_docs(200, 7)
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("score", F.lit("old")), spark.createDataFrame([("beta gamma",)], "text string")
    got = importance_resampling.importance_sample(docs, aim)
    want = {r[0] for r in brute_ranks(brute_scores(rows, ["beta gamma"])) if r[4] is not None}
    assert {r["doc_id"] for r in got.collect()} == want and got.count() == len(want) > 5
    assert "_row" in got.columns and dict(got.dtypes)["score"] == "bigint"


def test_importance_empty_tables(spark):
    docs, aim = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    array = importance_resampling.fitted(docs, aim)
    assert importance_resampling.ranks(docs, array).count() == 0 and importance_resampling.importance_sample(docs, aim).count() == 0
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance_resampling.ranks(few, array).first()["first"] is None


def test_features_of_parts(monkeypatch):
    """Texts read a few bytes at a time have the features of the whole."""
    monkeypatch.setattr(importance_resampling, "LONG", 5)
    for _, text in random_docs(60, 9):
        for ngram in (1, 2, 3):
            got = Counter(f.decode() for part in importance_resampling.features(text.encode(), ngram) for f in part)
            assert got == Counter(brute_features(text, ngram)[0])


def test_numbers_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 50), k, rng.randint(1, 4)) for k in range(500)]
    d = ranged(spark.createDataFrame(rows, "a long, b long, n long").repartition(6), "t", F.desc("a"), F.asc("b"))
    got = {r["b"]: r["upto"] for r in numbered(d, "upto", "n", F.desc("a"), F.asc("b")).collect()}
    total = 0
    for _, b, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        total += n
        assert got[b] == total


# --- very long texts --------------------------------------------------------------

LARGE = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[2])
from tidemark.llm import fill_in_middle, html_extraction, importance_resampling
rng = np.random.default_rng(1)
text = (" ".join(f"w{x}" for x in rng.integers(0, 9999, 170_000)) + " ") * 64
which = sys.argv[1]
if which == "op11":
    data = text.encode()
    del text
    row = pa.array([{"": True}])
    one = lambda x, t=None: pa.array([x], t)
    b = pa.RecordBatch.from_arrays([row, one(data), one("1"), one(b"k"), one(0, pa.int32()), *[one(h) for h in (7, 10**6, 0, 0)]], ["_row", "_text", "_id", "_key", "_part", "h1", "h2", "h3", "h4"])
    walked = fill_in_middle._assemble(False)(fill_in_middle._cut(50, 80)(iter([b])))
    assert sum(len(p.as_py()) for w in walked for p in w.column("piece") if p.is_valid) == len(data)
    size = len(data)
elif which == "op12":
    page = "<nav>x</nav><article>" + "".join(f"<p>{text[k:k + 2000]}" for k in range(0, len(text), 2000))
    size = len(page)
    assert html_extraction._packed(pa.array([page]))[0]["n_lines"].as_py() > 10_000
else:
    size = len(text)
    array = importance_resampling.gains(np.zeros(100, np.int64), np.ones(100, np.int64))
    list(importance_resampling.weights(array, 1)(iter([pa.array([text.encode()])])))
print(size >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("which", ["op11", "op12", "op13"])
def test_memory_of_a_very_long_text(which):
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", LARGE, which, root], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert int(out[0]) >= 55 and int(out[1]) < 1024, out
