"""Main text of web pages: the article without what surrounds it.

Method: nearest-URL page differencing.  Every page becomes a list of text lines, one for
each block of its markup.  Pages of a host are ordered by the parts of their URL path, so
that a page's neighbours in that order are the pages with the nearest URLs; the lines of
a page and of its nearer neighbour are aligned by their longest common subsequence, and
lines that both have are the template's: they are deleted.  If the pages are copies of
each other (nearly all text is shared), the alignment says nothing of a template and the
other neighbour is asked; if that is a copy too, nothing is deleted.

The markup has the first word where it speaks.  Lines inside navigation, headers,
footers, asides, forms, scripts, and containers whose class, id or role names one of
those or a notice, an advert or reader comments, are never text of the article.  Lines
inside a declared article (``article`` or an article body) always are: articles share
quotations and passages with their neighbours too, and nothing of them may be dropped.
On a page that declares none, differencing decides over what is left (of ``main``, if
there is one).  For every page the result says which page it was compared with and how
many of its lines are shared.

Only hashes of the lines travel to the neighbour: pages are ordered by host and path in
ranges (a host may hold a third of all pages), each range's first and last page are
carried over its edges, and page numbers meet the hashes by joins.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import lagged, leading

from .common import ranged, small_batches, written

# --- markup to lines --------------------------------------------------------------

#: a comment, a declaration, a tag with quoted attributes, or a tag cut off by the end
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_SPACED = frozenset("br td th option".split())
#: elements whose text is never the article's; an article may stand in the second kind, where it was left open or wraps the page
_NEVER = frozenset("aside footer search button select datalist dialog template svg math canvas object audio video menu label".split())
_OPENED = frozenset("head nav header form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open element of these kinds ends where one of the named begins
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
_LISTS = frozenset("ul ol dl table".split())

#: fixed words: parts of a class, id or role that name what surrounds an article
SURROUNDINGS = frozenset(
    """ad ads adsense advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist
    complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header masthead menu modal nav navbar
    navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommendations recommended
    related replies respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar
    topbar""".split()
)
_NOT_OWN = frozenset("has with without no is show hide".split())  # "has-sidebar" is no sidebar
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: what the markup says of a line; TITLE is a header inside an article, of which only headings are the article's
SURROUNDS, TITLE, UNSAID, MAIN, ARTICLE = range(-2, 3)
_MAYBE = -3  # surroundings in which an article may yet begin


def _named(names: str) -> bool:
    """Whether one of the names in a class, id or role is that of a surrounding."""
    for name in names.split():
        parts = [p.lower() for p in _NAMES.findall(name)]
        if any(p in SURROUNDINGS and not (k and parts[k - 1] in _NOT_OWN) for k, p in enumerate(parts)):
            return True
    return False


def _says(tag: str, attributes: str, inside: int) -> int:
    """What an element says of its text, given what the elements around it say."""
    if inside == SURROUNDS:
        return SURROUNDS
    if inside == TITLE:
        return ARTICLE if tag in _HEADINGS else TITLE
    if tag in _NEVER:
        return SURROUNDS
    if tag in _OPENED:
        return _MAYBE if inside != ARTICLE else TITLE if tag == "header" else SURROUNDS
    role = prop = ""
    if attributes and tag not in ("html", "body"):
        a = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)}
        role, prop = a.get("role", "").lower(), a.get("itemprop", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
            return SURROUNDS
        names = f"{a.get('class', '')} {a.get('id', '')} {role}"
        if tag not in _HEADINGS and names.strip() and _named(names):
            return SURROUNDS
    if tag == "article" or role == "article" or prop == "articlebody":
        return ARTICLE
    if tag == "main" or role == "main":
        return max(inside, MAIN)
    return inside


def lines(page: str) -> list[tuple[int, str]]:
    """(what the markup says, text) of every block of a page, in page order; white space is
    one space, character references are decoded, empty blocks are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[tuple[int, str]] = []  # what the block at hand has so far

    def close() -> None:
        if len(held) == 1:
            said, text = held.pop()
            if text := " ".join(text.split()):
                out.append((said if said >= UNSAID else SURROUNDS, text))
        for own in (False, True) if held else ():
            part = [(said, text) for said, text in held if (said >= UNSAID) == own]
            if text := " ".join("".join(t for _, t in part).split()):
                out.append((max(said for said, _ in part) if own else SURROUNDS, text))
        held.clear()

    def last(wanted) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in wanted:
                return k
        return -1

    def opened(tag: str) -> None:
        """End what a block's beginning ends: the head, a paragraph with the formatting left
        open in it, an item of the same list."""
        close()
        if stack and tag == "body":
            stack.clear()
        if any(t == "head" for t, _ in stack[:2]) and tag != "head":  # under html, if anywhere
            del stack[last(("head",)) :]
        if (k := last(_BLOCK)) >= 0 and stack[k][0] == "p":
            del stack[k:]
        if kinds := _CLOSES.get(tag):
            k = last(_LISTS | kinds)
            if k >= 0 and stack[k][0] not in _LISTS:
                del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if text := page[at : m.start() if m else n]:
            held.append((stack[-1][1] if stack else UNSAID, html.unescape(text)))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK:
                close()
            k = last((tag,))
            # a stray end of formatting closes no block
            if k >= 0 and (tag in _BLOCK or not any(t in _BLOCK for t, _ in stack[k + 1 :])):
                del stack[k:]
            continue
        if tag in _BLOCK:
            opened(tag)
        elif tag in _SPACED:
            held.append((stack[-1][1] if stack else UNSAID, " "))
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else n
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append((tag, _says(tag, m[3], stack[-1][1] if stack else UNSAID)))
    close()
    return out


# --- alignment --------------------------------------------------------------------


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Longest common subsequence of ``a`` with every beginning of ``b``; b's places are bits
    of one number, so a step handles them all."""
    m = len(b)
    full = (1 << m) - 1
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.append(0, np.cumsum(bits == 0))


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in one longest common subsequence with ``b``: halves of ``a`` against the
    best cut of ``b``, so memory stays in proportion to the lines."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                found.append(a0)
            continue
        mid = (a0 + a1) // 2
        ahead = _lengths(a[a0:mid], b[b0:b1])
        back = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((ahead + back).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(found)


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each line of ``a`` is in the longest common subsequence with ``b``."""
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    tail = int(np.argmin(np.append((a[::-1][: n - head] == b[::-1][: n - head]), False)))
    out[:head] = out[len(a) - tail :] = True
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    at = np.flatnonzero(np.isin(own, other))  # lines of one page only are in no common sequence
    other = other[np.isin(other, own)]
    out[head + at[_aligned(own[at].tolist(), other.tolist())]] = True
    return out


COPY = 0.8  # share of the text from which two pages count as copies of each other
_BYTES = 6  # of a line's hash


def _unpacked(hashes: bytes) -> np.ndarray:
    out = np.zeros((len(hashes) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(hashes, np.uint8).reshape(-1, _BYTES)
    return out.view(np.int64).ravel()


def _differences(own: pa.Array, sizes: pa.Array, other: pa.Array) -> pa.Array:
    """The lines that each page shares with the other one; null if they are copies."""
    shared = []
    for a, c, b in zip(own, sizes, other):
        c = np.frombuffer(c.as_py(), np.uint8).astype(np.int64)
        both = shared_lines(_unpacked(a.as_py()), _unpacked(b.as_py()))
        copy = c.sum() and c[both].sum() >= COPY * c.sum()
        shared.append(None if copy else np.flatnonzero(both).tolist())
    return pa.array(shared, pa.list_(pa.int32()))


# --- pages ------------------------------------------------------------------------


def _hashed(page: pa.Array) -> pa.Array:
    """A hash of every line, its characters up to 255 (0: surroundings), as bytes, and a digest of all lines."""
    hashes, sizes, digests = [], [], []
    for p in page:
        found = lines(p.as_py() or "")
        hashes.append(b"".join(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=_BYTES).digest() for _, t in found))
        sizes.append(bytes(min(len(t), 255) if said >= UNSAID else 0 for said, t in found))
        digests.append(_digest(found))
    return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in (hashes, sizes, digests)], ["hashes", "sizes", "digest"])


def _digest(found: list[tuple[int, str]]) -> bytes:
    return hashlib.blake2b("\n".join(t for _, t in found).encode("utf-8", "replace"), digest_size=16).digest()


def _packed(page: pa.Array) -> pa.Array:
    """The lines that may be kept, compressed (empty: not to be kept), their number, whether
    the markup declares them the article, and the digest of all lines."""
    packed, number, declared, digests = [], [], [], []
    for p in page:
        found = lines(p.as_py() or "")
        most = max((said for said, _ in found), default=UNSAID)
        kept = "\n".join(t if said >= UNSAID and said == most else "" for said, t in found)
        packed.append(zlib.compress(kept.encode("utf-8", "replace"), 6))
        number.append(len(found))
        declared.append(most == ARTICLE)
        digests.append(_digest(found))
    return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(number, pa.int64()), pa.array(declared), pa.array(digests, pa.binary())], ["packed", "n_lines", "declared", "digest"])


def _texts(packed: pa.Array, declared: pa.Array, shared: pa.Array) -> pa.Array:
    """The kept lines of each page, without those that its neighbour shares unless the
    markup declares them the article."""
    out = []
    for p, d, s in zip(packed, declared, shared):
        gone = set() if d.as_py() else set(s.as_py() or ())
        out.append("\n\n".join(t for k, t in enumerate(zlib.decompress(p.as_py()).decode().split("\n")) if t and k not in gone))
    return pa.array(out, pa.string())


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """The parts of a URL's path, without query, fragment and empty parts."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _alike(a: str, b: str) -> Column:
    """Number of leading parts that two paths have in common."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), start, step, lambda s: s["n"])


def neighbours(urls: DataFrame) -> DataFrame:
    """(_key, near, far): for pages (_key, host, path, _block; ``ranged`` by host, path and
    key) the two beside each in that order on its host, that with more leading parts in
    common first; pages without host have none."""
    d = urls.where("host is not null").select("_key", "host", "path", "_block")
    cols = {"key": "_key", "path": "path"}
    d = lagged(d, ["host"], "_block", ["path", "_key"], {f"p_{k}": c for k, c in cols.items()})
    d = leading(d, ["host"], "_block", ["path", "_key"], {f"n_{k}": c for k, c in cols.items()})
    after = F.col("p_key").isNull() | (_alike("path", "n_path") > _alike("path", "p_path"))
    return d.select("_key", F.when(after, F.col("n_key")).otherwise(F.col("p_key")).alias("near"), F.when(after, F.col("p_key")).otherwise(F.col("n_key")).alias("far"))


def _key(host: Column, digest: Column) -> Column:
    """Pages of one host with equal lines have one key; null without a host."""
    return F.unhex(F.md5(F.concat(host.cast("binary"), digest)))


def compared(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_key, nearest, shared): for the pages of a key the id of the page they were compared
    with and the numbers of the lines they share; pages compared with none are left out.

    Pages of one host with equal lines are one page, at the first of their URLs: a copy
    beside a page says nothing of its template.
    """
    url, page = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    d = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), page.alias("page")).where("host is not null")
    d = d.select("_id", "host", "path", F.arrow_udf(_hashed, "hashes binary, sizes binary, digest binary")("page").alias("h"))
    d = d.withColumn("_key", _key(F.col("host"), F.col("h.digest"))).groupBy("_key").agg(F.min_by(F.struct("host", "path", "_id", "h.hashes", "h.sizes"), F.struct("path", "_id")).alias("p"))
    d = ranged(d.select("_key", "p.*"), "lines", F.asc("host"), F.asc("path"), F.asc("_key"))
    own = d.select("_key", "hashes", "sizes")
    other = lambda at: d.select(F.col("_key").alias(at), F.col("_id").alias("nearest"), F.col("hashes").alias("others"))
    differences = F.arrow_udf(_differences, "array<int>")("hashes", "sizes", "others").alias("shared")
    pairs = neighbours(d)
    first = pairs.where("near is not null").join(own, "_key").join(other("near"), "near").select("_key", "far", "nearest", differences)
    first = written(first, "compared")
    # nor does a page that is nearly a copy, so the other neighbour is asked
    second = first.where("shared is null and far is not null").select("_key", "far").join(own, "_key").join(other("far"), "far")
    return first.where("shared is not null").select("_key", "nearest", "shared").unionByName(second.select("_key", "nearest", differences).where("shared is not null"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (blocks joined by an empty line; empty if
    none), ``n_chars`` (its code points), ``nearest`` (id of the page compared with, null if
    none), ``n_lines`` and ``n_shared``; these replace input columns of their names.

    Null and empty pages have no line; pages without a URL, alone on their host, or
    between pages that are nearly copies are compared with none and lose no line; equal
    pages of a host get equal results; very long pages are aligned in memory that grows
    with their lines; ids may be of any type; an empty table gives an empty one.

    Texts are packed for the one shuffle that brings a page's decision to it.
    """
    small_batches(pages.sparkSession, 500, 8 << 20)
    url, page = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    decided = written(compared(pages, id_col, url_col, html_col), "decided")
    own = F.struct(F.lit(True).alias(""), *[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("_row")
    d = pages.select(host_of(url).alias("host"), own, F.arrow_udf(_packed, "packed binary, n_lines long, declared boolean, digest binary")(page).alias("p"))
    d = d.select(_key(F.col("host"), F.col("p.digest")).alias("_key"), "_row", "p.packed", "p.n_lines", "p.declared").join(decided, "_key", "left")
    d = d.withColumn("text", F.arrow_udf(_texts, "string")("packed", "declared", "shared"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long"), "nearest": F.col("nearest"), "n_lines": F.col("n_lines"), "n_shared": F.coalesce(F.size("shared"), F.lit(0)).cast("long")}
    keep = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c != html_col and c not in new]
    return d.select(*keep, *[c.alias(k) for k, c in new.items()])


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
