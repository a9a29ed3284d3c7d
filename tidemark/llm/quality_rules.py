"""Quality rules as a bitmask ledger, with native functions only.

Method: every rule is evaluated once per document; the ledger stores one bit for each
rule that fails and the measurements.  Policies (named, versioned sets of rules) are
masks over the bits, so applying one or asking what a rule alone costs reads the
ledger and no text.

Texts of up to ``LONG`` bytes are measured within the row: no shuffle, no Python.  Longer
ones become rows of parts, cut after words (with the words that a part's last windows
reach into) and after lines, so that no task holds a whole text's words: counts add up
over parts, and windows and lines that occur twice are found by counting their hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import leading

from .common import boxed, unboxed, words, written

WINDOW = 8
LONG = 1 << 18  # bytes above which a text is measured in parts
PART = 1 << 17  # characters of a part; it ends with the word, or line, that it is in
DEALT = 16
SYMBOLS = "#*$%&|<>"

#: name -> condition under which the rule fails; the order gives the bits and only grows.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "short_or_long_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "shouting": "n_letters > 100 and 10 * n_upper > 5 * n_letters",
    "few_letters": "n_words > 0 and 2 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_words")
#: name -> version -> rules of the policy.
POLICIES: dict[str, dict[int, tuple[str, ...]]] = {
    "base": {1: BASE},
    "web": {1: (*BASE, "symbols", "repeated_lines"), 2: tuple(RULES)},
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _rolled(d: DataFrame) -> DataFrame:
    """``_hashes`` of single words made hashes of the WINDOW words from each place on, by
    doubling: every word is hashed once, then pairs, fours and eights of hashes (the last
    places hash what is left).  A projection for each step, so that none is made twice."""
    size = 1
    while size < WINDOW:
        d = d.withColumn("_hashes", F.zip_with("_hashes", F.slice("_hashes", size + 1, F.size("_hashes")), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return d


def _repeat_words() -> Column:
    """Words in windows of WINDOW words that occur twice or more.

    The hashes of all windows are made first; only where they are not all distinct
    are they sorted with their places, to find the windows that have an equal
    neighbour, and then the places in order, to add up what they cover.
    """
    return F.when(F.size("_windows") == F.size(F.array_distinct("_windows")), F.lit(0)).otherwise(_covered()).cast("long")


def _covered() -> Column:
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # after sorting by hash, keep what equals the element before or after it
    twice = F.transform(
        F.filter(
            F.arrays_zip(
                placed.alias("x"),
                F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice(placed, 1, F.size("_windows") - 1), lambda x: x["h"])).alias("before"),
                F.concat(F.transform(F.slice(placed, 2, F.size("_windows")), lambda x: x["h"]), F.array(F.lit(None).cast("long"))).alias("after"),
            ),
            lambda z: z["x"]["h"].eqNullSafe(z["before"]) | z["x"]["h"].eqNullSafe(z["after"]),
        ),
        lambda z: z["x"]["i"],
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        F.array_sort(twice),
        start,
        lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def _count(chars: str) -> Column:
    return F.regexp_count("_text", F.lit(chars))


def _added() -> dict[str, Column]:
    """Measures of ``_text`` that add up over its parts."""
    return {
        "word_chars": F.length("_text") - _count(r"[\x20\x09-\x0D]"),
        "n_symbols": _count(f"[{SYMBOLS}]"),
        "n_letters": F.length(F.regexp_replace("_text", r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")),
    }


def _windows() -> Column:
    n = F.size("_hashes")
    return F.when(n >= WINDOW, F.slice("_hashes", 1, F.greatest(n - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<long>"))


def _lines() -> Column:
    return F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _within_rows(d: DataFrame) -> DataFrame:
    """(_row, measures) of (_row, _text)."""
    d = _rolled(d.withColumn("_hashes", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w))))
    d = d.select("_row", "_text", F.size("_hashes").alias("n_words"), _windows().alias("_windows"), _lines().alias("_lines"))
    out = {"n_words": F.col("n_words"), **_added(), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": _repeat_words(), "n_lines": F.size("_lines")}
    return d.select("_row", *[out[k].cast("long").alias(k) for k in MEASURES])


def _parts(d: DataFrame, end: str) -> DataFrame:
    """(_key, part, _text): the texts of (_key, _text), each text once, in parts that go on
    until the characters ``end`` end."""
    # (?s) lets a part span lines
    cut = F.regexp_extract_all("_text", F.lit(rf"(?s)(.{{1,{PART}}}{end}*)"), F.lit(1))
    made = written(d.select("_key", F.posexplode(cut).alias("part", "_text")), "parts")
    return written(made.dropDuplicates(["_key", "part"]), "parts")


_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def _ahead(worded: DataFrame) -> DataFrame:
    """(_key, part, _begin, ahead): how many words are before a part, and the words that its
    last windows reach into.  Every part has a word, so they are in the next parts, as many."""
    first = F.regexp_extract("_text", rf"^(?:{_GAP}*{_WORD}+){{0,{WINDOW - 1}}}", 0)
    order = Window.partitionBy("_key").orderBy("part")
    d = worded.select("_key", "part", F.size("_own").alias("_size"), first.alias("_first"))
    begin = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return d.select("_key", "part", F.coalesce(begin, F.lit(0)).alias("_begin"), F.array_join(F.collect_list("_first").over(order.rowsBetween(1, WINDOW - 1)), " ").alias("ahead"))


def _over_parts(worded: DataFrame, lined: DataFrame) -> DataFrame:
    """(_key, measures) of texts in parts that end with words, and in parts that end with lines."""
    hashes = lambda c, n: F.transform(F.slice(words(F.col(c)), 1, n), lambda w: F.xxhash64(w))
    d = worded.withColumn("_own", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))
    counts = d.groupBy("_key").agg(F.sum(F.size("_own")).alias("n_words"), *[F.sum(c).alias(k) for k, c in _added().items()])
    d = d.where(F.size("_own") > 0)
    ahead = written(_ahead(d), "ahead")
    rolled = _rolled(d.select("_key", "part", "_own").join(ahead, ["_key", "part"]).select("_key", "part", "_begin", F.concat("_own", hashes("ahead", WINDOW - 1)).alias("_hashes")))
    windows = written(rolled.select("_key", "part", "_begin", F.posexplode(_windows()).alias("i", "h")).select("_key", "part", (F.col("_begin") + F.col("i")).alias("at"), "h"), "windows")
    twice = windows.groupBy("_key", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_key", "h", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_dealt"))
    hits = windows.withColumn("_dealt", F.col("part") % DEALT).join(twice, ["_key", "h", "_dealt"]).select("_key", "part", "at")
    hits = leading(hits, ["_key"], "part", ["at"], {"_next": "at"})
    repeats = hits.groupBy("_key").agg(F.sum(F.least(F.coalesce(F.col("_next") - F.col("at"), F.lit(WINDOW)), F.lit(WINDOW))).alias("n_repeat_words"))
    lines = lined.select("_key", F.explode(_lines()).alias("line")).groupBy("_key", F.md5(F.col("line").cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    lines = lines.groupBy("_key").agg(F.sum("c").alias("n_lines"), F.sum(F.col("c") - 1).alias("n_dup_lines"))
    d = counts.join(repeats, "_key", "left").join(lines, "_key", "left")
    return d.select("_key", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in MEASURES])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES (long); a clashing input column is replaced,
    others pass through under any name.

    Null text has no words, lines or characters; repeated rows get equal results; very
    long texts are measured whole, in parts; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    long = F.octet_length(text) > LONG
    short = _within_rows(boxed(docs.where(~long), _text=text))
    key = F.md5(text.cast("binary")).alias("_key")
    whole = docs.where(long).select(key, text.alias("_text"))
    if whole.isEmpty():
        return unboxed(_within_rows(boxed(docs, _text=text)), **{k: F.col(k) for k in MEASURES})
    found = written(_over_parts(_parts(whole, _WORD), _parts(whole, r"[^\n]")), "measures")
    rest = boxed(docs.where(long), _key=key).join(found, "_key").select("_row", *MEASURES)
    return unboxed(short.unionByName(rest), **{k: F.col(k) for k in MEASURES})


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``measured`` and ``failed`` (long): bit k set if rule k fails.

    Store it (``stored_ledger``) before filtering by it: a filter on an unstored ledger
    is pushed into it, and the measurements are made again for every rule.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())]
    return measured(docs, text_col).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def stored_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger as a table of the shared folder, without the texts."""
    return written(ledger(docs, text_col).drop(text_col), "ledger")


def passes(policy: str, version: int, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy][version])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str, version: int) -> DataFrame:
    """(rule, fails, fails_alone): documents that each rule rejects, and those that the
    policy would keep without it; one pass over the bits."""
    own = POLICIES[policy][version]
    m = mask(own)
    f = F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    sums = []
    for r in own:
        bit = F.lit(mask([r])).cast("long")
        sums += [F.sum((f.bitwiseAND(bit) != 0).cast("long")), F.sum((f == bit).cast("long"))]
    row = entries.agg(*[F.coalesce(s, F.lit(0)).alias(f"s{k}") for k, s in enumerate(sums)])
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"s{2 * k}").alias("fails"), F.col(f"s{2 * k + 1}").alias("fails_alone")) for k, r in enumerate(own)])
    return row.select(F.inline(each))


def stored_ablation(docs: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """``ablation`` of a policy over the stored ledger of whole texts."""
    return ablation(stored_ledger(docs), policy, version)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return stored_ledger(docs).select("doc_id", *MEASURES[:5], (~passes("base", 1)).alias("base_failed"), passes("web", 2).alias("kept"), "failed", *MEASURES[5:])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 7)) AS s(i) WHERE len(w) >= 8),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, unnest(generate_series(0, 7)) AS s(j) GROUP BY doc_id),
l AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(t, '\P{L}', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN rep USING (doc_id) JOIN l USING (doc_id)),
f AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
  + 4 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT + 8 * (5 * n_symbols > n_words)::INT
  + 16 * (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 32 * (n_letters > 100 AND 10 * n_upper > 5 * n_letters)::INT
  + 64 * (n_words > 0 AND 2 * n_letters < word_chars)::INT)::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""


def quality_rules_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the policy that op6 applies rejects, and rejects alone."""
    return stored_ablation(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ABLATION = f"""WITH f AS (SELECT failed FROM ({ORACLE})), r AS (SELECT unnest({list(RULES)}) AS rule, unnest(range({len(RULES)})) AS k)
SELECT rule, count(*) FILTER (WHERE failed & (1 << k::INT) <> 0) AS fails, count(*) FILTER (WHERE failed = (1 << k::INT)) AS fails_alone FROM r, f GROUP BY rule"""
