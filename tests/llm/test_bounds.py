"""Very long texts, long conversations and many languages within bounded memory; parts against the whole."""

import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, language_id, quality_rules
from test_llm import brute_rules

ROOT = str(Path(__file__).resolve().parents[2])


# --- quality rules in parts -------------------------------------------------------


@pytest.mark.parametrize("part", [1, 7, 30])
def test_rules_over_parts(spark, monkeypatch, part):
    """Texts cut after every few characters measure as whole ones do."""
    rng = random.Random(part)
    monkeypatch.setattr(quality_rules, "LONG", 20)
    monkeypatch.setattr(quality_rules, "PART", part)
    piece = lambda v: rng.choice([" ", "\n", " \t", "  "]) + rng.choice(["a", "b", "cc", "é", "漢字", "#"][:v])
    rows = [(k, "".join(piece(rng.choice([2, 3, 6])) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(500, rows[3][1]), (501, " \n" * 30), (502, "w" * 300), (503, "a b c d e f g h " * 20), (504, None), (505, "x\n" * 50), (506, ("q" * 70 + " ") * 30), (503, "a b c d e f g h " * 20)]
    got = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("own")))
    assert "_key" in got.columns
    assert Counter(tuple(r[c] for c in ("doc_id", *quality_rules.MEASURES[:5])) for r in got.collect()) == Counter((i, *brute_rules(t)) for i, t in rows)


# --- heaps ------------------------------------------------------------------------

LARGE = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from tidemark.llm import registry
from tidemark.session import local_session
spark = local_session(2, spark__driver__memory="1800m")
unit = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau. "
text = F.repeat(F.lit(unit), (int(sys.argv[3]) << 20) // len(unit))
at = tempfile.mkdtemp(prefix="spark-")
d = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang"))
d.write.parquet(at + "/documents.parquet")
d.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html")).write.parquet(at + "/pages.parquet")
d.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text").write.parquet(at + "/conversations.parquet")
query = next(f for k, f in registry.queries().items() if k.startswith(sys.argv[2] + "_"))
print(query(spark, at).count())
"""


@pytest.mark.parametrize("which,mb,rows", [("op3", 64, 1), ("op5", 32, 2), ("op6", 16, 1), ("op8", 32, 1)])
def test_a_very_long_text_fits_a_small_heap(which, mb, rows):
    out = subprocess.run([sys.executable, "-c", LARGE, ROOT, which, str(mb)], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) == rows


def test_a_long_conversation(spark, monkeypatch):
    """Examples dealt in many parts are the beginnings that turns written one by one give."""
    monkeypatch.setattr(chat_format, "PART", 5_000)
    n = 300
    rows = [(1, k, "user" if k % 3 else "assistant", f"<turn {k}> says \\ {'x' * (k % 7)}") for k in range(n)] + [(2, 0, "user", "only"), (None, 3, "assistant", None)]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["example"]): r for r in out.collect()}
    esc = lambda t: (t or "").replace("\\", "\\s").replace("<turn ", "\\lturn ").replace("</turn>", "\\l/turn>")
    said, k = "", 0
    for _, turn, role, text in rows[:n]:
        said += f"<turn {role}>\n{esc(text)}</turn>\n"
        if role == "assistant" or turn == n - 1:
            r = got[1, k]
            assert r["formatted"] == said and r["holds_all"] == (turn == n - 1)
            if role == "assistant":
                assert r["target_turn"] == turn and said[r["loss_start"] : r["loss_end"]] == esc(text)
            k += 1
    assert len(got) == k + 2 and got[2, 0]["target_turn"] is None and got[None, 0]["target_turn"] == 3
    back = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    assert back[1]["n_turns"] == n and back[1]["formatted_chars"] == sum(len(r["formatted"]) for (c, _), r in got.items() if c == 1)


# --- languages --------------------------------------------------------------------


def test_entries_are_bounded(spark):
    """Each language keeps its most frequent n-grams; all languages can still be predicted."""
    rng = random.Random(6)
    rows = [(10 * j + k, f"l{j:02d}", " ".join("".join(chr(0x4E00 + 100 * j + rng.randrange(12)) for _ in range(6)) for _ in range(60))) for j in range(12) for k in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model, _, _ = language_id.fit(d, entries=12 * 200)
    top = model.value.logs[language_id.ORDER]
    assert len(model.value.langs) == 12 and np.bincount(top.langs).max() <= 200 and len(top.values) <= 12 * 200
    assert sum(len(e.values) for e in (*model.value.logs.values(), *model.value.weight.values())) <= 8 * 12 * 200
    got = language_id.identify(d, (model, 0.1, {})).selectExpr("avg(cast(language.lang_pred = lang as double)) as right").first()["right"]
    assert got > 0.95
    fullest = language_id.fit(d)[0].value
    assert len(fullest.logs[language_id.ORDER].values) > len(top.values)


def test_calibration_against_brute_force(spark):
    rng = np.random.default_rng(5)
    langs, own, e = ["a", "b", "c"], rng.integers(0, 3, 200), rng.normal(2.5, 0.3, (200, 3))
    e[np.arange(200), own] -= 0.5
    own[own == 2] = np.where(rng.random((own == 2).sum()) < 0.8, 0, 2)  # a language with few rows
    loss = language_id.losses(own, e)
    for k in (0, 17, 39):
        t = language_id.TEMPERATURES[k]
        for i in (0, 50, 199):
            p = [math.exp(-(x - min(e[i])) / t) for x in e[i]]
            assert math.isclose(loss[i, k], -math.log(max(p[own[i]] / sum(p), 1e-12)), rel_tol=1e-9, abs_tol=1e-12)
    rows = [(langs[j], float(e[i, j]), [float(x) for x in loss[i]]) for i, j in enumerate(own)]
    temperature, limits = language_id.calibrated(spark.createDataFrame(rows, "lang string, own double, loss array<double>"))
    assert temperature == language_id.TEMPERATURES[int(np.argmin(loss.mean(axis=0)))]
    assert set(limits) == {langs[j] for j in range(3) if (own == j).sum() >= 20}
    for lang, limit in limits.items():
        mine = e[own == langs.index(lang), langs.index(lang)]
        assert math.isclose(limit, np.quantile(mine, language_id.REJECT) + 3 * mine.std(), rel_tol=1e-9)
    assert language_id.calibrated(spark.createDataFrame([], "lang string, own double, loss array<double>")) == (0.1, {})


def test_rejection_of_a_language_never_seen(spark):
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(80))
    rows = [(k, lang, text(letters)) for k in range(240) for lang, letters in (("a", "abcdefg"), ("b", "hijklmn"))]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    fitted = language_id.fit(d)
    assert set(fitted[2]) == {"a", "b"}
    asked = spark.createDataFrame([(1, text("abcdefg")), (2, text("hijklmn")), (3, text("opqrstu"))], "doc_id long, text string")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(asked, fitted).collect()}
    assert (got[1]["lang_pred"], got[1]["rejected"], got[2]["lang_pred"], got[2]["rejected"]) == ("a", False, "b", False) and got[3]["rejected"]
