"""Novelty of planted keys against identifiers, base spans against a plain search, and odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from evalgrove.llm import secrets

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"base64": UPPER + LOWER + DIGITS + "+/", "mixed": UPPER + LOWER + DIGITS, "lower": LOWER + DIGITS, "letters": UPPER + LOWER}
BEFORE = ["the auth key is ", "AWS_SECRET_ACCESS_KEY=", "my login credential: ", "curl -H 'X-Auth: ", "signature="]
NAMES = "config user session payment invoice product weather holiday kitchen address window storage customer shipping calendar message picture harbour journey balance".split()
WORDS = ["internationalization", "Wirtschaftswissenschaften", "incomprehensible", "constitutionnel", "desarrolladores", "responsabilidades", "misunderstanding", "Zusammenarbeit"]


def texts():
    """(text, the planted key or None)"""
    rng, out = random.Random(4), []
    for k in range(400):
        own = "".join(rng.choice(ALPHABETS[list(ALPHABETS)[k % 4]]) for _ in range(rng.choice([12, 16, 20, 24, 32, 40])))
        out.append((rng.choice(BEFORE) + own + " for the old server", own))
        parts = [rng.choice(NAMES) for _ in range(rng.randint(2, 4))]
        name = [lambda: parts[0] + "".join(p.title() for p in parts[1:]), lambda: "_".join(parts), lambda: "-".join(parts), lambda: "/".join(parts), lambda: "_".join(parts).upper(), lambda: rng.choice(WORDS)][k % 6]()
        out.append((rng.choice(BEFORE) + name + (str(rng.randint(1, 99)) if k % 4 == 0 else "") + " for the old server", None))
    return out


def test_precision_and_recall_of_novelty():
    novelty, hit, false, keys = secrets.Novelty(), 0, 0, 0
    for text, own in texts():
        found = [text[a:b] for a, b, kind in secrets.find(text, novelty) if kind == "novel"]
        keys += own is not None
        hit += own is not None and own in found
        false += sum(x != own for x in found)
    print(f'recall {hit / keys:.3f}, precision {hit / (hit + false):.3f}')
    assert hit >= 0.9 * keys and hit >= 0.9 * (hit + false)


def plain_base(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, n) in enumerate(kinds) for m in re.finditer(p, text, re.ASCII) if len(m[m.lastindex]) >= n]
    return [x for _, _, x in sorted(found)]


def test_base_spans_equal_a_plain_search_on_whole_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    found = {r.doc_id: r.spans for r in secrets.span_digests(spark.read.parquet(path)).collect()}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall():
        assert [x for x in found[i].split(",") if x and not x.startswith("novel")] == plain_base(t or "")


def test_words_of_the_corpus_are_not_novel():
    """No word of letters in a sensitive context is taken for a key."""
    novelty, n = secrets.Novelty(), 0
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall():
        n += sum(kind == "novel" and t[a:b].isalpha() for a, b, kind in secrets.find(t, novelty))
    assert n <= 2


@pytest.mark.parametrize("key", ["8fJ2kQ9xZ7vB4nM1pL6t", "qXvTbKzLwPmRjHsYdNcG", "k3J9xQ2vB7mZ", "zK4+Qm9/Tx1Rv8Lp"])
def test_short_and_letter_only_keys(key):
    text = f"the private key is {key} and"
    assert [(a, b) for a, b, _ in secrets.find(text, secrets.Novelty())] == [(19, 19 + len(key))]


def test_very_long_texts_repeated_rows_and_clashing_columns(spark):
    long = "plain words here " * 100_000 + "the auth key is 8fJ2kQ9xZ7vB4nM1pL6t " + "and more " * 50_000
    rows = [(1, long), (1, long), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("spans", F.lit("mine")).withColumn("t", F.lit(1))
    scanned = secrets.scan(df)
    assert scanned.columns == ["doc_id", "text", "t", "spans"]
    got = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in scanned.collect())
    start = long.index("8fJ2")
    assert got == [(1, [("novel", start, start + 20)])] * 2 + [(2, [])] * 2 + [(3, [])]
    clean = secrets.redact(df)
    assert clean.columns == df.columns and {r.text for r in clean.filter("doc_id = 1").collect()} == {long.replace("8fJ2kQ9xZ7vB4nM1pL6t", "[NOVEL REMOVED]")}
    assert secrets.span_digests(df).filter("n_novel = 1").count() == 2
