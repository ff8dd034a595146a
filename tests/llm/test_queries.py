"""The registered queries: against DuckDB where SQL can express them, and the pipeline against a plain version."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from evalgrove.llm import quality_rules, secrets
from evalgrove.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_near_copies import kept
from tests.llm.test_small import split
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_whole_table(spark, name):
    if name != "op6_chat_formatting":
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def kept_by_rules(text):
    w, lines = split(text), [x for x in text.split("\n") if split(x)]
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(five)
    again = {p for k, s in enumerate(five) if count[s] > 1 for p in range(k, k + 5)}
    forms = set(quality_rules.stop_forms())
    chars = sum(map(len, w))
    if len(w) < 10 or 100 * len(again) > 20 * len(w):
        return False
    upper = sum(c.isupper() for c in text)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return 1.5 <= chars / len(w) <= 16 and symbols / len(w) <= 0.1 and 100 * (sum(x in forms for x in w) + 1) / (sum(bool(re.fullmatch(r"[^\W\d_]+[,.]?", x)) for x in w) + 1) >= 4 and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and upper / chars <= 0.4


def docs_of(docs):
    return [(d[0], d[1]) for d in docs]


def test_pipeline_equals_a_plain_version(spark):
    import public_tokenizers as P
    import tiktoken

    from evalgrove.llm import bpe

    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    docs = [d for d in docs if kept_by_rules(d[1])]
    first = set(kept(docs_of(docs)))  # five-word shingles, similarity of 0.8 or more
    docs = [d for d in docs if d[0] in first]
    novelty = secrets.Novelty()
    docs = [(i, secrets.redacted(t, secrets.find(t, novelty)), lang, s) for i, t, lang, s in docs]
    size = {d[0]: len(split(d[1])) for d in docs}
    sources = sorted({d[3] for d in docs})
    own = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(own.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * own[s]}
        if not full:
            break
        target |= {s: 2.0 * own[s] for s in full}
        left, open_ = left - sum(2.0 * own[s] for s in full), open_ - full
    target |= {s: level * weight[s] for s in open_}
    codec = bpe.Codec(bpe.read_vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for i, text, lang, s in docs:
        rate = min(2.0, target[s] / own[s])
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        ids = ref.encode_ordinary(text)
        want += [(i, lang, s, len(ids), tuple(ids))] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_held_out_toxicity(spark):
    """Accuracy on documents whose labels were never seen, at the next larger size."""
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op2_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in scored)
    assert hit >= 0.9 * sum(r.predicted == 1 for r in scored)
    assert hit >= 0.7 * sum(r.toxic == 1 for r in scored)
