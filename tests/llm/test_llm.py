"""Each operator on a small fixture with odd rows against brute force, an exact library, or held-out accuracy."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_pii import base
from tokenizers import Tokenizer

from kindred.llm import decontamination, embedding_dedup, html_text, near_dedup, pii, suffix_dedup, tokens

ODD = [(10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "ab" * 700), (10_004, "one two"), (10_005, "one two"), (10_005, "one two"), (10_006, "x" * 450), (10_006, "mail a@b.co"), (None, "one two"), (10_007, "Ünï 'll <|endoftext|> 😀 " * 40)]


@pytest.fixture(scope="module")
def docs(spark, data):
    """All documents of the smallest tables and odd rows, with extra columns of clashing names."""
    base = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], base.schema)
    return base.union(odd).withColumn("rid", F.lit("x")).withColumn("size", F.lit(1)).withColumn("node", F.lit(2)).withColumn("key", F.lit("k")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


def plain_shingles(text):
    """Runs of four words, lower-cased in A-Z only, as tuples; shorter texts are one run."""
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def test_near_duplicates(docs, rows):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [(i, plain_shingles(t or "")) for i, t, *_ in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    got = near_dedup.near_duplicates(docs, near_dedup.NearParams(words=4)).collect()
    want = sorted((str(i), len(s), str(None if i is None else top(i)), i is None or top(i) == i) for i, s in sets)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_chunks_cover_every_error_pattern():
    for symbols, most in ((64, 24), (16, 3), (20, 4)):
        cut = near_dedup.chunks(symbols, most)
        assert sum(e + 1 for *_, e in cut) == most + 1 and sum(n for _, n, _ in cut) == symbols


def test_repeats(docs, rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = {}
    for _, b in texts:
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    want = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(want)
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_vectors_of_many_lengths(spark):
    """Two like vectors of each of 66 lengths link, and one of a length of its own links with nothing."""
    rng = np.random.default_rng(2)
    rows = [v for d in range(2, 68) for v in [rng.standard_normal(d)] for v in (v, v * (1 + 0.001 * rng.random(d)))]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*rows, rng.standard_normal(90)])], "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(133)] == [1] * 132 + [0]
    assert all(got[i].component_id == i - i % 2 for i in range(133))


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs, path).collect()
    want = [(str(i), len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_html_drawn_text_and_selects():
    text = lambda page: html_text.render(page)[0]
    assert text("<p>a <svg><title>no</title><defs><text>no</text></defs><desc/><text>one</text><text>two</text></svg> b") == "a one two b"
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>.") == "if x=1."
    assert text("in <select><option>one<option selected>two</option><option>three</select> days") == "in two days"
    assert text("in <select><optgroup label=x><option disabled>one<option>two</optgroup></select> days") == "in two days"
    assert text("<select multiple><option>one<option>two</select>") == "one\ntwo"


def test_pii(docs, rows):
    assert pii.find_pii(docs).columns == [*docs.columns, "base", "added"] and pii.redact(docs).columns == docs.columns
    got = pii.digest(pii.find_pii(docs)).collect()
    want = [(str(i), hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in base(t)).encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted(want)


def test_leaks(spark, data, docs, rows):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    plain = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    true = {(i, k) for i, t, *_ in rows for k, x in items if x in plain(t or "")}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert len(true - got) <= 0.05 * len(true)
    assert decontamination.common([1, 2, 3, 4], [9, 2, 4, 3]) == 2


def test_leaks_of_a_large_benchmark(spark):
    """Copies of 5,000 items are all found, verbatim and, for a part, with one word in ten replaced."""
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    draw = lambda n: vocabulary[(20_000 * rng.random(n) ** 3).astype(int)]
    items = [list(draw(n)) for n in rng.integers(15, 60, 5_000)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    texts, true = [], set()
    for i, x in enumerate(items):
        if i % 10 == 0:
            x = [f"other{i}" if j % 10 == 5 else y for j, y in enumerate(x)]
        texts.append((i, " ".join([*draw(rng.integers(0, 40)), *x, *draw(rng.integers(0, 40))])))
        true.add((i, i))
    texts += [(10_000 + i, " ".join(draw(60))) for i in range(500)]
    got = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert not true - found
    assert not [f for f in found if f[0] >= 10_000]


