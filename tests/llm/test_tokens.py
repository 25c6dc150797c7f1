"""Token counts against the library, and the transducer against plain merging for random vocabularies."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm import tokens


@pytest.fixture(scope="module")
def pair():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), tokens.Counter(tokens.load(path))


def check(pair, texts):
    got = pair[1].count([t.encode() for t in texts])
    assert got.tolist() == [len(e.ids) for e in pair[0].encode_batch(texts, add_special_tokens=False)]


def test_random_texts(pair):
    rnd = random.Random(1)
    check(pair, ["".join(rnd.choices("abcdeé 'stlremdv\n \t1230!?-—日本語<|endoftext|>", k=rnd.randint(0, 80))) for _ in range(5000)])
    check(pair, ["x<|endoftext|>y", "<|endoftext|>" * 3, "don't we'll I've", "", " ", "\n\n a"])
    check(pair, ["".join(map(chr, range(a, min(a + 500, 0xD800)))) for a in range(1, 0xD800, 500)])


def test_long_pieces(pair):
    rnd = random.Random(2)
    check(pair, ["a" * n for n in (1, 2, 3, 127, 128, 129, 4095, 4096, 4097, 9000)])
    check(pair, ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), "=" * 9000 + " " * 9000 + "x" + "-" * 9001, "ab" * 9000, "é" * 6000, "日本" * 3000, "abc" * 5001])


def merged(text, rank):
    """Plain merging: the best pair, everywhere from the left, until there is none."""
    s = [bytes([b]) for b in text]
    while True:
        best = min(((rank[a + b], a, b) for a, b in zip(s, s[1:]) if (a, b) in rank["pairs"] and a + b in rank), default=None)
        if best is None:
            return s
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == best[1:]:
                out.append(s[i] + s[i + 1])
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out


@pytest.mark.parametrize("seed", range(25))
def test_transducer_of_random_merges(seed):
    """Vocabularies of a few letters, with tokens that no text's result has."""
    rnd = random.Random(seed)
    made, rank, merges = [bytes([b]) for b in range(256)], {"pairs": set()}, []
    known = list(b"ab" if seed % 2 else b"abc")
    known = [bytes([b]) for b in known]
    for _ in range(rnd.randint(0, 25)):
        a, b = rnd.choice(known), rnd.choice(known)
        if a + b not in rank and len(a + b) <= 12:
            rank[a + b] = len(merges)
            rank["pairs"].add((a, b))
            merges.append((made.index(a), made.index(b), len(made)))
            made.append(a + b)
            known.append(a + b)
    m = tokens.compiled(merges, list(range(256)))
    texts = [bytes(rnd.choices(b"ab" if seed % 2 else b"abc", k=rnd.randint(1, 40))) for _ in range(200)]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    want = [merged(t, rank) for t in texts]
    assert tokens.piece_counts(m, buf, start, end).tolist() == [len(w) for w in want]
    last, _, base = tokens.last_tokens(m, buf, start, end)
    assert [made[t] for t in last[base[1:] - 1].tolist()] == [w[-1] for w in want]


def test_chunks_of_long_pieces_agree(monkeypatch):
    """Chunks that begin in another state than guessed are run again."""
    monkeypatch.setattr(tokens, "PART", 40)
    monkeypatch.setattr(tokens, "AHEAD", 3)
    made, rank, merges = [bytes([b]) for b in range(256)], {"pairs": set()}, []
    for a, b in ((b"a", b"a"), (b"aa", b"aa"), (b"aa", b"a"), (b"b", b"a"), (b"aaaa", b"b")):
        rank[a + b] = len(merges)
        rank["pairs"].add((a, b))
        merges.append((made.index(a), made.index(b), len(made)))
        made.append(a + b)
    m, rnd = tokens.compiled(merges, list(range(256))), random.Random(3)
    for text in (b"a" * 333, b"ab" * 200, bytes(rnd.choices(b"aaab", k=1000)), b"a" * 41):
        got = tokens.piece_counts(m, np.frombuffer(text, dtype=np.uint8), np.array([0]), np.array([len(text)]))
        assert got.tolist() == [len(merged(text, rank))]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 1025), (5, "word " * 1024), (6, "y" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    want = [(str(i), len(t or ""), n := len(exact.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted((str(r[0]), *r[1:]) for r in tokens.count_tokens(df, path).collect()) == sorted(want)
    assert {w[3] for w in want} == {True, False}
    assert tokens.count_tokens(df.where("false"), path).count() == 0
