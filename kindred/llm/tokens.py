"""Token counts of a byte-level BPE tokenizer, by finite-state transduction.

Splitting: the tokenizer's split pattern is compiled to a deterministic transducer over
classes of code points. Each transition says whether a piece begins at the character read,
at the one before, or at both. A batch of texts is cut into chunks; each chunk's map from
every start state to its end state is computed for all chunks at once; the maps compose
through a parallel prefix scan, which gives each chunk its start state; then the boundaries
are read off.

Counting: merging is finite-state too. The last token of what the merges make of each prefix
of a piece follows from the bytes before, within the longest token's length: of the tokens
that the prefix ends with, it is the one that the merges leave standing next to the last
token of what is before it, and there is just one (two tokens stand side by side if no merge
across their border comes before the merges that make them). So a transition reads a byte,
moves to the last tokens of the latest prefixes, and its count is that of the prefix before
its token and one. Tokens that end at a place come from a trie of the vocabulary; the
transducer runs over all new pieces of a batch in step. Pieces longer than a chunk are cut,
each chunk is run from some way ahead, and a chunk's map holds if it starts in the state that
the chunk before ends in; else it is run again from there. Counts of pieces are kept by
their bytes in a table of bounded size.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.text import _INV, BASE, TABLE, U, mix, powers, slices

# Classes of characters; the lower-case letters that can end a contraction are classes of their own.
END, LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, STMD, R, V, LL, E = range(12)
# States: what the piece being read is. BLANK1 and SPACE1 are one white space so far, BLANK2 and SPACE2 more; AR, AV and AL are a quote and one letter.
(START, S_LETTER, S_NUMBER, S_OTHER, SPACE1, BLANK1, SPACE2, BLANK2, S_QUOTE, AR, AV, AL, DONE) = range(13)
#: Bits of a transition's output: a piece begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2
_CHUNK = 128
#: Pieces whose counts a worker keeps.
KEPT = 1_000_000
#: Bytes of a chunk of a long piece, and how far ahead of it it is run.
PART, AHEAD = 4096, 1024
_NONE = np.int64(1 << 40)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for chars, k in (("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E)):
        out[[ord(c) for c in chars]] = k
    return out


@cache
def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs, state * 12 + class."""
    letters = {LETTER, STMD, R, V, LL, E}
    step, out = np.zeros((13, 12), dtype=np.uint8), np.zeros((13, 12), dtype=np.uint8)
    fresh = {END: START, NUMBER: S_NUMBER, SPACE: SPACE1, BLANK: BLANK1, QUOTE: S_QUOTE, OTHER: S_OTHER} | dict.fromkeys(letters, S_LETTER)
    after_space = fresh | {QUOTE: S_OTHER}
    for s in range(13):
        for c in range(12):
            to, o = fresh[c], HERE
            if (s == S_LETTER and c in letters) or (s == S_NUMBER and c == NUMBER) or (s == S_OTHER and c in (OTHER, QUOTE)):
                to, o = s, 0
            elif s in (SPACE1, BLANK1, SPACE2, BLANK2) and c in (SPACE, BLANK):
                to, o = (SPACE2 if c == SPACE else BLANK2), 0
            elif s == SPACE1 and c != END:
                to, o = after_space[c], 0
            elif s == SPACE2 and c != END:
                to, o = after_space[c], BEFORE
            elif s == BLANK2 and c != END:
                o = HERE | BEFORE
            elif s == S_QUOTE and c in (OTHER, QUOTE):
                to, o = S_OTHER, 0
            elif s == S_QUOTE and c in (STMD, R, V, LL):
                to, o = {STMD: DONE, R: AR, V: AV, LL: AL}[c], 0
            elif (s in (AR, AV) and c == E) or (s == AL and c == LL):
                to, o = DONE, 0
            elif s in (AR, AV, AL):
                to, o = (S_LETTER, BEFORE) if c in letters else (to, HERE | BEFORE)
            step[s, c], out[s, c] = to, o
    return step.ravel(), out.ravel()


def outputs(kind: np.ndarray) -> np.ndarray:
    """The transducer's output at each character of a class sequence, from START."""
    step, out = split_transducer()
    n = -(-len(kind) // _CHUNK)
    cls = np.full(n * _CHUNK, END, dtype=np.int16)
    cls[: len(kind)] = kind
    cls = np.ascontiguousarray(cls.reshape(n, _CHUNK).T)
    maps = np.repeat(np.arange(13, dtype=np.int16)[:, None], n, axis=1)
    for c in cls:
        maps = step[maps * 12 + c].astype(np.int16)
    # Prefix scan: after round k, maps[:, i] is the composition of the 2**k chunks that end at i.
    reach = 1
    while reach < n:
        ahead = maps.copy()
        ahead[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps, reach = ahead, 2 * reach
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.int16)
    got = np.empty((_CHUNK, n), dtype=np.uint8)
    for i, c in enumerate(cls):
        at = state * 12 + c
        got[i] = out[at]
        state = step[at].astype(np.int16)
    return np.ascontiguousarray(got.T).ravel()[: len(kind)]


@dataclass(frozen=True)
class Merges:
    """rank: of the merge that makes a token (-1: a byte); left and right: its parts; size in bytes; pair: left << 32 | right of all merges, sorted, and pair_rank; edge: node << 8 | byte of the vocabulary's trie, sorted, and where it leads; token: of a node, or -1; special: strings that are one token each."""

    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    pair: np.ndarray
    pair_rank: np.ndarray
    edge: np.ndarray
    child: np.ndarray
    token: np.ndarray
    special: tuple[bytes, ...]

    def stand(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave tokens a and b side by side; before: a rank from which on merges don't count.

        From the two tokens back to their bytes: of the two at the border, the one that was made
        last is taken apart (of equal ranks the right one, as merges go from the left). A merge
        of the two at the border must not come before that which made either part of more.
        """
        out = np.zeros(len(a), dtype=bool)
        live, before = np.arange(len(a)), np.full(len(a), _NONE) if before is None else before
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            good = ~((self.pair[at] == key) & (self.pair_rank[at] < before))
            live, a, b = live[good], a[good], b[good]
            ra, rb = self.rank[a], self.rank[b]
            more = (ra >= 0) | (rb >= 0)
            out[live[~more]] = True
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            first = ra > rb
            a, b, before = np.where(first, self.right[a], a), np.where(first, b, self.left[b]), np.where(first, ra, rb + 1)
        return out

    def ends(self, buf: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens that begin at places of buf, up to a stop each: number of the place, bytes, token."""
        who, how, what = [], [], []
        live, node, n = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), 0
        while len(live):
            key = node << 8 | buf[at[live] + n]
            to = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[to] == key
            live, node, n = live[hit], self.child[to[hit]], n + 1
            t = self.token[node]
            who.append(live[t >= 0])
            how.append(np.full(len(who[-1]), n))
            what.append(t[t >= 0])
            go = at[live] + n < stop[live]
            live, node = live[go], node[go]
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, how, what))


def load(path: str) -> Merges:
    """The merges of a byte-level BPE file in the tokenizers library's format, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
    vocab = spec["model"]["vocab"]
    # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char, more = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in char:
            char[b] = chr(256 + more)
            more += 1
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return compiled([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], [vocab[char[b]] for b in range(256)], tuple(t["content"].encode() for t in spec["added_tokens"]))


def compiled(merges: list[tuple[int, int, int]], bytes_: list[int], special: tuple[bytes, ...] = ()) -> Merges:
    """From (left, right, made) in the order of ranks and the tokens of the 256 bytes."""
    n = max(max(bytes_), max((m for *_, m in merges), default=0)) + 1
    rank, left, right = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    text: dict[int, bytes] = {t: bytes([b]) for b, t in enumerate(bytes_)}
    for r, (a, b, made) in enumerate(merges):
        if made in text or a not in text or b not in text:
            raise ValueError("each token must have one merge, after those of its parts")
        rank[made], left[made], right[made], text[made] = r, a, b, text[a] + text[b]
    made = np.array([m for *_, m in merges], dtype=np.int64)
    key = left[made] << 32 | right[made]
    order = np.argsort(key)
    empty = np.empty(0, dtype=np.int64)
    m = Merges(rank, left, right, np.array([len(text.get(t, b"")) for t in range(n)]), key[order], rank[made][order], empty, empty, empty, special) if len(made) else Merges(rank, left, right, np.ones(n, np.int64), np.array([-1]), np.array([_NONE]), empty, empty, empty, special)
    # A token that the merges make of its own bytes; others (their parts merge otherwise) are in no result.
    own = dict.fromkeys(bytes_, True)
    for t, alone in zip(made.tolist(), m.stand(left[made], right[made], rank[made]).tolist() if len(made) else []):
        own[t] = alone and own[int(left[t])] and own[int(right[t])]
    edges: dict[int, int] = {}
    token = [-1]
    for t, ok in own.items():
        node = 0
        for b in text[t] if ok else b"":
            to = edges.get(node << 8 | b)
            if to is None:
                to = edges[node << 8 | b] = len(token)
                token.append(-1)
            node = to
        if ok:
            token[node] = t
    edge = np.array(sorted(edges), dtype=np.int64)
    return replace(m, edge=edge, child=np.array([edges[k] for k in edge.tolist()], dtype=np.int64), token=np.array(token, dtype=np.int64))


def last_tokens(m: Merges, buf: np.ndarray, start: np.ndarray, end: np.ndarray, told: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces buf[start:end], the last token of every prefix end to end (a piece has size + 1 places, the first -1), its count, and where pieces begin.

    told: for each piece the last tokens of its first prefixes, where the state is known; places that begin before the first of them have -2.
    """
    size = end - start
    base = np.concatenate([[0], np.cumsum(size + 1)])
    piece = np.repeat(np.arange(len(start)), size)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    who, n, t = m.ends(buf, start[piece] + off, end[piece])
    goal = off[who] + n
    at = base[piece[who]] + off[who]
    last, count = np.full(base[-1], -2, dtype=np.int64), np.zeros(base[-1], dtype=np.int64)
    last[base[:-1]] = -1
    for i, x in enumerate(told or []):
        last[base[i] : base[i] + len(x)] = x
        if len(x):
            late = (piece[who] != i) | (goal >= len(x))
            goal, at, n, t, who = goal[late], at[late], n[late], t[late], who[late]
    order = np.argsort(goal, kind="stable")
    at, n, t, goal = at[order], n[order], t[order], goal[order]
    cut = np.flatnonzero(np.diff(goal, prepend=-1, append=-1))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        a, b = last[at[lo:hi]], t[lo:hi]
        ok = a == -1
        ask = np.flatnonzero(a >= 0)
        ok[ask] = m.stand(a[ask], b[ask])
        to = at[lo:hi][ok] + n[lo:hi][ok]
        last[to], count[to] = b[ok], count[at[lo:hi][ok]] + 1
    return last, count, base


def piece_counts(m: Merges, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of each piece buf[start:end]."""
    total = np.zeros(len(start), dtype=np.int64)
    short = np.flatnonzero(end - start <= PART)
    if len(short):
        _, count, base = last_tokens(m, buf, start[short], end[short])
        total[short] = count[base[1:] - 1]
    for i in np.flatnonzero(end - start > PART).tolist():
        total[i] = _long_count(m, buf, int(start[i]), int(end[i]))
    return total


def _long_count(m: Merges, buf: np.ndarray, start: int, end: int) -> int:
    """Tokens of a long piece, by chunks run in step."""
    reach = int(m.size.max())
    first = np.arange(start, end, PART)
    ahead, stop = np.maximum(first - max(AHEAD, 2 * reach), start), np.minimum(first + PART, end)
    last, _, base = last_tokens(m, buf, ahead, stop)
    true = np.full(end - start + 1, -2, dtype=np.int64)
    for i, (f, a, s) in enumerate(zip(first.tolist(), ahead.tolist(), stop.tolist())):
        got = last[base[i] : base[i + 1]]
        known = slice(max(f - reach, start) - start, f - start + 1)
        if i and not np.array_equal(got[known.start + start - a : f - a + 1], true[known]):
            # The chunk began in another state: again, from the state that the one before ended in.
            a = known.start + start
            got, _, _ = last_tokens(m, buf, np.array([a]), np.array([s]), [true[known]])
        true[f - start + (i > 0) : s - start + 1] = got[f - a + (i > 0) :]
    n, at = 0, end - start
    while at:
        at -= int(m.size[true[at]])
        n += 1
    return n


class Counter:
    """Token counts of lists of texts."""

    def __init__(self, merges: Merges):
        self.m, self.kept = merges, {}

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        owner, parts, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            pieces = [t or b""]
            for s in self.m.special:
                if s in (t or b""):
                    pieces = [q for p in pieces for q in p.split(s)]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined = b"\n".join([*parts, b""])
        buf = np.frombuffer(joined, dtype=np.uint8)
        first = np.flatnonzero((buf & 0xC0) != 0x80)  # the first byte of each character
        code = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        kind = classes()[code]
        stop = np.cumsum([len(p) + 1 for p in parts]) - 1  # bytes where parts end
        stop_char = np.searchsorted(first, stop)
        kind[stop_char] = END
        got = outputs(kind)
        begins = (got & HERE) > 0
        begins[:-1] |= (got[1:] & BEFORE) > 0
        start = np.flatnonzero(begins)
        end = np.concatenate([start[1:], [len(kind)]])
        real = kind[start] != END
        start, end = start[real], end[real]
        where = np.array(owner, dtype=np.int64)[np.searchsorted(stop_char, start)]
        byte = np.concatenate([first, [len(buf)]])
        start, end = byte[start], byte[end]
        scan = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(TABLE[buf] * powers(_INV, len(buf)), out=scan[1:])
        h = mix((scan[end] - scan[start]) * powers(BASE, len(buf))[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        each, kinds = pd.factorize(h)
        example = np.empty(len(kinds), dtype=np.int64)
        example[each[::-1]] = np.arange(len(each))[::-1]
        # Pieces of equal hashes have equal bytes, or count for themselves.
        like = example[each]
        size = end - start
        alike = size == size[like]
        flat = np.repeat(np.flatnonzero(alike), size[alike])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size[alike]) - size[alike], size[alike])
        alike[flat[buf[start[flat] + step] != buf[start[like[flat]] + step]]] = False
        keys = [joined[a:b] for a, b in zip(start[example].tolist(), end[example].tolist())]
        known = np.fromiter((self.kept.get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = piece_counts(self.m, buf, start[example[new]], end[example[new]])
            if len(self.kept) + len(new) > KEPT:
                self.kept.clear()
            self.kept.update((keys[i], n) for i, n in zip(new.tolist(), known[new].tolist()) if len(keys[i]) <= 64)
        tokens = known[each]
        if not alike.all():
            tokens[~alike] = piece_counts(self.m, buf, start[~alike], end[~alike])
        return np.bincount(where, weights=tokens, minlength=len(texts)).astype(np.int64) + extra


def _count(merges: Merges, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in batches:
            for part, texts in slices(batch, most=1 << 20):
                n = counter.count(texts)
                size = [len(t or b"") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; one pass, no shuffle.

    A null or empty text has 0 bytes and tokens. Equal texts have equal counts. Texts are
    counted whole, however long; other columns are not read; an empty table gives none.
    Strings of special tokens in a text are one token each, as the library has it by default.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(load(path), limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
