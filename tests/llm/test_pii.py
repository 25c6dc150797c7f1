"""Personal data: base spans against Python's re on long runs, added spans against what was planted, redaction against a plain fold."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
]


def base(text):
    return sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m.group()))


def check(spark, texts, known=None):
    """known: base spans of texts on which re would take time squared."""
    known = known or {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    for i, t in enumerate(texts):
        want = known.get(i) if i in known else base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in want).encode()).hexdigest(), i
        assert [got[i][f"n_{n}"] for n, *_ in RULES] == [sum(x[3] == n for x in want) for n, *_ in RULES]
    return got


def test_long_runs(spark):
    n = 100_000
    texts = ["1" * n, "a" * n + "@", "a-" * n + " at " + "b" * n + " dot com", "0" * n + "1.2.3.4", "1." * n, "4-" * n, "+1" + "-" * n, "a@b" + ".c" * n, "x@mail.example.com, " * n, "1 " * n, "+1 234 567 8901 " * 30_000, "call 212 555 1234 or x@y.zz " * 10_000]
    check(spark, texts, {0: [], 1: [], 2: [], 3: [(0, 1, n + 7, "ip")], 4: [(8 * k, 1, 8 * k + 7, "ip") for k in range(n // 4)], 5: [], 6: []})


def test_odd_rows(spark):
    texts = [None, "", " \n", "é" * 9 + " 4111 1111 1111 1111 ü a@b.co 10.0.0.1 +1 (222) 333-4444", "a@b.c.d@e.f", "0000000001.2.3.4", "256.1.1.1.1", "a@b.co", "a@b.co", "+1 23456789012345678 90", "4111111111111111-", "x" * 50 + "@y.z"]
    check(spark, texts)
    df = spark.createDataFrame([(None, None, 1), (3, "a@b.co", 2), (3, "a@b.co", 2), (3, "none", 2)], "doc_id long, text string, base int").withColumn("txt", F.lit("t")).withColumn("k", F.lit("t"))
    assert pii.find_pii(df).columns == ["doc_id", "text", "txt", "k", "base", "added"]
    got = sorted((str(r.doc_id), str(r.text), r.base, r.txt) for r in pii.redact(df).collect())
    assert got == [("3", "<EMAIL>", 2, "t"), ("3", "<EMAIL>", 2, "t"), ("3", "none", 2, "t"), ("None", "None", 1, "t")]
    assert pii.redact(df.where("false")).count() == pii.find_pii(df.where("false")).count() == 0


def planted(seed):
    """Texts with (kind, span) of what is personal, among things that look like it."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprstu", k=rnd.randint(2, 8)))
    num = lambda n: "".join(rnd.choices("0123456789", k=n))
    hexes = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    mixed = lambda n: "aB3" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    area = lambda: f"{rnd.choice('2345679')}{rnd.choice('12345678')}{num(1)}"
    while True:
        a = area()
        if a not in pii.SERVICES.split():
            phone = f"({a}) {rnd.choice('2345679')}{num(2)}-{num(4)}"
            break
    bad = next(x for x in iter(lambda: "4" + num(15), None) if not luhn(x))
    grouped = " ".join(bad[i : i + 4] for i in range(0, 16, 4))
    real = [
        ("email", "contact me: ", f"{word()}{num(2)} at {rnd.choice(['gmail', word()])} dot {rnd.choice(['com', 'org', 'de'])}"),
        ("email", "mail ", f"{word()} [at] {word()} [dot] {rnd.choice(['com', 'net', 'fr'])}"),
        ("phone", "phone ", phone),
        ("card", "my visa card ", grouped),
        ("secret", "token = ", hexes(40)),
        ("secret", "password: ", mixed(30)),
        ("secret", "api key ", "ghp_" + mixed(33)),
    ]
    fake = ["look at polka dot patterns", f"order {num(16)}", f"sha {hexes(40)}", f"commit {hexes(40)}", f"part no. 100-000-{num(4)}", "stare at the red dot there", f"{word()}/{word()}longword/{num(2)}/somethingelse/index", f"id {num(16)}", "0000000000000000 1111111111111111"]
    text, spans = "", []
    for _ in range(6):
        text += " ".join(word() for _ in range(rnd.randint(5, 20))) + ". "
        if rnd.random() < 0.5:
            kind, before, x = rnd.choice(real)
            text += before
            spans.append((kind, len(text), len(text) + len(x)))
            text += x + ", "
        else:
            text += rnd.choice(fake) + ". "
    return text, spans


def test_added_spans(spark):
    """Of spans that are planted among look-alikes nearly all are found, and nearly nothing else is."""
    texts, true = zip(*[planted(i) for i in range(400)])
    got = check(spark, texts)
    want = {(i, *s) for i, spans in enumerate(true) for s in spans}
    plain = {(i, n, a, b) for i, t in enumerate(texts) for a, _, b, n in base(t)}
    found = {(i, k, int(a), int(b)) for i in range(400) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)} - plain
    assert len(want & found) >= 0.95 * len(want), [sum(x[1] == k for x in want - found) for k in pii.KINDS]
    assert len(want & found) >= 0.95 * len(found), [sum(x[1] == k for x in found - want) for k in pii.KINDS]


@pytest.mark.parametrize("values", [[], [3], [1, 2], [5, -1, 4, 4, 0, 9, 2]])
def test_running(spark, values):
    list_ = f"cast(array({', '.join(map(str, values))}) as array<int>)"
    got = spark.range(1).selectExpr(pii.running(list_, lambda a, b: f"{a} + {b}", 0) + " as x").first().x
    assert got == [sum(values[:i]) for i in range(len(values))]


def test_redaction(spark):
    texts = [planted(i)[0] + " x@y.zz +1 (222) 333-4444 " * (i % 7) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: sorted([*r.base, *r.added]) for r in pii.find_pii(df).collect()}
    for r in pii.redact(df).collect():
        out, last = "", 0
        for x in spans[r.doc_id]:
            if x.s >= last:
                out += texts[r.doc_id][last : x.s] + f"<{x.k.upper()}>"
            last = max(last, x.e)
        assert r.text == out + texts[r.doc_id][last:]
