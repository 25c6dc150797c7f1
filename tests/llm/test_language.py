"""Languages learned and told apart, beyond a thousand of them, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import language


def test_held_out_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99
    far = spark.createDataFrame([(1, "Это русский текст о погоде и природе, в нём нет ничего общего с другими"), (2, "これは日本語の文章です。天気がいいですね。")], "doc_id long, text string")
    assert all(r.margin < -0.2 for r in language.identify(far, model).collect())
    near = language.identify(docs.where("lang is not null"), model).toPandas()
    assert (near.margin >= -0.3).mean() > 0.995 and near.margin.between(-2, 2).all()


def test_more_than_a_thousand_languages(spark):
    """Each of 1,010 languages has two texts of its own words; all are learned, and a new text is told."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    own = {f"l{i:04d}": [word() for _ in range(8)] for i in range(1_010)}
    rows, k = [], 0
    for name, vocabulary in own.items():
        for _ in range(2):
            while zlib.crc32(str(k).encode()) % 5 == 0:
                k += 1
            rows.append((k, " ".join(rnd.choices(vocabulary, k=20)), name))
            k += 1
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 1_010
    asked = rnd.sample(sorted(own), 40)
    best = model.scores(language._presence([" ".join(rnd.choices(own[n], k=20)) for n in asked])).argmax(axis=1)
    assert np.mean([model.labels[b] == n for b, n in zip(best, asked)]) > 0.9


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word some text "), F.col("id")).alias("text"), F.concat(F.lit("x"), F.col("id") % 300).alias("lang"))
    model = language.fit(docs, language.LanguageParams(sample=100, most_landmarks=30))
    assert 40 <= len(model.labels) <= 200


def test_odd_rows(spark):
    rows = [(i, "the and of to that is" if i % 2 else "der die und das ist ein", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", None), (103, "und das ist " * 60_000, None), (None, "der die das", "de"), (5, "the and of to that is", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as margin", "2 as kept")
    model = language.fit(df)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None, 1, 2)] == ["und", "und", "und", "de", "de", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0 and got[None].held_out is False
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "kept", "lang_pred", "score", "margin"] and out.count() == len(rows)
    assert language.fit(df.where("false")) is None and language.fit(df.where("text is null")) is None
    assert language.predict(df, None).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.predict(df.where("false"), model).count() == 0


def test_sample_is_bounded_when_rows_repeat(spark, monkeypatch):
    """An id under which a third of all rows stand, equal or not, fills no more of the sample than its language's quota; equal rows count once."""
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    same = spark.range(3000).selectExpr(f"{free[0]}L as doc_id", "'the cat sat on the mat' as text", "'en' as lang")
    other = spark.range(3000).selectExpr(f"{free[1]}L as doc_id", "concat('der hund lief ', id, ' mal durch den wald') as text", "'de' as lang")
    few = spark.createDataFrame([(i, f"le chat numero {i} dort sur la table", "fr") for i in free[2:30]], "doc_id long, text string, lang string")
    taken = []
    real = language._unpacked
    monkeypatch.setattr(language, "_unpacked", lambda rows: taken.append(len(rows)) or real(rows))
    model = language.fit(same.union(other).union(few), language.LanguageParams(per_language=50))
    assert model.labels == ("de", "en", "fr")
    assert sum(taken[1:]) < 1 + 28 + 100  # the first are the landmarks
    asked = few.union(same.limit(1))
    assert [r.lang_pred for r in language.predict(asked, model).collect()] == ["fr"] * 28 + ["en"]


def test_equals_a_plain_kernel_ridge(spark):
    """With all texts as landmarks: kernels from sets of n-grams, and one dense solve a language in the dual."""
    rnd = random.Random(8)
    word = {n: ["".join(rnd.choices(letters, k=rnd.randrange(2, 8))) for _ in range(6)] for n, letters in (("aa", "abcdefg"), ("bb", "fghijkl"), ("cc", "klmnopqé"))}
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, " ".join(rnd.choices(word[n], k=rnd.randrange(2, 7))), n) for i, n in zip(free, ["aa"] * 12 + ["bb"] * 9 + ["cc"] * 5)]
    p = language.LanguageParams()
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), p)

    def sets(text):
        b = (" " + text + " ").encode()
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    kernel = lambda xs, ys: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])
    own = [sets(t) for _, t, _ in rows]
    asked = [" ".join(rnd.choices(word["aa"] + word["bb"] + word["cc"], k=5)) for _ in range(20)] + [t for _, t, _ in rows]
    w = np.array([len(rows) / 3 / sum(n == m for *_, m in rows) for *_, n in rows])
    w_mean, root = w / w.sum(), np.sqrt(w)
    k, kx = kernel(own, own), kernel([sets(t) for t in asked], own)
    centred = k - (w_mean @ k)[None] - (k @ w_mean)[:, None] + w_mean @ k @ w_mean
    centred_x = kx - (w_mean @ k)[None] - (kx @ w_mean)[:, None] + w_mean @ k @ w_mean
    want = []
    for name in model.labels:
        y = np.array([1.0 if n == name else -1.0 for *_, n in rows])
        dual = root * np.linalg.solve(root[:, None] * centred * root[None] + p.ridge * np.eye(len(rows)), root * (y - w_mean @ y))
        want.append(w_mean @ y + centred_x @ dual)
    assert np.abs(model.scores(language._presence(asked)) - np.array(want).T).max() < 0.02
