import zlib

import numpy as np
from pyspark.sql import functions as F

from tillframe.llm import language_kernel as lk, quality_qda as qq, queries


def test_kernel_is_the_share_of_common_grams():
    bits, lettered = lk.presence(["abc", "ABC", "abd", "12", ""])
    assert lettered.tolist() == [True, True, True, False, False]
    assert (bits[0] == bits[1]).all()

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in lk.LENGTHS for i in range(len(t) - n + 1)} - {" "}

    assert (bits[0] & bits[2]).sum() == len(grams("abc") & grams("abd"))


def test_language_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.language_id(spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.withColumn("lang", F.when(lk.held_out(F.col("doc_id"), 4, 2), "xx").otherwise(F.col("lang")))
    assert lk.train_on_documents(wrong).langs == lk.train_on_documents(docs).langs


def test_language_of_odd_rows(odd_docs, no_docs):
    model = lk.train_on_documents(odd_docs)
    rows = lk.identify(odd_docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        assert lettered or r["score"] == 0
    assert lk.train_on_documents(no_docs) is None
    assert {r["lang_pred"] for r in lk.identify(odd_docs, None, ["doc_id"]).collect()} == {"und"}
    assert lk.identify(no_docs, model, ["doc_id"]).count() == 0


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    for label in (0, 1):
        assert np.mean([r["predicted"] == label for r in rows if r["quality"] == label]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_density_equals_the_formula():
    rng = np.random.default_rng(0)
    mean, spread = rng.normal(size=3), np.array([[2.0, 0.3, 0], [0.3, 1, 0.1], [0, 0.1, 0.5]])
    other = np.eye(3)
    factor = [np.linalg.inv(np.linalg.cholesky(s)) for s in (spread, other)]
    model = qq.QualityModel(0.5, (mean, np.zeros(3)), tuple(factor), (np.linalg.slogdet(spread)[1], 0.0), (np.log(0.5), np.log(0.5)))
    x = rng.normal(size=(5, 3))
    dense = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)) / np.sqrt(np.linalg.det(s)) for m, s in ((mean, spread), (np.zeros(3), other))]
    assert np.allclose(qq.score_vectors(x, model), dense[1] / (dense[0] + dense[1]))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 0, 0), (5, None, 0), (6, 1, 1), (None, 1, 0)], "doc_id long, quality int, x int")
    assert qq.score_documents(odd_docs, labels).count() == odd_docs.count()
    assert qq.score_documents(no_docs, labels).count() == 0
    none = qq.score_documents(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def naive_language(rows, texts, marks_each, ridge):
    """Scores of each language from the kernel itself: sets of grams, landmarks, whitening and ridge regression, one by one."""
    grams = lambda t: set(np.flatnonzero(lk.presence([t])[0][0]).tolist())
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    langs = sorted({lang for lang, _, _ in rows})
    marks = [grams(t) for lang in langs for _, t, u in sorted((r for r in rows if r[0] == lang), key=lambda r: r[2])[:marks_each]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    solid = values > 1e-6 * values.max()
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    point = lambda t: np.append(np.array([kernel(grams(t), m) for m in marks]) @ whiten, 1)
    x = np.array([point(t) for _, t, _ in rows])
    y = np.array([[1.0 if lang == other else -1.0 for other in langs] for lang, _, _ in rows])
    beta = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ y)
    return langs, np.array([point(t) @ beta for t in texts])


def test_language_scores_equal_the_kernel(spark):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r["lang"] and r["text"] and len(r["text"]) < 4000]
    rows = [(r["lang"], r["text"], (i * 0.618) % 1) for i, r in enumerate(docs[:60])]
    texts = [r["text"] for r in docs[60:90]]
    n_langs = len({lang for lang, _, _ in rows})
    frame = spark.createDataFrame(rows, "lang string, text string, u double")
    model = lk.fit(frame, sample_per_lang=10_000, landmarks=5 * n_langs, ridge=1e-2)
    langs, values = naive_language(rows, texts, 5, 1e-2)
    found, scores = lk.predict(texts, model)
    assert found == [langs[i] for i in values.argmax(axis=1)]
    assert np.allclose(scores, np.clip((1 + values.max(axis=1)) / 2, 0, 1), atol=1e-3)


def naive_statistics(text):
    def kind(c):
        return "letter" if c.isalpha() else "digit" if c.isdecimal() else "space" if c.isspace() else "symbol"

    def share(part, whole):
        return np.arcsin(np.sqrt(min(part / max(whole, 1), 1)))

    kinds = [kind(c) for c in text]
    words = "".join(" " if k == "space" else c for c, k in zip(text, kinds)).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x]
    sizes = [len(w) for w in words]
    runs, longest = 0, 0
    for i, w in enumerate(words):
        runs = runs + 1 if i and w == words[i - 1] else 1
        longest = max(longest, runs)
    again = sum(i > 0 and w == words[i - 1] for i, w in enumerate(words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(np.mean(sizes) if sizes else 0), np.log1p(np.std(sizes) if sizes else 0),
        share(sum(c.isalpha() and c.isupper() for c in text), kinds.count("letter")), share(kinds.count("digit"), len(text)),
        share(kinds.count("symbol"), len(text)), share(kinds.count("space"), len(text)),
        share(sum(not any(c.isalpha() for c in w) for w in words), len(words)),
        share(sum(kind(w[-1]) == "symbol" and w[-1] not in ".,;:?" for w in words), len(words)), share(len(set(words)), len(words)),
        share(again, len(words)), np.log1p(len(words) / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(w[0].isupper() for w in words), len(words)), np.log1p(longest),
    ]


def test_statistics_equal_a_walk_through_the_text(odd_docs):
    texts = [r["text"] or "" for r in odd_docs.collect()] + ["a a a b\nA!\nA!\n\n1 2 2 x? y%", "Zeile eins\nZeile eins\n", "one  two\tTHREE;", "½ ² \x1c x"]
    found = qq.statistics(texts)
    assert np.allclose(found, [naive_statistics(t) for t in texts])
    assert np.allclose(found[[0, 4]], qq.statistics([texts[0], texts[4]]))


def test_class_sums_do_not_depend_on_the_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3 == 0), (rng.normal(size=16) + (i % 3 == 0)).tolist()) for i in range(300)] + [(None, [0.0] * 16), (7, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "label int, x array<double>")
    one, many = (qq.fit(frame.repartition(n)) for n in (1, 40))
    assert one.prior == many.prior and np.allclose(one.means, many.means) and np.allclose(one.whiten, many.whiten)
    x = np.array([v for k, v in rows if k == 1])
    assert np.allclose(many.means[1], x.mean(axis=0))
