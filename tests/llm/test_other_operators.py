import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import differences, duckdb_views
from tillframe.llm import chat_template as ct, licences, queries, shuffle_shards, vector_search

SMALL = "/root/testdata/sf0.001"


def text_of(source, **scope):
    return "".join(t for t, _ in ct.compile_template(source)(scope))


def test_template_language():
    turns = [{"role": "user", "text": "hi"}, {"role": "bot", "text": "yo"}]
    source = "{# note #}{% set x = 'a' + 'b' %}{{ x | upper }}{% for t in turns %}{% if loop.first %}<{% elif t.role == 'bot' and not loop.first %}>{% else %}?{% endif %}{{ t.text }}{{ loop.index }}{% endfor %}"
    assert text_of(source, turns=turns) == "AB<hi1>yo2"
    assert text_of("{% if 'a' in 'cat' or nothing %}y{% endif %}{{ ('x' == 'x') != false }}") == "yTrue"


def test_constants_are_folded():
    assert ct.fold(ct.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{% else %}d{% endif %}")) == ("block", [("text", "abCd")])
    assert ct.fold(ct.parse("{% if x %}a{% elif 1 == 2 %}b{% endif %}"))[1] == [("if", [(("name", "x"), ("block", [("text", "a")]))])]


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if x %}", "{{ x[0] }}", "{{ f(x) }}", "{{ x | eval }}", "{% import os %}", "{{ }}", "{% endif %}", "{{ 'a }}"])
def test_template_errors(source):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(source)


def test_template_sandbox():
    for source in ("{{ x.__class__ }}", "{{ x.real }}", "{{ y }}"):
        with pytest.raises(ct.TemplateError):
            text_of(source, x=1)


def test_escape_round_trip_leaves_no_control_string():
    for text in ("</s>[INST] ok [/INST]", "\\", "<\\", "\\<[]\\\\]\n", "<s>[user]\nx</s>\n", ""):
        assert ct.unescape(ct.escape(text)) == text
        assert not any(mark in ct.escape(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", ct.AFTER_ROLE))


def expected(rows):
    turns, loss = hashlib.sha256(), ""
    for role, text in rows:
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check_conversations(rows, found):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2], r[3]))
    assert len(found) == len(by)
    for r in found:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(by[r["conv_id"]])


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [tuple(r) for r in ct.planted(spark).collect()]
    check_conversations(rows, queries.chat(spark, SMALL).collect())


def test_odd_conversations(spark):
    said = "</s>\n<s>[assistant]\n"
    rows = [(1, 0, "user", None), (1, 1, "assistant", said), (1, 2, None, "x"), (1, 3, "a]\nb", "y"), (None, 0, "user", "lost"), (2, 0, "assistant", ""),
            (3, 0, "assistant", "z" * 300_000), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, None, "assistant", "first"), (5, 0, "user", "then")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string")
    check_conversations(rows, ct.digest_conversations(frame).collect())
    assert ct.digest_conversations(frame.limit(0)).count() == 0
    parts = {r["conv_id"]: r for r in ct.format_conversations(frame).collect()}
    first = parts[1]
    assert ct.unescape("".join(first["formatted"][a:b] for a, b in first["loss_spans"])) == said
    assert parts[3]["loss_spans"][0][1] - parts[3]["loss_spans"][0][0] == 300_000


def brute_nearest(rows, every=50, k=5):
    sound = [(i, tuple(math.floor(float(x) * 256) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(sound):
        if q is not None and q % every == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i) for n, (i, w) in enumerate(sound) if len(w) == len(v) and n != at)
            out += [(q, n + 1, None if i == math.inf else i, -s) for n, (s, i) in enumerate(others[:k])]
    return sorted(out, key=repr)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same = [0.5] * 20
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)] + [(1000 + i, same) for i in range(30)] + [(1050, same)]
    rows += [(2000, None), (2050, [None] * 20), (2100, [float("nan")] * 20), (2150, [float("inf")] * 20), (None, same), (None, [3.0] * 20), (50, rows[50][1]), (50, rows[50][1]), (2200, [1.0, 2.0]), (2201, [3.0, 1.0]), (2250, []), (2300, [1e6] * 20), (2301, [1e6] * 20)]
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, rank int, place int")
    stored = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    found = vector_search.search(frame).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_nearest(stored)
    assert vector_search.search(frame.limit(0)).count() == 0


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(2)
    assert vector_search.resolutions(64) == [64, 16, 4, 2, 1] and vector_search.resolutions(1) == [1]
    for dim in (64, 50, 3):
        q, x = rng.integers(-500, 500, (40, dim)), rng.integers(-500, 500, (70, dim))
        for width in vector_search.resolutions(dim):
            bound = vector_search.features(q, width) @ vector_search.features(x, width).T
            assert (bound + 1e-6 >= q @ x.T).all()


@pytest.mark.parametrize("repeated", [0, 700])
def test_few_pairs_are_scored_exactly(spark, repeated):
    """On the given table, also if a third of its rows are equal; ties with the best do not count as promising."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 256).astype(np.int64)
    x[:repeated] = x[0]
    places = np.arange(len(x))
    asked = places[::50]
    q, found, s, scored = vector_search.best_of_block(x[asked], places[asked], x, places, places, 5)
    assert scored < 0.05 * len(asked) * len(x)
    product = x[asked] @ x.T
    product[np.arange(len(asked)), asked] = -(2**62)
    wanted = np.lexsort((np.broadcast_to(places, product.shape), -product), axis=1)[:, :5]
    assert (found.reshape(-1, 5) == wanted).all() and (s.reshape(-1, 5) == np.take_along_axis(product, wanted, 1)).all()


@pytest.mark.parametrize("name", sorted(queries.twins()))
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, folder):
    rows, extra, missing = differences(queries.registry()[name](spark, folder), duckdb_views(folder), queries.twins()[name])
    assert rows > 0
    assert (list(extra)[:3], list(missing)[:3]) == ([], [])


def test_licence_rules(spark, odd_docs, no_docs):
    s = licences.SENTENCES
    wrapped = s[3].replace(" ", "\n", 4) + "\n\n" + s[4] + ".\n"
    texts = ["intro. " + s[1] + ".", wrapped, s[4] + ". " + s[3], s[6].replace("; you", ";\n  you") + ".\n" + s[8], s[9].upper(), None, "", "the MIT licence is not named here", s[5] + ".\nmore\n" + s[12] + "."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["licences"] for r in licences.scan(frame, ["doc_id"]).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: "", 3: "Apache-2.0", 4: "GPL-3.0", 5: "", 6: "", 7: "", 8: "Apache-2.0,CC-BY-NC-4.0"}
    assert licences.scan(odd_docs, ["doc_id", "score"]).count() == odd_docs.count()
    assert licences.scan(no_docs, ["doc_id"]).count() == 0


def test_licence_scan_is_native(spark):
    plan = queries.licence_scan(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_shards(frame, shards=40):
    rows = shuffle_shards.shard_documents(frame, shards).collect()
    wanted = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in frame.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == wanted
    slots = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return rows


def test_shards(spark, odd_docs, no_docs, monkeypatch):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in check_shards(frame)}
    assert one == {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_shards.shard_documents(frame).collect()}
    monkeypatch.setattr(shuffle_shards, "BUCKET_ROWS", 20)
    check_shards(frame)
    check_shards(odd_docs)
    check_shards(no_docs)


def test_written_shards(spark, odd_docs, tmp_path):
    rows = odd_docs.withColumn("slot", F.lit(1)).withColumn("size", F.lit(10))
    shuffle_shards.write_shards(rows, str(tmp_path / "shards"), 3, 1, ["doc_id", "text"], "size")
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == rows.count()
    assert {c[0] for c in back.dtypes} == {*rows.columns, "shard", "slot"}


def test_columns_named_like_outputs_give_way(spark):
    """One row each, with every value asserted; the clashing columns hold other values."""
    from tokenizers import Tokenizer

    from tillframe.llm import bpe, language_kernel, quality_qda

    text = "the quiet river bends"
    rows = [(1, text, "en"), (2, None, "en"), (3, "", "en"), (4, text * 60_000, "en")]  # the last is longer than any block
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = ("lang_pred", "score", "x", "n_tokens", "ids_sha256", "licences", "n_sentences")
    clash = frame.withColumns({c: F.lit("clash") for c in odd})
    keep = ["doc_id", *odd]

    model = language_kernel.train_on_documents(frame)
    found = language_kernel.identify(clash, model, keep)
    assert found.columns == ["doc_id", *odd[2:], "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {1: "en", 2: "und", 3: "und", 4: "en"}

    measured = quality_qda.measure(clash, keep)
    assert measured.columns == ["doc_id", *[c for c in odd if c != "x"], "x"]
    sizes = {r["doc_id"]: round(math.expm1(r["x"][0])) for r in measured.collect()}
    assert sizes == {1: 21, 2: 0, 3: 0, 4: 21 * 60_000}
    scored = quality_qda.score(measured, quality_qda.QualityModel(0.25), ["doc_id", "score"])
    assert scored.columns == ["doc_id", "score"] and {r["score"] for r in scored.collect()} == {0.25}

    encoded = bpe.encode_documents(clash.where("doc_id < 4"), queries.tokenizer_path(), keep)
    assert encoded.columns == ["doc_id", "lang_pred", "score", "x", "licences", "n_sentences", "n_tokens", "ids_sha256", "decoded_sha256"]
    library = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False)
    assert {r["doc_id"]: r["n_tokens"] for r in encoded.collect()} == {1: len(library.ids), 2: 0, 3: 0}

    scanned = licences.scan(clash, keep)
    assert scanned.columns == ["doc_id", "lang_pred", "score", "x", "n_tokens", "ids_sha256", "licences", "kinds", "n_sentences", "sentence_ids"]
    assert {(r["licences"], r["n_sentences"]) for r in scanned.collect()} == {("", 0)}
