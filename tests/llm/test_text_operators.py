import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillframe.llm import bpe, components, interval_expansion, queries, simhash_index, string_tiling, substring_dedup

SMALL = "/root/testdata/sf0.001"


def naive_tiles(text, item, least):
    """Greedy string tiling by comparing every place with every place."""
    free_t, free_i, total = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and free_t[i + n] and free_i[j + n] and text[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        free_t[i : i + n] = free_i[j : j + n] = [False] * n
        total += n


@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_tiles_do_not_overlap_and_start_with_the_longest(text, item):
    found = string_tiling.tiles(np.array(text, np.uint64), np.array(item, np.uint64), 3)
    seen_t, seen_i = Counter(), Counter()
    for k, j, n in found:
        assert n >= 3 and text[k : k + n] == item[j : j + n]
        seen_t.update(range(k, k + n))
        seen_i.update(range(j, j + n))
    assert max([0, *seen_t.values(), *seen_i.values()]) <= 1
    longest = max((n for n in range(len(item) + 1) if any(item[j : j + n] == text[k : k + n] for j in range(len(item) - n + 1) for k in range(len(text) - n + 1))), default=0)
    assert max([n for _, _, n in found], default=0) == (longest if longest >= 3 else 0)
    if len(set(item)) == len(item):
        assert sum(n for _, _, n in found) == naive_tiles(text, item, 3)


def test_decontamination_finds_whole_edited_and_reordered_items(spark):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    turned = " ".join(words[20:] + ["middle"] + words[:20])
    texts = [f"before {item.upper()}, after", turned, " ".join(words[:20]), "nothing of it at all here", None, "", f"x {item} y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 2), (9, "too short", 3), (None, item, 4), (10, None, 5), (11, "other words than these in this item", 6)], "item_id long, text string, n_words int")
    rows = string_tiling.decontaminate(docs, bench).collect()
    assert sorted((r["doc_id"], r["contaminated"], r["item_id"], round(r["coverage"], 3)) for r in rows) == sorted(
        [(0, True, 7, 1.0), (0, True, 7, 1.0), (1, True, 7, 1.0), (2, False, 7, 0.5), (6, True, 7, 1.0)] + [(i, False, None, 0.0) for i in (3, 4, 5)],
        key=lambda r: (r[0], r[1]),
    )


def test_decontamination_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    split = {i: string_tiling.word_rows([t])[0] for i, t in items.items()}
    for r in queries.decontamination(spark, SMALL).collect():
        words = string_tiling.word_rows([docs[r["doc_id"]]])[0]
        assert r["n_words"] == len(words)
        best = max(string_tiling.coverage(words, w) for w in split.values())
        assert r["coverage"] == pytest.approx(best)


def test_decontamination_of_nothing(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert string_tiling.decontaminate(no_docs, bench).count() == 0
    assert string_tiling.decontaminate(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = sorted({fingerprint(t) for _, t in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, t in rows:
        least[find(fingerprint(t))] += [i] if i is not None else []
    return sorted(((i, fingerprint(t), min(least[find(fingerprint(t))], default=None)) for i, t in rows), key=repr)


def test_simhash_equals_brute_force(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for frame in (docs, odd_docs.select("doc_id", "text"), docs.limit(0)):
        rows = [tuple(r) for r in frame.collect()]
        found = simhash_index.near_duplicates(frame).collect()
        assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found), key=repr) == brute_groups(rows)


@pytest.mark.parametrize("bits,segments", [(2, 2), (2, 1), (3, 2), (2, 3), (4, 3)])
def test_index_finds_every_near_pair(spark, bits, segments):
    rng = np.random.default_rng(bits)
    base = rng.integers(-(2**63), 2**63, 40)
    prints = {int(b) for b in base} | {0, -1}
    for b in base:
        for k in range(1, bits + 2):
            flipped = int(b) % 2**64
            for bit in rng.choice(64, k, replace=False):
                flipped ^= 1 << int(bit)
            prints.add(flipped - 2**64 if flipped >> 63 else flipped)
    if segments == 1:
        prints = set(list(prints)[:60])
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    plan = simhash_index.segment_plan(bits, segments)
    assert sum(r + 1 for _, _, r in plan) == bits + 1
    if any(width == 64 for _, width, _ in plan):
        return  # one segment is the whole ball; covered by the sum above
    found = {(r["a"], r["b"]) for r in simhash_index.near_pairs(frame, bits, segments).collect()}
    wanted = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= bits}
    assert found == wanted


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}


@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_interval_expansion_equals_counting(parts, depth):
    symbols = np.array([x for p in parts for x in [*p, 0]])
    runs = [tuple(symbols[i : i + depth]) for i in range(len(symbols) - depth + 1)]
    count = Counter(r for r in runs if 0 not in r)
    found = interval_expansion.repeated_starts(symbols, depth)
    assert all(found[i] == (count[r] > 1) for i, r in enumerate(runs) if 0 not in r)


def brute_kept(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(t))] -= 1
        cut = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out.append((len(t), int(cut.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~cut])))
    return out


@pytest.mark.parametrize("length,largest_group,salt_rows", [(400, 4096, 1 << 15), (400, 1, 1), (400, 4096, 2), (200, 4096, 2), (64, 4096, 1 << 15), (8, 4096, 1 << 15)])
def test_removal_equals_brute_force(spark, monkeypatch, length, largest_group, salt_rows):
    """With groups of one edge, all edges are settled by their single windows; with few rows a salt, copies are dealt out."""
    monkeypatch.setattr(substring_dedup, "GROUP_EDGES", largest_group)
    monkeypatch.setattr(substring_dedup, "SALT_ROWS", salt_rows)
    rng = np.random.default_rng(3)
    random = lambda n: bytes(rng.choice(list(b"abcdefgh "), n).astype(np.uint8))
    passage, core, edge = random(900), random(350), random(400)
    texts = [random(200) + passage + random(300), passage[:450], random(100) + passage[200:700] + random(80), b"", random(399), edge, edge, b"ab" * 700]
    texts += [random(100) + core + random(100) for _ in range(5)]
    near = bytearray(passage)
    for k in (100, 520, 880):
        near[k] = ord("Z")
    texts += [bytes(near), passage + passage, "é".encode() * 300 + random(50), "é".encode() * 300]
    rows = [(i, t.decode(), i, "x") for i, t in enumerate(texts)] + [(3, None, 0, ""), (None, passage.decode()[:500], 1, ""), (5, edge.decode(), 5, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, spans string")
    found = substring_dedup.remove_repeats(frame, ["doc_id"], length=length).collect()
    wanted = brute_kept([(r[1] or "").encode() for r in rows], length)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found), key=key) == sorted(((r[0], *w) for r, w in zip(rows, wanted)), key=key)


def test_windows_follow_from_their_length():
    shape = substring_dedup.Windows()
    assert (shape.length, shape.anchor, shape.coarse, shape.fine) == (400, 32, 185, 93)
    for length in (8, 64, 200, 400, 1000):
        shape = substring_dedup.Windows(length)
        for parts in (shape.coarse, shape.fine):
            for part in range(-(-shape.reach // parts)):
                left, right = shape.core(1000, part, parts)
                assert 0 < right - left <= length
    with pytest.raises(ValueError):
        substring_dedup.Windows(7)


def test_removal_of_odd_rows(odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"score": "kept", "bucket": "n_spans"})
    found = substring_dedup.remove_repeats(named, ["doc_id", "source", "kept", "n_spans"], as_text=True)
    assert found.columns == ["doc_id", "source", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = odd_docs.collect()
    wanted = brute_kept([(r["text"] or "").encode() for r in rows])
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept"].encode()) for r in found.collect()) == sorted((repr(r["doc_id"]), w[0], w[1], w[3]) for r, w in zip(rows, wanted))
    assert substring_dedup.remove_repeats(no_docs, ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def own():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        return bpe.load(file.read())


@given(text=st.text(st.sampled_from("aethinrgso'sdtlv <|>\n\tÉéßİΣσ1²中文😀́!?-_#\x1c\x85\xa0"), max_size=60) | st.text(st.characters(max_codepoint=0x52F), max_size=20))
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words(library, own):
    for text in ("a<|endoftext|><|startoftext|> b<|STARTOFTEXT|>", "ab" * 5000, "!" * 300, "", " \n", "don't we'll <|endoftext|>"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pairs_are_compatible_just_where_merging_keeps_them(own):
    rng = np.random.default_rng(0)
    sound = np.flatnonzero(np.frombuffer(bytes(own.sound), np.uint8))
    inner = np.array([i for i in sound if not own.tokens[i].endswith("</w>")])
    a, b = rng.choice(inner, 3000), rng.choice(sound, 3000)
    parts = lambda t: list(t[:-4])[:-1] + [t[:-4][-1] + "</w>"] if t.endswith("</w>") and len(t) > 4 else list(t)
    for x, y, good in zip(a.tolist(), b.tolist(), own.compatible(a, b).tolist()):
        chars = [own.ids[c] for c in parts(own.tokens[x]) + parts(own.tokens[y])]
        assert good == (own.merge(chars) == [x, y])


def test_bpe_query_equals_the_library(spark, library, odd_docs, no_docs):
    for frame in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs):
        rows = bpe.encode_documents(frame, queries.tokenizer_path(), ["doc_id", "text"], with_ids=True).collect()
        assert len(rows) == frame.count()
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["token_ids"]) == (len(ids), ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(no_docs, queries.tokenizer_path(), ["doc_id"]).count() == 0
