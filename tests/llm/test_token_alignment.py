import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tillframe.llm import queries, token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return ta.Pair(A, B)


def byte_tokens(both, text):
    """Ids and bytes of the tokens straight from the two libraries, without spans."""
    letters = ta.byte_letters()
    a = both.a.encode(" " + text, add_special_tokens=False)
    a_raw = [bytes(letters[c] for c in t) for t in a.tokens]
    b = both.b.encode(text, return_type=str)
    b_raw = [bytes([int(p[3:5], 16)]) if both.b.is_byte(both.b.piece_to_id(p)) else p.replace("▁", " ").encode() for p in b]
    return a.ids, a_raw, [both.b.piece_to_id(p) for p in b], b_raw


def brute(both, text):
    """Token counts, groups and linked pairs by walking through the bytes of both sides."""
    if not text:
        return None
    a, a_raw, b, b_raw = byte_tokens(both, text)
    raw = (" " + text).encode()
    if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return None
    ends = [{end: i + 1 for i, end in enumerate(accumulate(map(len, side)))} for side in (a_raw, b_raw)]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        m, n = ends[0][end], ends[1][end]
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        links.append((a[m - 1], b[n - 1]))
        i, j = m, n
    return len(a), len(b), groups, links


ODD = ["a", " ", "  x", "café", "中文\U0001d6fc\U0001f600!", "<|endoftext|>", "<s></s>", "<0x41>", "a▁b", "ﬁn", "\x00\x01", "é", "x\n\n\ty", " z", "\U0001f468‍\U0001f469"]


@pytest.mark.parametrize("text", ODD)
def test_groups_of_odd_texts(both, text):
    check(both, text)


@given(st.text(st.sampled_from("abe  theINé中\U0001d6fc\U0001f600<|>s/ \n▁ﬁ.'\t\x1c\x85\xa0\u2003"), min_size=1, max_size=40))
@settings(max_examples=400, deadline=None)
def test_groups_equal_brute_force(both, text):
    check(both, text)


def check(both, text):
    wanted, got = brute(both, text), both.align(text)
    assert (wanted is None) == (got is None)
    if got:
        a, b, a_at, b_at = got
        assert (len(a), len(b), list(zip(a[a_at], b[b_at]))) == (wanted[0], wanted[1], wanted[3])
        assert ta.groups(both, *got) == ";".join(wanted[2])
    whole = ta.Texts(both).align([None, text, "", text])[1]
    assert (wanted is None) == (whole is None)
    if whole:
        links = Counter(a * ta.SHIFT + b for a, b in wanted[3])
        assert (whole.n_a, whole.n_b, whole.n_groups, whole.groups) == (wanted[0], wanted[1], len(wanted[2]), ";".join(wanted[2]))
        assert dict(zip(whole.pairs.tolist(), whole.times.tolist())) == links


def test_parts_are_remembered_and_forgotten(both, monkeypatch):
    texts = ["a b c d e f a b c d", "the end of a   long " + "x" * 100 + " text", "a b c", "a▁b c", "a c", None]
    assert both.parted
    fresh = [ta.Texts(both).align([t])[0] for t in texts]
    kept = ta.Texts(both)
    for limit in (100, 3, 0):
        monkeypatch.setattr(ta, "KEPT_PARTS", limit)
        for got, wanted in zip(kept.align(texts), fresh):
            assert (got is None) == (wanted is None)
            if got:
                assert got.groups == wanted.groups and got.pairs.tolist() == wanted.pairs.tolist() and got.times.tolist() == wanted.times.tolist()
    assert fresh[3] is None and kept.align(["a"])[0].n_a == 1 and len(kept.number) < 5


def test_ends_come_from_the_spans(both):
    """The spans decide; decoded bytes only place what lies between two cuts."""
    ids, ends = both.tokens_a(" \U0001f600 ok")
    assert ends.tolist()[-1] == len(" \U0001f600 ok".encode()) and (ends[1:] > ends[:-1]).all()
    moved = ta.refined(ends + 5, [True] * len(ends), both.a_widths[ids])
    assert (moved == ends + 5).all()


def brute_rows(both, texts):
    found = [brute(both, t) for t in texts]
    counts = Counter(link for f in found if f for link in f[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    empty = (0, 0, 0, 0, 0, 0, "")
    return [
        empty if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]


@pytest.mark.parametrize("hot_part", [1 << 17, 20, 1])
def test_counts_equal_brute_force(spark, both, odd_docs, hot_part):
    """Whether pairs are looked up in the tasks (all, the frequent ones, none) makes no difference."""
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, row int, pairs string, n_a int")
    found = ta.align(frame, A, B, ["doc_id", "n_a", "row"], hot_part)
    assert found.columns == ["doc_id", "row", *ta.OUTPUT]
    wanted = sorted(((i, *w) for (i, _), w in zip(rows, brute_rows(both, [t for _, t in rows]))), key=repr)
    assert sorted(((r["doc_id"], *(r[c] for c in ta.OUTPUT)) for r in found.collect()), key=repr) == wanted


def test_query_equals_brute_force(spark, both):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {r["doc_id"]: w for r, w in zip(rows, brute_rows(both, [r["text"] for r in rows]))}
    found = queries.aligned_tokens(spark, folder).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ta.OUTPUT) for r in found} == wanted


def test_nothing(no_docs):
    assert ta.align(no_docs, A, B, ["doc_id"]).count() == 0
