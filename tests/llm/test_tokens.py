import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idledger.llm import token_files as tf
from idledger.llm.packing import first_fit_decreasing, pack
from idledger.llm.tokens import default_vocabulary, encoder


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_word_cache_equals_the_library(texts):
    e = encoder()
    assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_memory_starts_afresh(rows):
    small = encoder(None, 5)
    assert [x.tolist() for x in small.encode([r[1] for r in rows[:20]])] == [x.tolist() for x in encoder().encode([r[1] for r in rows[:20]])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_first_fit_decreasing(sizes):
    bins, offsets = first_fit_decreasing(np.array(sizes, np.int64), 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= sizes[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


@pytest.mark.parametrize("group_tokens", [3000, 1 << 21])
def test_packing_is_whole(docs, rows, plain, group_tokens):
    got = pack(docs, length=256, group_tokens=group_tokens).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    want = defaultdict(list)
    for doc, text, *_ in rows:
        ids = [*plain(text), 2]
        for a in range(0, len(ids), 256):
            piece = ids[a : a + 256]
            want[doc].append((a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    assert {k: Counter(v) for k, v in by_doc.items()} == {k: Counter(v) for k, v in want.items()}
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and sum(n for _, n in s) <= 256


def test_packing_nothing(no_docs):
    assert pack(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=300), st.integers(1, 64))
def test_bits_round_trip(bits, ids, block):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    assert tf.unpack_bits(tf.pack_bits(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    starts = np.array([0, len(ids) // 2])
    file = tf.TokenFile(tf.encode_file(np.array([4, 9]), starts, ids, bits, block))
    assert file.document(0).tolist() == ids[: len(ids) // 2].tolist() and file.document(1).tolist() == ids[len(ids) // 2 :].tolist()
    for a in range(0, len(ids), 7):
        assert file.ids(a, min(len(ids), a + 10)).tolist() == ids[a : a + 10].tolist()


def test_a_damaged_file_is_refused():
    data = tf.encode_file(np.array([1]), np.array([0]), np.arange(9, dtype=np.uint32), 17)
    for bad in (b"X" + data[1:], data[:-1]):
        with pytest.raises(ValueError):
            tf.TokenFile(bad)
    assert tf.width(49408) == 16 and tf.width(1) == 1 and tf.width(65537) == 17


def test_token_digest(docs, rows, plain):
    got = tf.token_digest(docs, file_bytes=40_000).collect()
    want = []
    for doc, text, *_ in rows:
        ids = [*plain(text), 1]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)


def test_no_token_files(no_docs):
    assert tf.token_digest(no_docs).count() == 0


def test_worker_keeps_one_operators_memory(tmp_path):
    """Encoders and models of operators that are done give way: the executor's limit holds for all its workers."""
    from idledger.llm import cluster, tokens

    at = f"file://{tmp_path}/model"
    cluster.share(at, [1, 2])
    coder = tokens.encoder()
    assert tokens.encoder() is coder and cluster.fetch(at) == [1, 2] and not tokens._ENCODERS
    assert cluster.fetch(at) is cluster.fetch(at)
    assert tokens.encoder() is not coder and not cluster._FETCHED and tokens.encoder().encode(["one two"])
    cluster.make_room()
    assert not tokens._ENCODERS


def test_memory_does_not_follow_the_number_of_texts():
    """What encoding takes beside its results is bounded by bytes of text, however many texts come at once."""
    coder, texts = encoder(), ["one two three four five " * 150] * 4000
    one = coder.encode(texts[:1])[0].tolist()
    tracemalloc.start()
    try:
        got = coder.encode(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 4000 and got[0].tolist() == got[-1].tolist() == one
    assert most - sum(x.nbytes for x in got) < 40 << 20


@pytest.mark.parametrize(("text_bytes", "gathered"), [(1, 1), (700, 50), (1 << 23, 1 << 17)])
def test_texts_are_encoded_by_parts(rows, plain, monkeypatch, text_bytes, gathered):
    from idledger.llm import tokens

    monkeypatch.setattr(tokens, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(tokens, "GATHERED", gathered)
    texts = [r[1] for r in rows]
    assert [x.tolist() for x in encoder(None, 100).encode(texts)] == [plain(t) for t in texts]
    assert encoder().encode([]) == []


@pytest.mark.parametrize("unpacked", [1, 40, 1 << 18])
def test_documents_in_turn(monkeypatch, unpacked):
    monkeypatch.setattr(tf, "UNPACKED", unpacked)
    ids = np.arange(300, dtype=np.uint32)
    for starts in ([], [0], [0, 0, 7, 7, 100, 299, 300]):
        file = tf.TokenFile(tf.encode_file(np.arange(len(starts)), np.array(starts, np.int64), ids[: 300 if starts else 0], 16, 16))
        assert [x.tolist() for x in file.documents()] == [file.document(i).tolist() for i in range(len(starts))]


def test_cutting_takes_bounded_memory(docs, monkeypatch):
    """What a packing worker takes for a batch of many texts is bounded by bytes of text too."""
    from idledger.llm import packing

    work, n = [], 4000
    monkeypatch.setattr(packing, "giving_back", lambda f: work.append(f) or f)
    packing.pieces(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "no_id": [False] * n, "text": ["one two three four five " * 150] * n})
    encoder().encode(["one two three four five"])
    tracemalloc.start()
    try:
        got = [r for b in work[0](iter([batch])) for r in b["doc_id"].to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == list(range(n)) and most < 40 << 20
