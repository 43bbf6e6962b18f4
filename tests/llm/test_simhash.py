import random
import re

import numpy as np
import pytest
import xxhash

from idledger.llm import simhash as sh
from idledger.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(docs, rows):
    got = sh.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(r[1]) for r in rows]
    root = groups(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = sorted(((r[0], f"{prints[i]:016x}", least.get(root[i])) for i, r in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(len({w[0] for w in want if w[2] == c}) > 8 for c in {w[2] for w in want})


@pytest.mark.parametrize("chunk", [4096, 5])
def test_links_of_crowded_tiles(spark, monkeypatch, chunk):
    monkeypatch.setattr(sh, "CHUNK", chunk)
    rng = random.Random(1)
    marks = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        marks |= {centre ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) for _ in range(40)} | {centre}
    marks |= {rng.getrandbits(64) for _ in range(200)}
    marks = sorted(int(np.uint64(m).view(np.int64)) for m in marks)
    edges = sh.near_links(spark.createDataFrame([(m,) for m in marks], "mark long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    u = np.array(marks, np.int64).view(np.uint64)
    want = groups(marks, [(marks[i], marks[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= 2).tolist()])
    linked = [m for m in marks if sum(r == want[m] for r in want.values()) > 1]
    assert got == {m: want[m] for m in linked}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (-5, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, -5: -5, 200: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates(docs, rows):
    left = sh.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.collect()]
    marked = {tuple(r) for r in sh.near_duplicates(docs).select("doc_id", "component_id").collect()}
    assert sorted(k for k in kept if k is not None) == sorted({d for d, c in marked if d is not None and d == c})
    assert sum(k is None for k in kept) == 2


def test_nothing(no_docs):
    assert sh.near_duplicates(no_docs).count() == 0 and sh.drop_near_duplicates(no_docs).count() == 0
