import random
import re

import corpus_pipeline as cp
import pytest

from idledger.llm import near_copies as nc


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow_groups(rows):
    """The least doc_id of each row's component, by comparing all pairs."""
    sets = [slow_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (a == sets[j] or (a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]))):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, row in zip(root, rows, strict=True):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    return [(row[0], least.get(r)) for r, row in zip(root, rows, strict=True)]


@pytest.fixture(scope="module")
def edited():
    """Texts and copies with more and more words changed, about Jaccard 0.5 to 1, and a common passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage, out = " ".join(word() for _ in range(30)), []
    for i in range(40):
        words = [word() for _ in range(rng.randint(30, 200))]
        out.append((1000 + 10 * i, " ".join(words) + (f" {passage}" if i % 2 else "")))
        for k in range(1, 6):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, k * len(words) // 100)):
                changed[at] = word()
            out.append((1000 + 10 * i + k, " ".join(changed) + (f" {passage}" if i % 2 else "")))
    return out


def test_equal_brute_force(spark, rows, edited):
    table = [(r[0], r[1]) for r in rows] + edited
    got = nc.near_copies(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(slow_groups(table), key=repr)


def test_stage_drops_what_two_bits_miss(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect())
    assert kept == sorted({c for _, c in slow_groups(edited)})


def test_order_does_not_matter(spark, edited, monkeypatch):
    want = sorted(slow_groups(edited), key=repr)
    monkeypatch.setattr(nc, "COMMON", 1)
    got = nc.near_copies(spark.createDataFrame(edited, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_nothing(no_docs):
    assert nc.near_copies(no_docs).count() == 0 and nc.drop_near_copies(no_docs).count() == 0


def test_stage_starts_with_simhash_links(spark, edited, monkeypatch):
    """The SimHash search runs over all fingerprints; what it misses the exact way finds, whatever its radius."""
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    marks, asked = {nc.majority(nc.shingle_set(t)) for _, t in edited}, []
    near_links = nc.near_links
    monkeypatch.setattr(nc, "near_links", lambda m, radius: asked.append(m.count()) or near_links(m, radius))
    for radius in (nc.RADIUS, 1):
        monkeypatch.setattr(nc, "RADIUS", radius)
        kept = sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect())
        assert kept == sorted({c for _, c in slow_groups(edited)})
    assert asked == [len(marks)] * 2


def test_sketches_rule_out_no_similar_pair():
    rng = random.Random(5)
    out = 0
    for _ in range(3000):
        n, m = rng.choice((1, 2, 7, 64, 130, 700, 3000)), rng.randint(0, 9)
        both = [rng.getrandbits(64) for _ in range(n)]
        a, b = ({*both, *(rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n * m // 30))))} for _ in "ab")
        x, y = (nc.np.array(sorted(s), nc.np.uint64) for s in (a, b))
        least = nc._least_difference(nc.parity_sketch(x), nc.parity_sketch(y))
        assert least <= len(a ^ b) and (least - len(a ^ b)) % 2 == 0
        out += least * 1.8 > 0.2 * (len(a) + len(b)) + 1e-9
    assert out > 300


def test_texts_move_for_few_pairs(spark, monkeypatch):
    """Texts that share one rare passage are candidates by the square of their number; their texts stay where they are."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passage) for i in range(120)] + [(500, None), (501, "a b c d e f g"), (502, "a b c d e f g"), (None, "A b c d e f g")]
    moved, texts = [], nc._texts
    monkeypatch.setattr(nc, "_texts", lambda docs, wanted, shingle: moved.append(wanted.distinct().count()) or texts(docs, wanted, shingle))
    monkeypatch.setattr(nc, "COMMON", 1)
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(slow_groups(rows), key=repr)
    assert sum(moved) <= 4


def counted(monkeypatch):
    """The number of candidate pairs of each round, filled in while near_copies runs."""
    asked, verified = [], nc._verified
    monkeypatch.setattr(nc, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    return asked


def test_a_group_of_near_copies_takes_few_pairs(spark, monkeypatch):
    """Copies of one text with a few words changed each, some too many to be linked: candidates do not grow with the square of their number."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3, 4))):
            words[at] = word()
        rows.append((i, " ".join(words)))
    asked = counted(monkeypatch)
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(slow_groups(rows))
    assert len(asked) == 2 and asked[0] < 25 * len(rows) and asked[1] < 5 * len(rows)


def test_shared_passages_are_known_as_common(spark, monkeypatch):
    """Passages that 40 texts share, more than half of each, stay out of the prefixes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passages = [" ".join(word() for _ in range(60)) for _ in range(20)]
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passages[i % 20]) for i in range(800)]
    monkeypatch.setattr(nc, "ORDER_TEXTS", 10)
    asked = counted(monkeypatch)
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(800)]
    assert sum(asked) < 2 * len(rows)


def test_known_shingles_have_a_bound(spark, monkeypatch):
    texts = ["a b c d e f"] * 9 + ["b c d e f g"] * 5 + ["x y z u v"] * 4
    docs = spark.createDataFrame([(i, f"{t} {i} {i} {i} {i}") for i, t in enumerate(texts)], "doc_id long, text string")
    for bound, want in ((100, [4, 5, 9, 14]), (3, [5, 9, 14]), (2, [9, 14]), (0, [])):
        monkeypatch.setattr(nc, "COMMON", bound)
        order, sets = nc._common(docs, 18, 5).tolist(), [set(nc.shingle_set(t).tolist()) for _, t in docs.collect()]
        assert [sum(s in own for own in sets) for s in order] == want
