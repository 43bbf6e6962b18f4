import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from idledger.llm import ann, mixing, toxicity
from idledger.llm import html_text as ht
from idledger.llm.licenses import SENTENCES, Scanner, scan_licences

# Toxicity.


def test_block_max_search_equals_brute_force():
    rng = random.Random(2)
    vectors = []
    for _ in range(700):
        at = sorted(rng.sample(range(40), rng.randint(1, 6)))
        w = np.array([rng.choice((1.0, 2.0, rng.random())) for _ in at])
        vectors.append((np.array(at), w / np.sqrt((w * w).sum())))
    keys = np.array(rng.sample(range(10_000), 700))
    flat = [np.concatenate(x) for x in zip(*vectors, strict=True)]
    index = toxicity.BlockMaxIndex(keys, np.array([len(at) for at, _ in vectors]), *flat, 40, block=16)
    dense = np.zeros((700, 40))
    place = {k: i for i, k in enumerate(keys.tolist())}
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    dense = dense[[place[k] for k in index.keys.tolist()]]
    asked = list(range(0, 700, 7))
    owns = [index.keys.tolist().index(keys[i]) if i % 2 else None for i in asked]
    for i, own, (docs, scores) in zip(asked, owns, index.search([vectors[i] for i in asked], 15, owns), strict=True):
        at, w = vectors[i]
        q = np.zeros(40)
        q[at] = w
        full = dense @ q
        if own is not None:
            full[own] = -1
        order = [d for d in np.lexsort((index.keys, -np.round(full, 12))) if full[d] > 0][:15]
        assert np.allclose(scores, full[order]) and len(docs) == len(order)
        assert [index.keys[d] for d in docs if full[d] > scores[-1] + 1e-9] == [index.keys[d] for d in order if full[d] > scores[-1] + 1e-9]


def test_toxic_words_are_learnt(spark, rows):
    rng = random.Random(9)
    plain = [r[1] for r in rows[:60]]
    data, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = rng.choice(plain).split()
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(("vile", "scumbag,", "hatefulxyz" + rng.choice("abc"))))
        data.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) == dict(marks)[i] for i, r in got.items() if r["held_out"])
    swapped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, swapped).collect()} == {i: r["score"] for i, r in got.items()}


def test_neighbours_are_the_nearest_by_brute_force(spark, rows, monkeypatch):
    """Words, weights, cosines, votes, curve and score worked out anew, in plain Python, over all words of all examples."""
    import plain

    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = random.Random(4)
    texts = [r[1] for r in rows[:60]] + [" ".join(rng.choice([r[1] for r in rows[:60]]).split()[:40]) for _ in range(140)] + ["", None]
    marks = {i: int(rng.random() < 0.2) for i in range(0, 200, 2)}
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    want = plain.toxic_scores(dict(enumerate(texts)), marks)
    for r in toxicity.toxicity(docs, labels).collect():
        score, best, cosine = want[r["doc_id"]]
        assert np.allclose(r["cosines"], [cosine[i] for i in best], atol=1e-9) and np.isclose(r["score"], score, atol=1e-6)
        assert [i for i in r["neighbours"] if cosine[i] > r["cosines"][-1] + 1e-9] == [i for i in best if cosine[i] > r["cosines"][-1] + 1e-9]


def test_toxicity_edges(docs, rows, labels, no_docs):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


# Mixing.


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    words = {"a": "alpha beta gamma delta", "b": "uno dos tres cuatro", "c": "eins zwei drei vier"}
    data = [(i, " ".join(rng.choices(words[d].split(), k=rng.randint(5, 60))), d) for i, d in enumerate(rng.choices("aaaaaaabbc", k=900))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 900, 3)], "doc_id long")
    got = mixing.mix(docs, labels, weights={"a": 0.5, "b": 0.3, "c": 0.2}).toPandas()
    assert (got["domain"].to_numpy() == np.array([dict((x[0], x[2]) for x in data)[i] for i in got["doc_id"]])).all()
    spent = (got["tokens"] * got["rate"]).groupby(got["domain"]).sum()
    assert (spent / spent.sum()).to_dict() == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}, abs=1e-3)
    assert got["rate"].min() >= 0 and got["rate"].max() <= 1.001
    drawn = mixing.draw(docs, labels, weights={"a": 0.5, "b": 0.3, "c": 0.2})
    assert drawn.columns == docs.columns and drawn.count() == got["copies"].sum()


def test_soft_rates_are_the_least_squares_ones(spark):
    rng = np.random.default_rng(0)
    t, p = rng.integers(1, 100, 200), rng.dirichlet((0.5, 0.5, 0.5), 200)
    goal = [0.2 * t.sum(), 0.5 * t.sum(), 0.1 * t.sum()]
    rows = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p, strict=True))], "i long, tokens long, p array<double>")
    r = mixing.fit_rates(rows, 3, goal, rounds=40).orderBy("i").toPandas()["rate"].to_numpy()
    want, size = np.ones(200), t @ p
    for _ in range(40):
        want = np.maximum(0, want - p @ (((t * want) @ p - goal) / size))
    assert np.allclose(r, want, atol=1e-5)
    assert ((((t * r) @ p - goal) ** 2 / size).sum()) < 0.02 * (((t @ p - goal) ** 2 / size).sum())


def test_mixing_edges(docs, rows, labels, no_docs):
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["tokens"] for r in got if r["doc_id"] in (200, 202, 203, 204)} == {200: 0, 202: 0, 203: 1, 204: 2}
    assert mixing.mix(no_docs, labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == len(rows)
    assert mixing.draw(docs, labels).columns == docs.columns
    plan = mixing.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Neighbours.


@pytest.mark.parametrize("copies", [1, 300])
def test_nearest_recall(spark, copies):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)]).round(3)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).toPandas()
    hit = total = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -np.round(score, 9))) if i != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine["score"], score[mine["vec_id"]])
        assert sorted(zip(-mine["score"].round(9), mine["vec_id"], strict=True)) == list(zip(-mine["score"].round(9), mine["vec_id"], strict=True))
        hit += len(set(best) & set(mine["vec_id"]))
        total += 10
    assert hit / total >= 0.95


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_of_a_full_shard(kind):
    """20,000 vectors of 64 dimensions in one shard; queries from it and from outside."""
    rng = np.random.default_rng(6)
    n, d = ann.SHARD_ROWS, 64
    if kind == "even":
        every = rng.normal(size=(n + 300, d))
    else:
        every = rng.normal(size=(200, d))[rng.integers(0, 200, n + 300)] + 0.3 * rng.normal(size=(n + 300, d))
    level = ann.levelled(every[:n])
    out, entry = ann.build_graph(level)
    asked = np.concatenate([every[n:], every[:300]])
    flat = np.concatenate([asked, np.zeros((600, 1))], axis=1).astype(np.float32)
    found, beam = ann.search_shard(level, out, entry, flat, 29, ann.SEARCH_BEAM, ann.RECALL)
    exact, none = ann.search_shard(level, out, entry, flat, 29, ann.SEARCH_BEAM, None)
    want = np.argsort(-(asked @ every[:n].T), axis=1)[:, :21]
    assert none is None and np.mean([np.isin(w, e).mean() for w, e in zip(want, exact, strict=True)]) > 0.999
    for most in (3, 21):
        assert np.mean([np.isin(w[:most], f).mean() for w, f in zip(want, found, strict=True)]) >= 0.9
    assert (beam is None) == (kind == "even")


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for recall in (ann.RECALL, None):
        got = ann.nearest(df, F.col("vec_id") % 5 == 0, k=3, recall=recall).collect()
        for i, v in rows[::5]:
            best = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:3]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [j for _, j in best]


def test_nearest_edges(spark):
    shape = "vec_id long, embedding array<float>, v string, q string"
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5, 0.5]), (40, [-1.0, 0.0]), (40, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in odd + good], shape)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, 1, 21), (20, 2, 22), (20, 3, 40), (40, 1, 22), (40, 2, 20), (40, 3, 21)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame(odd[:6], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# Pages.


def test_marginals_equal_enumeration():
    page = ht.parse("<body><div class=nav><ul><li>a</ul></div><article><p>b<p>c</article></body>")
    forest = ht.Forest([page, ht.parse("")])
    rng = np.random.default_rng(0)
    w, e = rng.normal(size=ht.WIDTH), rng.normal(size=(len(ht.EDGES), 2, 2))
    n, total, ones = len(page.parent), 0.0, np.zeros(len(page.parent))
    unary = forest.features @ w
    for state in np.ndindex(*(2,) * n):
        s = sum(unary[i] * state[i] for i in range(n)) + sum(e[forest.edge[i], state[page.parent[i]], state[i]] for i in range(n) if page.parent[i] >= 0)
        total += np.exp(s)
        ones += np.exp(s) * np.array(state)
    assert np.allclose(forest.marginals(w, e)[:n], ones / total)


@pytest.fixture(scope="module")
def model():
    return ht.default_model()


def test_held_out_pages(model):
    pages = ht.labelled_pages(150, 77)
    forest = ht.Forest([ht.parse(p) for p in pages])
    y = forest.marked.copy()
    for nodes in forest.levels:
        bare = nodes[y[nodes] < 0]
        y[bare] = np.where(forest.parent[bare] < 0, 0, y[forest.parent[bare]])
    text = forest.features[:, 1 + len(ht.TAGS) + len(ht.HINTS) + 4] == 0
    assert (((forest.marginals(model.weights, model.edges) >= 0.5) == y)[text]).mean() > 0.98


def test_extract(spark, model):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More news</a></ul></nav><!-- x <p>no</p> -->"
        "<div class='ad'>Buy this now today.</div><article><h1>The  title &amp; more</h1><p><b>First&nbsp;para graph, with\n words &lt;here&gt;.<br><p>Second one <a href=/z>linked</a> follows, and it is long enough to be read.</p>"
        "</article><section class=comments><h3>Comments</h3><p>I disagree with this.</p></section><footer>&copy; someone</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<<<>>> < b"), (5, "x", "<div>" * 3000 + "deep"), (1, "u", page)]
    got = ht.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), model).collect()
    want = "The title & more\nFirst para graph, with words <here>.\nSecond one linked follows, and it is long enough to be read."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><table><tr><th>a</th><td>1</td></tr></table></article>", "a\n1"),
        ("<body>Loose text that stands here, in the body, with two sentences. And more.</body>", "Loose text that stands here, in the body, with two sentences. And more."),
        ('<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav>Loose text here, in the body. It has sentences.<br><br>Another part.<footer>&copy; X</footer></body></html>', "Loose text here, in the body. It has sentences. Another part."),
        ("<html><head><title>T</title><article><p>An article after an open head. It has text.</p></article>", "An article after an open head. It has text."),
        ("<html><head><meta charset=utf-8><title>T</title>Words after an open head, right in the page. They count.", "Words after an open head, right in the page. They count."),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as known.</p></article>", "Energy is E=mc2 as known."),
    ],
)
def test_text_of_unusual_pages(model, page, want):
    assert model.extract([page])[0][0] == want


# Licences.


NAMED = {
    "SPDX-License-Identifier: ISC": ["ISC"],
    "# SPDX-License-Identifier: MPL-2.0\nimport os": ["MPL-2.0"],
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": ["GPL-2.0-or-later"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT OR Apache-2.0"],
    "SPDX-License-Identifier: (LGPL-2.1-only WITH Classpath-exception-2.0 AND CC-BY-NC-4.0)": ["(LGPL-2.1-only WITH Classpath-exception-2.0 AND CC-BY-NC-4.0)"],
    "This project is licensed under the MIT License.": ["MIT"],
    "Distributed under the MIT License.": ["MIT"],
    "This work is licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
    "Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n": ["Apache-2.0"],
    "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": ["GPL-3.0-only"],
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": ["LGPL-2.1-or-later"],
    "Licensed under either of Apache License, Version 2.0 or the MIT licence, at your option.": ["Apache-2.0", "MIT"],
    "This is not licensed under the MIT License.": [],
    "Foo is released under terms that differ. The licence is unknown.": [],
}


def test_licence_notices_and_expressions(spark):
    s = Scanner()
    assert {t: [x[0] for x in s.scan(t)] for t in NAMED} == NAMED
    docs = spark.createDataFrame([((1 << 60) + i, f"Some words.\n{t}") for i, t in enumerate(NAMED)] + [(None, "MIT")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licences(docs).collect()}
    for i, (t, names) in enumerate(NAMED.items()):
        r = got[(1 << 60) + i]
        assert r["licences"] == ",".join(dict.fromkeys(names)) and r["n_matches"] == len(names)
        assert r["restricted"] == any("-NC" in n for n in names)
        assert all(f"Some words.\n{t}"[x["start"] : x["end"]].strip("() ") for x in r["spans"])
    assert got[None]["n_matches"] == 0 and len(got) == len(NAMED) + 1


def test_the_parts_of_a_licence_stand_together():
    s = Scanner()
    parts = [SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")]
    assert [x[0] for x in s.scan(".\n".join(parts) + ".")] == ["BSD-3-Clause"]
    far = ".\n" + "other words " * 40 + ".\n"
    assert [x[0] for x in s.scan(".\n".join(parts[:3]) + far + parts[3] + ".")] == ["BSD-2-Clause"]
    assert s.scan(far.join(parts) + ".") == []


def test_sentence_rules_equal_a_plain_matcher():
    """Sentences by splitting at every edge and comparing word lists, rules by trying each at each place."""
    import re

    from idledger.llm.licenses import RULES, gnu_sentences, words_of

    table = SENTENCES | gnu_sentences()
    plain = {name: words_of(t) for name, t in table.items()}
    rng, s = random.Random(8), Scanner(named={})
    for _ in range(60):
        names = []
        for _ in range(rng.randint(1, 6)):
            r = rng.choice(RULES)
            names += [*r.sentences, *(["noise"] * rng.randint(0, 2))]
        text = "\n".join((table[n] if n != "noise" else "nothing to see here") + "." for n in names)
        ids = []
        for line in text.split("\n"):
            hit = [n for n in plain if plain[n] == words_of(line)]
            ids.append(min(hit, key=list(plain).index) if hit else None)
        ids = [i for i in ids if i]
        want, i = [], 0
        while i < len(ids):
            r = next((r for r in RULES if all(x == y or plain.get(x) == plain.get(y) for x, y in zip(r.sentences, ids[i:], strict=False)) and len(ids) - i >= len(r.sentences)), None)
            want += [r.licence] if r else []
            i += len(r.sentences) if r else 1
        got = [x[0] for x in s.scan(text)]
        assert got == want, re.sub(r"\n", " | ", text)


def test_licence_rules(docs, rows, no_docs):
    s = Scanner()
    mit = ".\n".join(SENTENCES[k] for k in ("mit.grant", "mit.notice", "mit.asis", "mit.liable")) + "."
    assert [x[0] for x in s.scan(f"Foo.\n\n{mit}\n")] == ["MIT"]
    assert s.scan(mit)[0][2:] == (0, len(mit) - 1)
    assert [x[0] for x in s.scan(mit.replace(" ", "\n"))] == ["MIT"]
    bsd = ": ".join([SENTENCES["bsd.grant"], "1. " + SENTENCES["bsd.source"] + ".\n 2. " + SENTENCES["bsd.binary"] + "."])
    assert [x[0] for x in s.scan(bsd)] == ["BSD-2-Clause"]
    assert [x[0] for x in s.scan(bsd + " " + SENTENCES["bsd.names"] + ".")] == ["BSD-3-Clause"]
    assert s.scan("we licensed under the MIT License things") == [] and s.scan(None) == [] and s.scan("Released under the MIT Licenses.") == []
    assert [x[0] for x in s.scan("no end\nLicensed under CC BY-NC 4.0.\nAll rights reserved.")] == ["CC-BY-NC-4.0", "All-rights-reserved"]
    assert [x[0] for x in s.scan("# SPDX-License-Identifier: Apache-2.0\nimport os")] == ["Apache-2.0"]
    got = scan_licences(docs).collect()
    assert len(got) == len(rows) and not any(r["n_matches"] for r in got)
    assert scan_licences(no_docs).count() == 0


def test_what_is_found_is_not_broadcast(spark):
    """It grows with queries times shards, and the driver collects what is broadcast."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 5 == 0, k=3)
    assert len(found.collect()) == 240
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # as it ran
    assert "MapInPandas ask" in plan and "SortMergeJoin [point#" in plan and "BroadcastHashJoin [point#" not in plan
