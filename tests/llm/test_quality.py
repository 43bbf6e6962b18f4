import math
import re
from collections import Counter

import numpy as np
import pytest

from idledger.llm import quality_classifier as qc
from idledger.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_and_base(docs, rows):
    got = qr.judge(docs).collect()
    want = Counter()
    for doc, text, *_ in rows:
        c = counts(text)
        want[(doc, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5) for r in got)
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and r["n_words"] >= 100)


def test_symbols_and_shouting_go(spark, rows):
    clean = [(r[0], r[1]) for r in rows[:60]]
    junk = [(1000 + i, " ".join(w + "###" for w in t.split())) for i, t in clean if len(t) > 600][:5]
    junk += [(2000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in clean if len(t) > 600][:5]
    kept = {r["doc_id"] for r in qr.keep_good(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert not kept & {i for i, _ in junk} and {i for i, t in clean if len(t.split()) >= 100} <= kept


def test_expectation_maximisation_equals_plain_python(spark):
    rules = tuple(qr.Rule(f"r{j}", "false", "false", 0.8, 0.8) for j in range(3))
    table = [((1, 1, None), 50), ((0, 1, 0), 9), ((0, None, 0), 20), ((1, 0, 1), 4), ((None, None, None), 3)]
    model = qr.fit(spark.createDataFrame([(*v, n) for v, n in table], "v0 int, v1 int, v2 int, rows long"), rules, rounds=12, tolerance=0)
    share, good, bad = 0.8, [0.8] * 3, [0.8] * 3
    for _ in range(12):
        q = []
        for v, _n in table:
            odds = math.log(share / (1 - share))
            for j, x in enumerate(v):
                odds += 0 if x is None else math.log(good[j] / (1 - bad[j])) if x else math.log((1 - good[j]) / bad[j])
            q.append(1 / (1 + math.exp(-odds)))
        g = sum(p * n for p, (_, n) in zip(q, table, strict=True))
        total = sum(n for _, n in table)
        share = (g + 8) / (total + 10)
        for j in range(3):
            right = lambda w, value: sum(w(p) * n for p, (v, n) in zip(q, table, strict=True) if v[j] == value)  # noqa: B023, E731
            good[j] = (right(lambda p: p, 1) + 8) / (right(lambda p: p, 1) + right(lambda p: p, 0) + 10)
            bad[j] = (right(lambda p: 1 - p, 0) + 8) / (right(lambda p: 1 - p, 1) + right(lambda p: 1 - p, 0) + 10)
    assert model.share == pytest.approx(share) and model.on_good == pytest.approx(good) and model.on_bad == pytest.approx(bad)


def test_rules_run_without_python(docs):
    plan = qr.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nothing(no_docs, labels):
    assert qr.judge(no_docs).count() == 0 and qr.keep_good(no_docs).count() == 0
    assert qc.resample(no_docs, labels).count() == 0


def test_resampling(docs, rows, labels):
    got = qc.resample(docs, labels, fraction=0.5, buckets=500).collect()
    raw = sum((np.bincount(qc.ngram_buckets(r[1], 500), minlength=500) for r in rows), np.zeros(500))
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    target = sum((np.bincount(qc.ngram_buckets(r[1], 500), minlength=500) for r in rows if r[0] in good), np.zeros(500))
    ratio = qc.log_ratios(target, raw)
    want = sorted((str(r[0]), float(ratio[qc.ngram_buckets(r[1], 500)].sum())) for r in rows)
    mine = sorted((str(r["doc_id"]), r["log_weight"]) for r in got)
    assert [m[0] for m in mine] == [w[0] for w in want] and np.allclose([m[1] for m in mine], [w[1] for w in want])
    keys = sorted((r["sample_key"] for r in got), reverse=True)
    last = keys[round(len(rows) * 0.5) - 1]
    assert {r["sample_key"] for r in got if r["kept"]} == {k for k in keys if k >= last}
    assert [len(qc.ngram_buckets(t)) for t in (None, "", "a", "a b", "a b a")] == [0, 0, 1, 3, 5]


def test_kth_largest(spark):
    values = [0.5, 0.25, 0.25, 0.25, -3.0, 1e9, 1e-300, 0.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [qc.kth_largest(df, "x", k) for k in range(1, 9)] == sorted(values, reverse=True)[:8]
    assert qc.kth_largest(df, "x", 9) == float("-inf") and qc.kth_largest(df, "x", 0) == float("inf")
