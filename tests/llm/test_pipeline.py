import zlib
from collections import Counter

import corpus_pipeline as cp
import duckdb
import numpy as np
import plain
import pytest
from compare import differs, duck

from idledger.llm import mixing, packing
from idledger.llm.oracles import quality_rules
from idledger.llm.queries import ORACLES, QUERIES


def test_stages_follow_from_each_other(spark, sf_dir, tmp_path):
    """Each stage's result against plain Python, or SQL, on what its predecessor kept; run() against the stages in a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        given = docs.toPandas()
        texts = dict(zip(given["doc_id"].tolist(), given["text"].tolist(), strict=True))
        folder = str(tmp_path / str(k))
        stage(spark, docs, sf_dir).write.parquet(folder)
        out = spark.read.parquet(folder)
        got = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        assert got and (out.columns == columns or name == "packing")
        if name == "quality_rules":
            con = duckdb.connect()
            con.register("documents", given)
            assert got == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules()}) WHERE kept").fetchall())
        elif name == "toxicity":
            scores = plain.toxic_scores({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, marks)
            sure = {i for i, s in scores.items() if abs(s[0] - 0.5) > 1e-6}
            assert {i for i in got if i in sure} == {i for i in sure if scores[i][0] < 0.5}
        elif name == "near_dedup":
            assert got == sorted(plain.least_of_near_copies(texts))
        elif name == "mixing":
            want = plain.mixed(texts, dict(zip(given["doc_id"].tolist(), given["lang"].tolist(), strict=True)), set(marks))
            have = Counter(got)
            assert sum(have[i] != w[2] for i, w in want.items()) <= len(want) // 100  # rates within rounding of a draw
        else:
            assert set(got) == set(texts)
        docs = out
    last = sorted(tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect())
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()) == last


def test_posteriors_and_rates(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "lang").collect()
    want = plain.mixed({r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["lang"] for r in rows}, {r["doc_id"] for r in labels.collect()})
    for r in mixing.mix(docs, labels).collect():
        post, rate, _ = want[r["doc_id"]]
        assert np.isclose(r["membership"], post.max(), atol=1e-6) and np.isclose(r["rate"], rate, atol=1e-3)


AWKWARD = "mark tile key label token tokens rate copies score predicted kept quality place part digest in_0 no_id component_id".split()


def _folder(spark, tmp_path, rows, name, clashes=AWKWARD):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in clashes})
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    marks = [(r[0], 1, int(r[0] % 4 == 0)) for r in rows[:40] if r[0] is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    return f"{tmp_path}/{name}"


def test_run_on_awkward_rows(spark, rows, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, large ids, clashing names; and no rows at all."""
    big = [((1 << 60) + 1, rows[8][1] + " more words", "en", None), (None, None, None, None), (None, rows[9][1], None, "s1"), *[rows[10]] * 5]
    got = cp.run(spark, _folder(spark, tmp_path, [*rows, *big], "some")).collect()
    assert got and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    whole = Counter()
    for r in got:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n % tokens == 0 for (_, tokens), n in whole.items())
    known = {r[0] for r in [*rows, *big]}
    assert {r["doc_id"] for r in got} <= known and not {200, 201, 202, 203} & {r["doc_id"] for r in got}
    assert cp.run(spark, _folder(spark, tmp_path, [], "none")).count() == 0


def test_packing_checksums(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = docs.orderBy("doc_id").first()
    ids = packing.encoder().encode([one["text"]])[0].tolist() + [packing.END_ID]
    first = [r for r in packing.pack(docs).collect() if r["doc_id"] == one["doc_id"] and r["start"] == 0][0]
    assert first["ids_crc32"] == zlib.crc32(np.array(ids[: first["length"]], "<u4").tobytes())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert differs(spark, duck(sf_dir), QUERIES[name], ORACLES[name], sf_dir) == ""
