"""64-bit ids beside nulls stay whole: pandas would hold them as floats of 53 bits."""

import zlib

import pytest

from idledger.llm import html_text, licenses, near_copies, packing, simhash, toxicity
from idledger.llm import token_files as tf
from idledger.llm.mixing import mix
from idledger.llm.quality_classifier import resample
from idledger.llm.quality_rules import judge

A, B = (1 << 60) + 1, (1 << 60) + 3
ROWS = [(A, "one two three four five"), (B, "six seven eight nine ten"), (None, "eleven twelve"), (-A, "one two three four five")]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(A, 1, 0), (B, 0, 1)], "doc_id long, quality int, toxic int")


WHOLE = {
    "pack": lambda d, m: packing.pack(d),
    "near_duplicates": lambda d, m: simhash.near_duplicates(d),
    "near_copies": lambda d, m: near_copies.near_copies(d),
    "token_digest": lambda d, m: tf.token_digest(d),
    "scan_licences": lambda d, m: licenses.scan_licences(d),
    "toxicity": lambda d, m: toxicity.toxicity(d, m),
    "resample": lambda d, m: resample(d, m),
    "judge": lambda d, m: judge(d),
    "mix": lambda d, m: mix(d.selectExpr("*", "'en' as lang"), m),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_ids_beside_a_null(wide, marks, name):
    got = [r["doc_id"] for r in WHOLE[name](wide, marks).collect()]
    assert sorted(got, key=repr) == sorted((r[0] for r in ROWS), key=repr)


def test_component_ids_are_whole(wide):
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(wide).collect()} == {A: -A, -A: -A, B: B, None: None}
    assert {r["doc_id"] for r in near_copies.drop_near_copies(wide).collect()} == {-A, B, None}


def test_page_ids_are_whole(spark):
    pages = spark.createDataFrame([(A, "u", "<article><p>a b c.</p></article>"), (B, None, None), (None, "v", "")], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["url"]) for r in html_text.extract(pages).collect()} == {(A, "u"), (B, None), (None, "v")}


def test_equal_rows_are_dealt_over_the_token_files(spark, tmp_path):
    rows = spark.createDataFrame([(7, "the same text of a few words")] * 3000 + [(None, "x"), (A, "y")], "doc_id long, text string")
    written = tf.write_token_files(rows, f"file://{tmp_path}/f", file_bytes=4000).collect()
    assert len(written) > 20 and max(r["documents"] for r in written) < 600
    got = tf.read_token_files(spark, f"file://{tmp_path}/f", spark.createDataFrame(written)).orderBy("start").collect()
    assert len(got) == 3002 and got[0]["doc_id"] is None and got[-1]["doc_id"] == A
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert len({r["ids_crc32"] for r in got[1:-1]}) == 1 and zlib.crc32(b"") == 0
