import duckdb
import pytest
from compare import differs

from idledger.plans import registry


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Pages with addresses of 10 to 249 characters: base64 of more than 57 bytes exceeds a line of 76."""
    folder = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, ("https://a.example/" + "x" * 300)[: 10 + i], "<p>") for i in range(240)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return con, folder


def test_decode_long_ids(spark, pages):
    assert differs(spark, pages[0], registry.QUERIES["journal_decode"], registry.ORACLES["journal_decode"], pages[1]) == ""


def test_encode_long_ids(spark, pages):
    assert differs(spark, pages[0], registry.QUERIES["journal_encode"], registry.ORACLES["journal_encode"], pages[1]) == ""
    assert registry.QUERIES["journal_encode"](spark, pages[1]).where("value rlike '[\\r\\n]'").count() == 0


def test_invalid_count_of_long_ids(spark, pages):
    """Only the damaged lines are invalid: those of page_id % 7 in 1, 3 and 4."""
    assert differs(spark, pages[0], registry.QUERIES["journal_invalid_count"], registry.ORACLES["journal_invalid_count"], pages[1]) == ""
    assert tuple(registry.QUERIES["journal_invalid_count"](spark, pages[1]).first()) == (240, 103)
