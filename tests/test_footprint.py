import duckdb
from compare import differs
from pyspark.sql import functions as F

from idledger.options import HistoryOptions
from idledger.plans import registry, stored
from idledger.store import HistoryStore


def test_words_are_committed_with_their_batch(spark, tmp_path):
    """One version for each batch, whether its words are stored because of the mode or because it closes the generation."""
    options = dict(shard_count=1, slots_per_shard=16, max_load_factor_percent=75, proactive_rollover_load_factor_percent=50)
    for mode, covered in (("durability", {"1": ["a", "b"], "2": ["c"]}), ("throughput", {"1": ["a", "b"]})):
        store = HistoryStore(spark, str(tmp_path / mode), HistoryOptions(**options, bloom_persist_mode=mode))
        for k, name in enumerate("abc"):
            rows = spark.range(4 * k, 4 * k + 4).select(F.col("id").alias("seq"), F.concat(F.lit("<"), F.col("id"), F.lit("@b>")).alias("message_id"), F.lit(stored.SERVER).alias("server_id"))
            assert store.add_batch(rows, batch_id=name).where("status = 'inserted'").count() == 4
            assert store.sync() == k + 1
        again = HistoryStore(spark, str(tmp_path / mode), store.options)
        assert (again.sync(), again.manifest.active_generation) == (3, 2)
        assert {g: b["batches"] for g, b in again.manifest.bloom.items()} == covered


def test_footprint_beyond_a_generation(spark, tmp_path):
    """More keys than a generation of SMALL takes, most of them in the first of three batches."""
    folder, i = str(tmp_path), F.col("id")
    at = 3 * i + F.when(i < 520_000, 0).otherwise(1 + i % 2)
    kind = F.element_at(F.array(*(F.lit(t) for t in ("click", "error", "purchase", "signup", "view"))), (i % 5 + 1).cast("int"))
    rows = spark.range(0, 526_000, 1, 4).select(at.alias("event_id"), F.timestamp_seconds(i).alias("ts"), F.floor(i / 5).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    fullest = con.execute(f"SELECT max(n) FROM (SELECT count(DISTINCT (hash_hi, hash_lo)) AS n FROM ({stored.VALID} AND seq % 3 = 0) GROUP BY ulo % 8)").fetchall()[0][0]
    assert fullest > HistoryOptions(**stored.SMALL).rollover_threshold
    assert differs(spark, con, registry.QUERIES["store_footprint"], registry.ORACLES["store_footprint"], folder) == ""
