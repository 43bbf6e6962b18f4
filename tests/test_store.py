import random
import uuid

import pytest

from idledger.operators import history
from idledger.options import HistoryOptions
from idledger.store import HistoryStore

SERVER = "11111111-1111-1111-1111-111111111111"
SMALL = dict(shard_count=4, slots_per_shard=1 << 16)


def batch(spark, items, start=0):
    return spark.createDataFrame([(start + i, m, s) for i, (m, s) in enumerate(items)], "seq long, message_id string, server_id string")


def statuses(df):
    return [r["status"] for r in df.orderBy("seq").collect()]


def test_add_then_lookup_then_reopen(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    ids = [f"batch-a-{i}" for i in range(4)]
    assert store.add_items([(i, SERVER) for i in ids]) == [True] * 4
    assert store.add_items([(ids[0], SERVER), ("new", SERVER), ("new", SERVER)]) == [False, True, False]
    again = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    assert [again.contains(i) for i in (*ids, "new", "other")] == [True] * 5 + [False]
    assert [r["message_id"] for r in again.walk().collect()] == [*ids, "new"]
    assert again.snapshot().first()["used_slots"] == 5
    assert again.scrub(3) == {"sampled": 3, "repeated": 0, "misplaced": 0}
    with pytest.raises(ValueError, match="^slots_per_shard"):
        HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(shard_count=4, slots_per_shard=1 << 10))


def test_rejects(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    with pytest.raises(ValueError, match="^items"):
        store.add_items([(f"x{i}", SERVER) for i in range(129)])
    with pytest.raises(ValueError, match="^message_id"):
        store.add(" ", SERVER)
    with pytest.raises(ValueError, match="^server_id"):
        store.add("a", "nope")
    got = store.add_batch(batch(spark, [("a", SERVER), (None, SERVER), ("", SERVER), ("b", "nope"), ("a", SERVER)]))
    assert statuses(got) == ["inserted", "invalid", "invalid", "invalid", "duplicate"]
    assert store.walk().count() == 1


def test_expire_and_walk(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL, max_walk_entries=4))
    store.add_items([(f"m{i}", SERVER) for i in range(6)])
    assert store.expire_ids(["m3", "m3", "never"]) == 2
    assert store.expire_ids(["m3"]) == 0
    assert not store.contains("m3")
    assert store.add("m3", SERVER) is False and not store.contains("m3")
    assert store.add("never", SERVER) is True and store.contains("never")
    assert store.evicted_walk_entries == 3
    assert [r["message_id"] for r in store.walk(1).collect()] == ["m4", "m5", "never"]
    at, seen = 0, []
    while True:
        at, entry = store.walk_next(at)
        if entry is None:
            break
        seen.append(entry[0])
    assert seen == ["m4", "m5", "never"] and at == 7


def test_rollover_retention_replay_and_vacuum(spark, tmp_path):
    options = HistoryOptions(shard_count=1, slots_per_shard=16, max_load_factor_percent=75, proactive_rollover_load_factor_percent=50, max_retained_generations=2)
    store = HistoryStore(spark, str(tmp_path / "h"), options)
    for k in range(4):
        rows = batch(spark, [(f"g{k}-{i}", SERVER) for i in range(5)], 100 * k)
        assert statuses(store.add_batch(rows, batch_id=f"b{k}")) == ["inserted"] * 5
        assert statuses(store.add_batch(rows, batch_id=f"b{k}")) == ["inserted"] * 5
    assert store.manifest.active_generation == 3 and store.manifest.journal_rows == 20
    assert [store.contains(f"g{k}-0") for k in range(4)] == [False, False, True, True]
    assert store.walk().count() == 20
    assert store.compact(2) == 2 and store.entries().count() == 10
    assert len(store.vacuum()) == 5  # two batches of generation 1, two that were compacted, and the words of generation 1
    assert [HistoryStore(spark, str(tmp_path / "h"), options).contains(f"g{k}-4") for k in range(4)] == [False, False, True, True]
    assert store.add("g0-0", SERVER) is True


def test_conflicting_commit(spark, tmp_path):
    from idledger.catalog import ManifestConflict

    a, b = (HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL)) for _ in range(2))
    a.add("x", SERVER)
    with pytest.raises(ManifestConflict):
        b.add("y", SERVER)


def test_replay_equals_a_model(spark):
    rng = random.Random(5)
    ops = [(s, rng.choice(["add", "expire", "lookup"]), rng.randrange(40), 0) for s in range(1500)]
    stored, gone, want = set(), set(), []
    for _, op, k, _ in ops:
        if op == "add":
            want.append("duplicate" if k in stored else "inserted")
            if k not in stored:
                stored.add(k)
                gone.discard(k)
        elif op == "expire":
            want.append("noop" if k in gone else "expired")
            gone.add(k)
        else:
            want.append("hit" if k in stored and k not in gone else "miss")
    df = history.replay(spark.createDataFrame(ops, "seq long, op string, hash_hi long, hash_lo long"))
    assert [r["result"] for r in df.orderBy("seq").collect()] == want


def test_streaming(spark, tmp_path):
    from idledger.streaming.ingest import ingest, row_statuses

    source = str(tmp_path / "in")
    for k in range(3):
        batch(spark, [(f"s{(k * 7 + i) % 12}", str(uuid.UUID(int=i))) for i in range(10)], 10 * k).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("seq long, message_id string, server_id string").option("maxFilesPerTrigger", 1).parquet(source)
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    for _ in range(2):
        ingest(stream(), store, str(tmp_path / "c1"), available_now=True).awaitTermination()
    assert store.entries().count() == 12 and store.audit().count() == 0
    q = row_statuses(stream()).writeStream.format("memory").queryName("st").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["status"]: r["n"] for r in spark.sql("select status, count(*) n from st group by 1").collect()} == {"inserted": 12, "duplicate": 18}


def test_words_rule_out_and_are_repaired(spark, tmp_path):
    options = HistoryOptions(**SMALL, bloom_persist_mode="durability", bloom_memory_budget_bytes=1 << 16)
    store = HistoryStore(spark, str(tmp_path / "h"), options)
    store.add_batch(batch(spark, [(f"a{i}", SERVER) for i in range(50)]), batch_id="a")
    got = store.add_batch(batch(spark, [(f"a{i}", SERVER) for i in range(40, 60)], 100), batch_id="b")
    assert statuses(got) == ["duplicate"] * 10 + ["inserted"] * 10
    keys = history.keyed(spark.createDataFrame([(f"n{i}",) for i in range(200)], "message_id string"), "message_id")
    assert store._candidates(keys)[1].count() < 100  # most unknown ids are ruled out
    assert store.verify() == [] and store.scrub(20) == {"sampled": 20, "repeated": 0, "misplaced": 0} and store.scrub_log()["missing"] == 0
    broken = store.manifest.bloom["1"]
    store._read([broken["path"]], "generation int, shard_id int, word_idx int, word long").limit(1).write.parquet(f"{store.catalog.root}/bloom/broken")
    broken["path"] = "bloom/broken"
    store.scrub(20)
    assert store.scrub_log()["missing"] > 0 and store.lookup(spark.createDataFrame([("a0",), ("zz",)], "message_id string")).where("found").count() == 1
    store.close()
    with pytest.raises(ValueError, match="closed"):
        store.entries()


def test_rollover_by_queue_and_failures_and_live_settings(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(shard_count=1, slots_per_shard=16, proactive_rollover_load_factor_percent=0, queue_capacity_per_shard=100))
    store.add_batch(batch(spark, [(f"a{i}", SERVER) for i in range(10)]), batch_id="a")
    assert store.manifest.active_generation == 1 and store.failures().count() == 0
    store.tune(proactive_rollover_queue_watermark_percent=5)
    with pytest.raises(ValueError, match="^shard_count"):
        store.tune(shard_count=2)
    with pytest.raises(ValueError, match="^bloom_persist_mode"):
        store.tune(bloom_persist_mode="never")
    store.add_batch(batch(spark, [(f"b{i}", SERVER) for i in range(5)], 20), batch_id="b")
    assert store.manifest.active_generation == 2
    store.tune(proactive_rollover_queue_watermark_percent=0, proactive_rollover_aggregate_probe_failures_threshold=3, proactive_rollover_load_factor_percent=0)
    store.add_batch(batch(spark, [(f"c{i}", SERVER) for i in range(11)], 40), batch_id="c")
    assert store.manifest.active_generation == 2
    store.add_batch(batch(spark, [(f"d{i}", SERVER) for i in range(4)], 60), batch_id="d")
    assert store.manifest.active_generation == 3


def test_tombstones_are_appended_and_merged(spark, tmp_path, monkeypatch):
    import idledger.store as module

    monkeypatch.setattr(module, "MOST_TOMBSTONES", 2)
    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    for k in range(3):
        assert store.expire_ids([f"e{k}", "e0"]) == (1 if k else 1)
    assert len(store.manifest.expired) == 3
    assert store.add("e1", SERVER) and store.contains("e1") and not store.contains("e0")
    assert len(store.manifest.expired) == 1 and store.expired().count() == 2


def test_older_manifests_are_read(spark, tmp_path):
    import json

    store = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    store.add("x", SERVER)
    newest = sorted((tmp_path / "h" / "_manifests").glob("0*.json"))[-1]
    found = json.loads(newest.read_text())
    old = {k: v for k, v in found.items() if k in ("version", "shard_count", "slots_per_shard", "active_generation", "used", "batches", "journal_rows")} | {"expired": None}
    newest.write_text(json.dumps(old))
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    again = HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))
    assert again.contains("x") and again.manifest.expired == [] and again.add("y", SERVER)
    newest.write_text(json.dumps(old | {"format": 99}))
    for p in (newest.parent).glob("000000000002*"):
        p.unlink()
    with pytest.raises(ValueError, match="format"):
        HistoryStore(spark, str(tmp_path / "h"), HistoryOptions(**SMALL))


def test_many_commits(spark, tmp_path):
    """A commit writes what it changed; every CHECKPOINT-th one everything; opening reads back to it."""
    from idledger.catalog import Catalog, Manifest

    catalog, m = Catalog(spark, str(tmp_path / "m")), Manifest()
    for k in range(70):
        m.batches[f"b{k}"] = {"generation": 1, "entries": None, "journal": None, "inserted": k}
        m = catalog.commit(m, {f"b{k}"})
    assert catalog.load() == m and len(m.batches) == 70
    sizes = [p.stat().st_size for p in sorted((tmp_path / "m" / "_manifests").glob("0*.json"))]
    assert max(sizes[i] for i in range(70) if (i + 1) % 32) < 1000
