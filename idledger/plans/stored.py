"""Queries that run the store, the streams and the file formats end to end, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, policies, workload
from ..operators import bloom, generations, history, samples
from ..options import HistoryOptions
from ..shared import shared_path
from ..sources import journal
from ..store import HistoryStore
from . import inputs
from .inputs import D, E
from .registry import BLOOM_BITS, FIRST, PRESSURE, _bloom, _pressure, query

SMALL = dict(shard_count=8, slots_per_shard=1 << 16, bloom_memory_budget_bytes=1 << 20)
SERVER = "11111111-2222-3333-4444-555555555555"


def _store(spark, **options) -> HistoryStore:
    return HistoryStore(spark, shared_path(spark, "store"), HistoryOptions(**{**SMALL, **options}))


def _rows(spark, d) -> DataFrame:
    """Events to add: every seventh has a server that is not a GUID, every eleventh a blank id."""
    e = inputs.events(spark, d)
    bad = F.when(F.col("seq") % 11 == 10, F.lit("  ")).otherwise(F.col("message_id"))
    return e.select("seq", bad.alias("message_id"), F.when(F.col("seq") % 7 == 6, F.lit("nope")).otherwise(F.lit(SERVER)).alias("server_id"))


VALID = f"SELECT * FROM ({E}) WHERE seq % 11 <> 10 AND seq % 7 <> 6"
PARTED = f"SELECT *, seq % 3 AS part FROM ({VALID})"


def _filled(spark, d, parts: int = 3, **options) -> HistoryStore:
    store, rows = _store(spark, **options), _rows(spark, d)
    for k in range(parts):
        store.add_batch(rows.where(F.col("seq") % parts == k), batch_id=f"part-{k}").count()
    return store


@query(f"SELECT DISTINCT hash_hi, hash_lo, (ulo % 8)::INTEGER AS shard_id FROM ({VALID})")
def store_entries(spark, d):
    """Three batches, opened anew: what is stored, and in which shard."""
    root = _filled(spark, d).catalog.root
    return HistoryStore(spark, root, HistoryOptions(**SMALL)).entries().select(*history.KEY, "shard_id")


@query(
    f"""WITH v AS ({PARTED}), f AS (SELECT *, row_number() OVER (PARTITION BY hash_hi, hash_lo ORDER BY part, seq) AS rn FROM v)
    SELECT e.seq, CASE WHEN f.seq IS NULL THEN 'invalid' WHEN f.rn = 1 THEN 'inserted' ELSE 'duplicate' END AS status FROM ({E}) e LEFT JOIN f ON f.seq = e.seq WHERE e.seq % 3 = 1"""
)
def store_add_status(spark, d):
    """The second of two batches; it is added again, which changes nothing."""
    store, rows = _store(spark), _rows(spark, d)
    store.add_batch(rows.where("seq % 3 = 0"), batch_id="first").count()
    second = rows.where("seq % 3 = 1")
    store.add_batch(second, batch_id="second").count()
    return store.add_batch(second, batch_id="second").select("seq", "status")


@query(f"SELECT seq, EXISTS (SELECT 1 FROM ({VALID}) v WHERE v.hash_hi = e.hash_hi AND v.hash_lo = e.hash_lo) AND event_type <> 'error' AS found FROM ({E}) e")
def store_lookup(spark, d):
    """Lookups after errors have expired, with the words of every batch stored; what they rule out is not compared."""
    store = _filled(spark, d, bloom_persist_mode="durability")
    events = inputs.events(spark, d)
    store.expire(events.where("event_type = 'error'"))
    return store.lookup(events.select("seq", "message_id")).select("seq", "found")


@query(
    f"""WITH f AS ({FIRST.replace("ORDER BY seq", "ORDER BY part, seq")} ({PARTED})), j AS (SELECT row_number() OVER (ORDER BY part, seq) - 1 AS pos, message_id, event_type FROM f WHERE rn = 1)
    SELECT pos, message_id FROM j WHERE pos >= 5 AND event_type <> 'error'"""
)
def store_walk(spark, d):
    """The journal of three batches from position 5 on, without expired ids."""
    store = _filled(spark, d)
    store.expire(inputs.events(spark, d).where("event_type = 'error'"))
    return store.walk(5).select("pos", "message_id")


@query(
    f"""WITH p AS ({PARTED}), a AS (SELECT DISTINCT hash_hi, hash_lo FROM p WHERE part = 0),
    b AS (SELECT DISTINCT hash_hi, hash_lo FROM p WHERE part = 1 EXCEPT SELECT * FROM a), c AS (SELECT DISTINCT hash_hi, hash_lo FROM p WHERE part = 2 EXCEPT SELECT * FROM b)
    SELECT 3 AS generation, hash_hi, hash_lo FROM c"""
)
def store_retention(spark, d):
    """Every batch closes its generation, and two generations are kept: ids of the first batch are new again in the third."""
    store = _filled(spark, d, max_retained_generations=2, proactive_rollover_queue_watermark_percent=1, queue_capacity_per_shard=100)
    store.vacuum()
    newest = max(b["generation"] for b in store.manifest.batches.values() if b["entries"])
    return store.entries().select(F.lit(newest).alias("generation"), *history.KEY)


@query(f"SELECT count(DISTINCT (hash_hi, hash_lo)) AS tombstones, count(DISTINCT (hash_hi, hash_lo)) AS first_time, 0::BIGINT AS again FROM ({E}) WHERE event_type = 'error'")
def store_expire(spark, d):
    store, gone = _store(spark), inputs.events(spark, d).where("event_type = 'error'")
    first, again = store.expire(gone), store.expire(gone)
    return store.expired().agg(F.count("*").alias("tombstones"), F.lit(first).cast("long").alias("first_time"), F.lit(again).cast("long").alias("again"))


@query(f"WITH n AS (SELECT ulo % 8 AS shard_id, count(DISTINCT (hash_hi, hash_lo)) AS n FROM ({VALID}) GROUP BY 1) SELECT shard_id::INTEGER AS shard_id, n AS used_slots, greatest(n - 12, 0) AS full_failures FROM n")
def store_failures(spark, d):
    """Shards of 16 slots, three quarters of which may be used: what each holds beyond that is a failure."""
    store = _store(spark, slots_per_shard=16, proactive_rollover_load_factor_percent=0)
    store.add_batch(_rows(spark, d), batch_id="all").count()
    first = store.manifest.batches["all"]
    used = generations.routing_counts(store.entries(), 8).withColumnRenamed("rows", "used_slots")
    assert first["generation"] == 1 and store.manifest.active_generation == 2
    return used.withColumn("full_failures", F.greatest(F.col("used_slots") - store.options.load_limit, F.lit(0)))


@query(f"SELECT 2 AS scrubs, 2 * least(256, count(DISTINCT (hash_hi, hash_lo))) AS sampled, 0 AS repeated, 0 AS misplaced, 0 AS missing, 0 AS bad_checksums, 0 AS repeated_keys FROM ({VALID})")
def store_scrub_log(spark, d):
    """Two scrubs of a store with words, its checksums and its audit."""
    store = _filled(spark, d, bloom_persist_mode="durability")
    store.scrub()
    store.scrub(seed=1)
    log = {k: int(v) for k, v in store.scrub_log().items() if k != "last"} | {"bad_checksums": len(store.verify()), "repeated_keys": store.audit().count()}
    names = ["scrubs", "sampled", "repeated", "misplaced", "missing", "bad_checksums", "repeated_keys"]
    return spark.createDataFrame([tuple(log[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"SELECT 1 AS generation, sum(n)::BIGINT AS used_slots, max(n) AS max_used_slots FROM (SELECT count(DISTINCT (hash_hi, hash_lo)) AS n FROM ({VALID}) GROUP BY ulo % 8)")
def store_snapshot(spark, d):
    """Totals after compaction of an open generation's batches and a change of settings."""
    store = _filled(spark, d)
    store.tune(slot_scrubber_samples_per_tick=10, bloom_persist_mode="durability")
    store.compact(1)
    return store.snapshot().select(F.col("active_generation").alias("generation"), "used_slots", "max_used_slots")


@query(f"SELECT count(DISTINCT (hash_hi, hash_lo)) AS stored, true AS has_bytes, 4::BIGINT AS versions FROM ({VALID})")
def store_footprint(spark, d):
    store = _filled(spark, d)
    return store.entries().agg(F.count("*").alias("stored")).withColumns({"has_bytes": F.lit(store.catalog.total_bytes() > 0), "versions": F.lit(store.sync() + 1).cast("long")})


# Filters.


def _mixed(u: str) -> str:
    wrap = "18446744073709551616::UHUGEINT"
    step = lambda x, shift, factor: f"((xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {wrap})::UBIGINT"
    a, b = ids.MIX_FACTORS
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {step('y', 27, b)} AS z FROM (SELECT {step('x', 30, a)} AS y FROM (SELECT {u} AS x))))"


def _positions(source: str, bits: int) -> str:
    """SQL: source with the bit positions of each key, one per row."""
    h = f"SELECT *, {_mixed('ulo')} % {bits} AS h1, ({_mixed(f'xor(uhi, {ids.GOLDEN}::UBIGINT)')} | 1) % {bits} AS h2 FROM ({source})"
    return f"SELECT *, ((h1::HUGEINT + i * h2::HUGEINT) % {bits})::BIGINT AS bit FROM (SELECT *, unnest(range({ids.BLOOM_HASHES})) AS i FROM ({h}))"


def _words(source: str, bits: int, by: str) -> str:
    word = "bit_or(CASE WHEN bit % 64 = 63 THEN -9223372036854775808 ELSE (1::BIGINT << (bit % 64)::INTEGER) END)"
    return f"SELECT {by}, (bit // 64)::INTEGER AS word_idx, {word} AS word FROM ({_positions(source, bits)}) GROUP BY ALL"


@query(f"SELECT seq, ({_mixed('ulo')} % 9007199254740992)::BIGINT AS mixed FROM ({E})")
def mixed_ids(spark, d):
    """The low 53 bits of the mixed low half of every key."""
    return inputs.events(spark, d).select("seq", ids.mix64(F.col("hash_lo")).bitwiseAND(F.lit((1 << 53) - 1)).alias("mixed"))


@query(f"SELECT seq, i::INTEGER AS i, bit FROM ({_positions(D, BLOOM_BITS)})")
def bloom_positions(spark, d):
    rows = inputs.documents(spark, d)
    return rows.select("seq", F.posexplode(ids.bloom_bits(F.col("hash_hi"), F.col("hash_lo"), BLOOM_BITS)).alias("i", "bit"))


BLOOM_WORDS = _words(f"SELECT *, (ulo % 4)::INTEGER AS shard_id FROM ({FIRST} ({D})) WHERE rn = 1", BLOOM_BITS, "shard_id")


@query(BLOOM_WORDS)
def bloom_words(spark, d):
    return _bloom(spark, d)[1]


@query(BLOOM_WORDS)
def bloom_sidecars(spark, d):
    """Words written as sidecar files, a file per shard, and read back."""
    folder = shared_path(spark, "sidecars")
    journal.write_sidecars(_bloom(spark, d)[1], folder, BLOOM_BITS).count()
    back = journal.read_sidecars(spark, folder).where("trusted and word <> 0")
    return back.select(F.regexp_extract("path", r"(\d+)\.blm$", 1).cast("int").alias("shard_id"), "word_idx", "word")


def _store_words(bits: int) -> str:
    return _words(f"SELECT DISTINCT hash_hi, hash_lo, uhi, ulo, 1 AS generation, (ulo % 8)::INTEGER AS shard_id FROM ({VALID})", bits, "generation, shard_id")


@query(_store_words(HistoryOptions(**SMALL).bloom_bits))
def store_words(spark, d):
    """The words that a store keeps: stored after each batch, merged, and complete when it closes."""
    store = _filled(spark, d, bloom_persist_mode="durability")
    store.persist_words()
    return store.words()


@query(f"SELECT DISTINCT hash_hi, hash_lo FROM ({E}) WHERE event_type = 'error'")
def expired_files(spark, d):
    """Tombstones written as files, a file per partition, and read back."""
    folder = shared_path(spark, "expired")
    gone = history.expire(inputs.events(spark, d).where("event_type = 'error'"))
    journal.write_expired(gone, folder).count()
    return journal.read_expired(spark, folder)


# Streams.


def _source(spark, d) -> tuple[str, str]:
    folder = shared_path(spark, "stream")
    for k in range(3):
        _rows(spark, d).where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    return folder, "seq long, message_id string, server_id string"


@query(f"SELECT DISTINCT hash_hi, hash_lo FROM ({VALID})")
def stream_ingest(spark, d):
    """Micro-batches into a store, and the same stream run again from its checkpoint."""
    from ..streaming.ingest import ingest

    folder, schema = _source(spark, d)
    store, checkpoint = _store(spark), shared_path(spark, "stream-checkpoint")
    for _ in range(2):
        ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), store, checkpoint, available_now=True, scrub=True).awaitTermination()
    return store.entries().select(*history.KEY)


@query(f"SELECT count(*) FILTER (WHERE rn = 1) AS inserted, count(*) FILTER (WHERE rn > 1) AS duplicate, (SELECT count(*) FROM ({E}) WHERE seq % 11 = 10 OR seq % 7 = 6) AS invalid FROM ({FIRST} ({VALID}))")
def stream_store_statuses(spark, d):
    """The status of every row of a stream that a store takes in, a part for each micro-batch."""
    from ..streaming.ingest import ingest

    folder, schema = _source(spark, d)
    out = shared_path(spark, "stream-statuses")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest(stream, _store(spark), shared_path(spark, "stream-checkpoint"), available_now=True, statuses=out).awaitTermination()
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    return spark.read.parquet(out).agg(of("inserted"), of("duplicate"), of("invalid"))


@query("SELECT true AS ids_are_close, count(DISTINCT event_type) AS groups, 0 AS far_percentiles FROM events")
def sketches_are_close(spark, d):
    """Distinct ids within 5 % of the exact number, and sketched percentiles within 1.2 % of their rank."""
    lines = inputs.lines(spark, d)
    near, exact = lines.agg(F.approx_count_distinct(F.struct(*history.KEY), 0.01), F.count_distinct(*history.KEY)).first()
    rows = inputs.read(spark, d, "events").select("event_type", samples.bounded("value").alias("value"))
    sketch = samples.percentiles(rows, ["event_type"], "value", exact=False)
    below = rows.join(sketch, "event_type").groupBy("event_type").agg(*(F.avg((F.col("value") <= F.col(p)).cast("double")).alias(p) for p in ("p50", "p95", "p99")))
    far = sum((F.abs(F.col(p) - x) > 0.002 + 1.0 / 100).cast("int") for p, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return below.agg(F.lit(abs(near - exact) <= 0.05 * exact).alias("ids_are_close"), F.count("*").alias("groups"), F.sum(far).cast("int").alias("far_percentiles"))


def _drained(stream: DataFrame, name: str) -> DataFrame:
    out = shared_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(stream.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@query(f"SELECT count(*) FILTER (WHERE rn = 1) AS inserted, count(*) FILTER (WHERE rn > 1) AS duplicate FROM ({FIRST} (SELECT * FROM ({E}) WHERE seq % 11 <> 10))")
def stream_statuses(spark, d):
    """Statuses of every row of a stream; which row of a key comes first depends on the micro-batches, how many do not."""
    from ..streaming.ingest import row_statuses

    folder, schema = _source(spark, d)
    stream = spark.readStream.schema(schema).parquet(folder).where("message_id <> '  '")
    return _drained(row_statuses(stream), "statuses").agg(F.count_if(F.col("status") == "inserted").alias("inserted"), F.count_if(F.col("status") == "duplicate").alias("duplicate"))


@query(f"SELECT DISTINCT hash_hi, hash_lo FROM ({E}) WHERE seq % 11 <> 10")
def stream_keep_first(spark, d):
    """Keep-first with a watermark longer than the stream: state of older keys would go."""
    from ..streaming.ingest import keep_first_stream

    folder, schema = _source(spark, d)
    stream = spark.readStream.schema(schema).parquet(folder).where("message_id <> '  '").withColumn("at", F.timestamp_seconds("seq"))
    return _drained(keep_first_stream(stream, "at", "3650 days"), "first").select(*history.KEY)


# Workloads.


@query("SELECT 'phased' AS mode, 1200 AS attempted, 600 AS inserted, 600 AS duplicate, 400 AS lookups, 400 AS found UNION ALL SELECT 'restart', 1200, 600, 600, 400, 400")
def harness_runs(spark, d):
    """A phased and a restart run: what they added, met again and found."""
    from .. import harness as h

    rows = []
    for mode in ("phased", "restart"):
        o = h.HarnessOptions(mode=mode, root=shared_path(spark, "harness"), add_count=600, lookup_count=400, batch_rows=600, shard_count=4, slots_per_shard=1 << 10)
        r = h.RUNS[mode](spark, o)
        rows.append((mode, *(int(r[k]) for k in ("attempted", "inserted", "duplicate", "lookups", "found"))))
    return spark.createDataFrame(rows, "mode string, attempted int, inserted int, duplicate int, lookups int, found int")


@query(
    """WITH g AS (SELECT i, 2 ** (3 + i % 5) AS shards, (2 ** (20 + i % 3))::BIGINT AS slots, 1 + i % 9 AS forks, 100000 * (1 + i % 7) AS queue FROM (SELECT unnest(range(40)) AS i)),
    b AS (SELECT i, shards::BIGINT AS shards, slots, greatest(2, forks) AS base, queue FROM g),
    t AS (SELECT i, shards, slots, base AS forks, queue FROM b UNION SELECT i, shards, slots, least(64, base * 2), queue FROM b UNION SELECT i, shards, slots, greatest(2, base // 2), queue FROM b
      UNION SELECT i, greatest(32, shards // 2), least(16777216, slots * 2), base, queue FROM b UNION SELECT i, least(255, shards * 2), greatest(1048576, slots // 2), base, queue FROM b
      UNION SELECT i, shards, slots, base, greatest(100000, queue // 2) FROM b UNION SELECT i, shards, slots, base, least(4000000, queue * 2) FROM b)
    SELECT i, shards, slots, forks, queue FROM t"""
)
def tuning_grid(spark, d):
    """The trials of 40 settings; repeated ones are left out."""
    rows = []
    for i in range(40):
        for t in workload.tuning_trials(2 ** (3 + i % 5), 2 ** (20 + i % 3), 1 + i % 9, 100_000 * (1 + i % 7)):
            rows.append((i, t["shards"], t["slots"], t["forks"], t["queue"]))
    return spark.createDataFrame(rows, "i long, shards long, slots long, forks long, queue long")


@query(
    """WITH g AS (SELECT i, 1 + i % 20 AS size, i % 4 AS weak, (i // 3) % 40 AS taken, 1 + (i // 7) % 40 AS lim, (i * 37) % 2000 AS pending, i % 10 = 0 AS slow FROM (SELECT unnest(range(3000)) AS i)),
    a AS (SELECT *, taken <= greatest(1, lim // 4) AS is_weak, taken >= lim AS is_full FROM g),
    b AS (SELECT *, CASE WHEN is_weak THEN weak + 1 ELSE 0 END AS w FROM a),
    c AS (SELECT *, CASE WHEN w >= 3 THEN greatest(1, size - 1) ELSE size END AS s, CASE WHEN w >= 3 THEN 0 ELSE w END AS w2 FROM b),
    e AS (SELECT *, s + CASE WHEN is_full AND pending >= 512 THEN CASE WHEN pending >= 1024 THEN 4 ELSE 2 END WHEN is_full AND pending < 256 AND NOT is_weak THEN 1 ELSE 0 END AS s2 FROM c)
    SELECT i, CASE WHEN slow THEN least(greatest(1, size - 2), 16) ELSE least(greatest(s2, 1), 16) END AS next_size, CASE WHEN slow THEN 0 ELSE w2 END AS next_weak FROM e"""
)
def burst_sizes(spark, d):
    """The size of the burst after one, in 3,000 situations."""
    rows = []
    for i in range(3000):
        got = policies.next_burst(policies.BurstState(1 + i % 20, i % 4), ceiling=16, taken=(i // 3) % 40, limit=1 + (i // 7) % 40, pending=(i * 37) % 2000, slow=i % 10 == 0, queue_capacity=8192)
        rows.append((i, got.size, got.weak))
    return spark.createDataFrame(rows, "i long, next_size long, next_weak long")


@query("SELECT i, least(greatest(i - 20, 1), 128) AS taken FROM (SELECT unnest(range(300)) AS i)")
def coalesce_clamps(spark, d):
    return spark.createDataFrame([(i, policies.clamp_batch(i - 20)) for i in range(300)], "i long, taken long")


@query("SELECT i, greatest(100, trunc(((1 + i % 5) * (2 ** (8 + i % 6)) * (50 + i % 40) / 100.0::DOUBLE) * (0.5::DOUBLE + (i % 3) * 0.25::DOUBLE) * (i % 4))::BIGINT) AS target FROM (SELECT unnest(range(200)) AS i)")
def generation_targets(spark, d):
    """Rows that fill a wished number of generations."""
    from ..harness import HarnessOptions, add_target

    rows = [(i, add_target(HarnessOptions(add_count=100, shard_count=1 + i % 5, slots_per_shard=2 ** (8 + i % 6), max_load_factor_percent=50 + i % 40, fill_factor=0.5 + (i % 3) * 0.25, target_generations=i % 4))) for i in range(200)]
    return spark.createDataFrame(rows, "i long, target long")


@query("SELECT event_id AS seq, epoch_us(ts) * 10 + 621355968000000000 AS ticks, epoch_us(ts) AS back FROM events")
def tick_conversion(spark, d):
    rows = inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.timestamp_micros(inputs.epoch_us("ts")).alias("at"))
    ticks = ids.timestamp_to_ticks(F.col("at"))
    return rows.select("seq", ticks.alias("ticks"), F.unix_micros(ids.ticks_to_timestamp(ticks)).alias("back"))


@query("SELECT event_id AS seq, event_id % 5 <> 3 AS is_blank FROM events")
def blank_checks(spark, d):
    """Null, empty, spaces, an id, and a mixture of other white space."""
    text = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("   "), F.lit(" x "), F.lit("\t\r\n\u00a0\u2003\u3000")), (F.col("event_id") % 5 + 1).cast("int"))
    return inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), ids.is_blank(text).alias("is_blank"))


@query("SELECT i, CASE WHEN i = 0 THEN 0 ELSE i * 281474976710656 END AS hash_hi, CASE WHEN i = 0 THEN 1 ELSE 0 END AS hash_lo FROM (SELECT unnest(range(100)) AS i)")
def zero_hash(spark, d):
    """Digests in hex: all zero becomes (0, 1), others stay as they are."""
    digest = F.concat(F.repeat(F.lit("0"), F.lit(12)), F.lower(F.lpad(F.hex("id"), 2, "0")), F.repeat(F.lit("0"), F.lit(18)))
    hi, lo = ids.halves_of(digest)
    return spark.range(100).select(F.col("id").alias("i"), hi.alias("hash_hi"), lo.alias("hash_lo"))


@query(f"SELECT shard_id, full_failures, pending FROM ({PRESSURE}) WHERE full_failures > 0")
def shard_failure_counts(spark, d):
    return _pressure(spark, d).where("full_failures > 0").select("shard_id", "full_failures", "pending")


@query(f"SELECT sum(full_failures)::BIGINT AS failures, sum(full_failures) >= 100 AS over_threshold FROM ({PRESSURE})")
def failure_threshold(spark, d):
    total = F.sum("full_failures")
    return _pressure(spark, d).agg(total.alias("failures"), (total >= 100).alias("over_threshold"))


@query(f"SELECT greatest(count(*) - 100, 0) AS evicted FROM (SELECT DISTINCT hash_hi, hash_lo FROM ({VALID}))")
def store_evicted(spark, d):
    store = _filled(spark, d, parts=1, max_walk_entries=100)
    return spark.createDataFrame([(store.evicted_walk_entries,)], "evicted long")


@query(f"SELECT seq, (ulo % 8)::INTEGER AS shard_id, row_number() OVER (PARTITION BY ulo % 8 ORDER BY seq) AS place FROM ({E})")
def shard_sorted(spark, d):
    """Rows grouped by shard, in order within each."""
    from pyspark.sql import Window

    return generations.routed(inputs.events(spark, d), 8).select("seq", "shard_id", F.row_number().over(Window.partitionBy("shard_id").orderBy("seq")).alias("place"))


@query(f"WITH w AS ({_words(f'SELECT *, 0 AS shard_id FROM ({D}) WHERE seq % 2 = 0', BLOOM_BITS, 'shard_id')}), p AS ({_positions(f'SELECT * FROM ({D})', BLOOM_BITS)}) SELECT seq, bool_and(coalesce(((w.word >> (bit % 64)::INTEGER) & 1) <> 0, false)) AS may_contain FROM p LEFT JOIN w ON w.word_idx = p.bit // 64 GROUP BY 1")
def bloom_answers(spark, d):
    """Every document's answer from a filter of the even ones, false positives included."""
    rows = inputs.documents(spark, d).withColumn("shard_id", F.lit(0))
    return bloom.may_contain(rows, bloom.build(rows.where("seq % 2 = 0"), BLOOM_BITS), BLOOM_BITS)
