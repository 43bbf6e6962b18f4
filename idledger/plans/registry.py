"""All queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, policies, workload
from ..operators import bloom, capacity, generations, history, samples, walk
from ..sources import journal
from . import inputs
from .inputs import OPS, D, E, L, O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 128
BATCH_ROWS = 500


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


FIRST = "SELECT *, row_number() OVER (PARTITION BY hash_hi, hash_lo ORDER BY seq) AS rn FROM"


@query(f"SELECT seq, hash_hi, hash_lo FROM ({E})")
def hash_ids(spark, d):
    return inputs.events(spark, d).select("seq", "hash_hi", "hash_lo")


@query(f"SELECT (ulo % {SHARDS})::INTEGER AS shard_id, count(*) AS rows FROM ({L}) GROUP BY 1")
def shard_routing_counts(spark, d):
    return generations.routing_counts(inputs.lines(spark, d), SHARDS)


@query(f"SELECT (ulo % 100)::INTEGER AS shard_id, count(*) AS rows FROM ({L}) GROUP BY 1")
def shard_routing_any_count(spark, d):
    return generations.routing_counts(inputs.lines(spark, d), 100)


@query(f"SELECT seq, hash_hi, hash_lo FROM ({FIRST} ({D})) WHERE rn = 1")
def add_keep_first(spark, d):
    return history.keep_first(inputs.documents(spark, d)).select("seq", "hash_hi", "hash_lo")


@query(f"SELECT seq, CASE WHEN rn = 1 THEN 'inserted' ELSE 'duplicate' END AS status FROM ({FIRST} ({E}))")
def add_status(spark, d):
    return history.add_status(inputs.events(spark, d)).select("seq", "status")


@query(
    f"""WITH e AS ({E}), m AS (SELECT max(seq) // 2 AS m FROM e), a AS (SELECT * FROM e WHERE seq <= (SELECT m FROM m)),
    b AS ({FIRST} (SELECT * FROM e WHERE seq > (SELECT m FROM m)))
    SELECT seq, CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.hash_hi = b.hash_hi AND a.hash_lo = b.hash_lo) THEN 'inserted' ELSE 'duplicate' END AS status FROM b"""
)
def add_status_two_batches(spark, d):
    e = inputs.events(spark, d)
    middle = e.agg(F.max("seq")).first()[0] // 2
    stored = history.keep_first(e.where(F.col("seq") <= middle))
    return history.add_status(e.where(F.col("seq") > middle), stored).select("seq", "status")


@query(f"WITH d AS ({D}) SELECT seq, hash_hi, hash_lo FROM ({FIRST} (SELECT * FROM d WHERE seq % 2 = 1)) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM d y WHERE y.seq % 2 = 0 AND y.hash_hi = x.hash_hi AND y.hash_lo = x.hash_lo)")
def add_new_only(spark, d):
    docs = inputs.documents(spark, d)
    return history.new_only(docs.where("seq % 2 = 1"), docs.where("seq % 2 = 0")).select("seq", "hash_hi", "hash_lo")


@query(f"WITH l AS ({L}) SELECT seq, message_id FROM ({O}) o WHERE EXISTS (SELECT 1 FROM l WHERE l.hash_hi = o.hash_hi AND l.hash_lo = o.hash_lo)")
def lookup_hits(spark, d):
    return history.hits(inputs.probes(spark, d), inputs.lines(spark, d)).select("seq", "message_id")


@query(f"WITH l AS ({L}) SELECT seq, EXISTS (SELECT 1 FROM l WHERE l.hash_hi = o.hash_hi AND l.hash_lo = o.hash_lo) AS found FROM ({O}) o")
def lookup_status(spark, d):
    return history.lookup(inputs.probes(spark, d), inputs.lines(spark, d)).select("seq", "found")


@query(f"SELECT count(*) AS expired FROM (SELECT DISTINCT hash_hi, hash_lo FROM ({E}) WHERE event_type = 'error')")
def expire_new_count(spark, d):
    return history.expire(inputs.events(spark, d).where("event_type = 'error'")).agg(F.count("*").alias("expired"))


@query(f"SELECT DISTINCT hash_hi, hash_lo FROM ({E}) WHERE event_type IN ('error', 'click')")
def expired_distinct(spark, d):
    e = inputs.events(spark, d)
    first = history.expire(e.where("event_type = 'error'"))
    return first.unionByName(history.expire(e.where("event_type in ('error', 'click')"), first))


@query(f"WITH e AS ({E}), x AS (SELECT hash_hi, hash_lo FROM e WHERE event_type = 'error' OR user_id % 3 = 0) SELECT seq, NOT EXISTS (SELECT 1 FROM x WHERE x.hash_hi = e.hash_hi AND x.hash_lo = e.hash_lo) AS found FROM e")
def lookup_after_expire(spark, d):
    e = inputs.events(spark, d)
    gone = history.expire(e.where("event_type = 'error' or user_id % 3 = 0"))
    return history.lookup(e, history.keep_first(e), gone).select("seq", "found")


@query(f"WITH e AS ({E}), x AS (SELECT DISTINCT hash_hi, hash_lo FROM e WHERE event_type = 'error'), y AS (SELECT DISTINCT hash_hi, hash_lo FROM e WHERE event_type = 'error' AND user_id % 2 = 0) SELECT hash_hi, hash_lo FROM x EXCEPT SELECT hash_hi, hash_lo FROM y")
def expired_after_insert(spark, d):
    e = inputs.events(spark, d).where("event_type = 'error'")
    return history.clear_expired(history.expire(e), history.keep_first(e.where("user_id % 2 = 0")))


@query(
    f"""WITH a AS (SELECT seq, hash_hi, hash_lo, op, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY hash_hi, hash_lo) fa FROM (SELECT seq, op, user_id % 20 AS k, user_id % 20 AS hash_hi, 0 AS hash_lo FROM ({OPS}))),
    b AS (SELECT *, max(CASE WHEN op = 'expire' THEN seq END) OVER (PARTITION BY hash_hi, hash_lo ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM a)
    SELECT seq, op, CASE WHEN op = 'add' THEN CASE WHEN seq = fa THEN 'inserted' ELSE 'duplicate' END
      WHEN op = 'expire' THEN CASE WHEN pe IS NULL OR (fa < seq AND pe < fa) THEN 'expired' ELSE 'noop' END
      ELSE CASE WHEN fa < seq AND (pe IS NULL OR pe < fa) THEN 'hit' ELSE 'miss' END END AS result FROM b"""
)
def oplog_replay(spark, d):
    """Adds, expires and lookups of 20 shared keys, interleaved."""
    o = inputs.ops(spark, d).withColumns({"hash_hi": F.col("user_id") % 20, "hash_lo": F.lit(0)})
    return history.replay(o).select("seq", "op", "result")


JOURNAL = f"SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, seq, message_id, hash_hi, hash_lo FROM ({FIRST} ({E})) WHERE rn = 1"
GONE = f"SELECT hash_hi, hash_lo FROM ({E}) WHERE event_type = 'error' AND user_id % 2 = 0"


def _journal(spark, d):
    return walk.with_positions(history.keep_first(inputs.events(spark, d)))


def _gone(spark, d):
    return history.expire(inputs.events(spark, d).where("event_type = 'error' and user_id % 2 = 0"))


@query(f"WITH x AS ({GONE}) SELECT pos, message_id FROM ({JOURNAL}) j WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.hash_hi = j.hash_hi AND x.hash_lo = j.hash_lo)")
def walk_full(spark, d):
    return walk.walk(_journal(spark, d), _gone(spark, d)).select("pos", "message_id")


@query(f"WITH x AS ({GONE}) SELECT pos, message_id FROM ({JOURNAL}) j WHERE pos >= 20 AND NOT EXISTS (SELECT 1 FROM x WHERE x.hash_hi = j.hash_hi AND x.hash_lo = j.hash_lo) ORDER BY pos LIMIT 25")
def walk_page(spark, d):
    """A page of 25 from position 5, which the window has moved up to 20."""
    return walk.walk(_journal(spark, d), _gone(spark, d), position=5, limit=25, evicted=20).select("pos", "message_id")


@query(f"SELECT pos, message_id FROM ({JOURNAL}) WHERE pos > (SELECT max(pos) FROM ({JOURNAL})) - 100")
def walk_eviction_window(spark, d):
    return walk.window(_journal(spark, d), 100).select("pos", "message_id")


PAGE_ENTRIES = inputs.with_key("SELECT page_id, url AS message_id, 'srv-' || page_id AS server_id, 638396640000000000 + page_id * 10000000 AS ticks FROM pages", "message_id")
LINE = "to_base64(message_id::BLOB) || '|' || to_base64(server_id::BLOB) || '|' || ticks || '|' || uhi || '|' || ulo"


def _entries(spark, d):
    rows = inputs.read(spark, d, "pages").select("page_id", F.col("url").alias("message_id"), F.concat(F.lit("srv-"), F.col("page_id").cast("string")).alias("server_id"), F.timestamp_micros((F.lit(638396640000000000 - ids.EPOCH_TICKS) / 10).cast("long") + F.col("page_id") * 1_000_000).alias("created_at"))
    return history.keyed(rows, "message_id")


def _lines(spark, d):
    """Journal lines, some in the old form and some damaged in each way."""
    line = F.col("value")
    f = F.split(line, "[|]")
    some = (
        F.when(F.col("page_id") % 7 == 1, F.concat_ws("|", *(F.get(f, F.lit(i)) for i in range(4))))
        .when(F.col("page_id") % 7 == 2, F.concat_ws("|", *(F.get(f, F.lit(i)) for i in range(3))))
        .when(F.col("page_id") % 7 == 3, F.concat(F.lit("!"), line))
        .when(F.col("page_id") % 7 == 4, F.concat_ws("|", F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.lit("x1"), F.get(f, F.lit(3)), F.get(f, F.lit(4))))
        .otherwise(line)
    )
    return journal.encode_lines(_entries(spark, d)).select("page_id", some.alias("value"))


@query(f"SELECT page_id, {LINE} AS value FROM ({PAGE_ENTRIES})")
def journal_encode(spark, d):
    return journal.encode_lines(_entries(spark, d)).select("page_id", "value")


@query(f"SELECT page_id, page_id % 7 NOT IN (1, 3, 4) AS is_valid, CASE WHEN page_id % 7 NOT IN (1, 3, 4) THEN message_id END AS message_id, CASE WHEN page_id % 7 NOT IN (1, 3, 4) THEN server_id END AS server_id, CASE WHEN page_id % 7 NOT IN (1, 3, 4) THEN (ticks - 621355968000000000) // 10 END AS created_us, CASE WHEN page_id % 7 NOT IN (1, 3, 4) THEN hash_hi END AS hash_hi, CASE WHEN page_id % 7 NOT IN (1, 3, 4) THEN hash_lo END AS hash_lo FROM ({PAGE_ENTRIES})")
def journal_decode(spark, d):
    rows = journal.decode_lines(_lines(spark, d))
    return rows.select("page_id", "is_valid", "message_id", "server_id", F.unix_micros("created_at").alias("created_us"), "hash_hi", "hash_lo")


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE page_id % 7 IN (1, 3, 4)) AS invalid FROM pages")
def journal_invalid_count(spark, d):
    return journal.invalid_count(journal.decode_lines(_lines(spark, d)))


GEN_SHARDS, GEN_THRESHOLD, GEN_KEPT = 8, 20, 2
BATCHED = f"SELECT *, (seq // {BATCH_ROWS})::BIGINT AS batch, (ulo % {GEN_SHARDS})::INTEGER AS shard_id FROM ({FIRST} ({E})) WHERE rn = 1"
GENERATIONS = f"""WITH RECURSIVE i AS ({BATCHED}), n AS (SELECT batch, shard_id, count(*) AS n FROM i GROUP BY ALL),
    c AS (SELECT b.batch, s.shard_id, coalesce((SELECT sum(n) FROM n WHERE n.shard_id = s.shard_id AND n.batch <= b.batch), 0) AS c
      FROM (SELECT unnest(range(-1, (SELECT max(batch) FROM i) + 1)) AS batch) b, (SELECT unnest(range({GEN_SHARDS})) AS shard_id) s),
    m AS (SELECT a.batch AS since, b.batch, max(b.c - a.c) AS used FROM c a JOIN c b ON a.shard_id = b.shard_id AND a.batch < b.batch GROUP BY ALL),
    g AS (SELECT 0::BIGINT AS batch, 1 AS generation, (-1)::BIGINT AS since
      UNION ALL SELECT g.batch + 1, CASE WHEN m.used >= {GEN_THRESHOLD} THEN g.generation + 1 ELSE g.generation END, CASE WHEN m.used >= {GEN_THRESHOLD} THEN g.batch ELSE g.since END
      FROM g JOIN m ON m.since = g.since AND m.batch = g.batch WHERE g.batch < (SELECT max(batch) FROM i))"""


def _batched(spark, d):
    rows = generations.routed(history.keep_first(inputs.events(spark, d)), GEN_SHARDS)
    return rows.withColumn("batch", F.floor(F.col("seq") / BATCH_ROWS).cast("long"))


@query(f"{GENERATIONS} SELECT batch, generation FROM g")
def generation_assignment(spark, d):
    return generations.generations_of(_batched(spark, d), shards=GEN_SHARDS, threshold=GEN_THRESHOLD)


@query(f"{GENERATIONS} SELECT i.seq, g.generation FROM i JOIN g ON i.batch = g.batch WHERE g.generation > (SELECT max(generation) FROM g) - {GEN_KEPT}")
def retention_visible(spark, d):
    rows = _batched(spark, d)
    entries = rows.join(generations.generations_of(rows, shards=GEN_SHARDS, threshold=GEN_THRESHOLD), "batch")
    return generations.retained(entries, GEN_KEPT).select("seq", "generation")


@query(f"{GENERATIONS} SELECT g.generation, count(*) AS entries, (SELECT max(generation) FROM g) - g.generation AS age FROM i JOIN g ON i.batch = g.batch GROUP BY 1")
def generations_newest_first(spark, d):
    rows = _batched(spark, d)
    entries = rows.join(generations.generations_of(rows, shards=GEN_SHARDS, threshold=GEN_THRESHOLD), "batch")
    return generations.listing(entries)


@query(f"{GENERATIONS} SELECT i.seq FROM i JOIN g ON i.batch = g.batch WHERE g.generation <= 2")
def generations_up_to(spark, d):
    rows = _batched(spark, d)
    entries = rows.join(generations.generations_of(rows, shards=GEN_SHARDS, threshold=GEN_THRESHOLD), "batch")
    return generations.up_to(entries, 2).select("seq")


@query(f"SELECT (ulo % {SHARDS})::INTEGER AS shard_id, count(*) AS entries, bit_xor(xor(hash_hi, hash_lo)) AS checksum FROM (SELECT DISTINCT hash_hi, hash_lo, ulo FROM ({L})) GROUP BY 1")
def shard_checksums(spark, d):
    return generations.checksums(inputs.lines(spark, d).select("hash_hi", "hash_lo").distinct(), SHARDS)


PRESSURE = f"SELECT s.shard_id::INTEGER AS shard_id, coalesce(u.n, 0) AS used_slots, CASE WHEN s.shard_id % 5 = 0 THEN s.shard_id ELSE 0 END AS full_failures, greatest(0, least(2147483647, (s.shard_id - 3) * 1000)) AS pending FROM (SELECT unnest(range({SHARDS})) AS shard_id) s LEFT JOIN (SELECT ulo % {SHARDS} AS shard_id, count(*) AS n FROM (SELECT DISTINCT uhi, ulo FROM ({L})) GROUP BY 1) u ON u.shard_id = s.shard_id"


def _pressure(spark, d):
    stored = inputs.lines(spark, d).select("hash_hi", "hash_lo").distinct()
    failures = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard_id"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.lit(0)).alias("full_failures"), ((F.col("id") - 3) * 1000).alias("pending"))
    return generations.shard_pressure(stored, SHARDS, failures=failures)


@query(PRESSURE)
def shard_pressure(spark, d):
    return _pressure(spark, d)


@query(f"SELECT shard_id, full_failures + used_slots AS score FROM ({PRESSURE}) ORDER BY score DESC, shard_id LIMIT 1")
def hottest_shard(spark, d):
    return generations.hottest_shard(_pressure(spark, d), F.col("full_failures") + F.col("used_slots"))


@query(f"SELECT 1 AS active_generation, sum(used_slots)::BIGINT AS used_slots, sum(full_failures)::BIGINT AS full_failures, sum(pending)::BIGINT AS pending, max(used_slots) AS max_used_slots FROM ({PRESSURE})")
def performance_snapshot(spark, d):
    return generations.snapshot(_pressure(spark, d))


@query("WITH c AS (SELECT event_id AS seq, user_id, (event_id * 7919) % 1000 AS counter FROM events) SELECT seq, greatest(counter - lag(counter, 1, 0) OVER (PARTITION BY user_id ORDER BY seq), 0) AS delta FROM c")
def correlation_deltas(spark, d):
    rows = inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", (F.col("event_id") * 7919 % 1000).alias("counter"))
    return samples.deltas(rows, ["user_id"], "counter", "seq").select("seq", F.col("delta").cast("long").alias("delta"))


@query("SELECT event_id AS seq, user_id FROM events ORDER BY ts DESC LIMIT 8")
def correlation_tail(spark, d):
    return samples.tail(inputs.read(spark, d, "events"), "ts").select(F.col("event_id").alias("seq"), "user_id")


@query("WITH r AS (SELECT event_id AS seq, row_number() OVER (ORDER BY ts) a, row_number() OVER (ORDER BY ts DESC) b FROM events) SELECT seq FROM r WHERE a <= 12 OR b <= 20")
def timeline_ends(spark, d):
    return samples.head_and_tail(inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), "ts"), "ts").select("seq")


CLIPPED = "greatest(1.0, least(1e9, value))"


@query(f"SELECT event_type, quantile_disc({CLIPPED}, 0.5)::DOUBLE AS p50, quantile_disc({CLIPPED}, 0.95)::DOUBLE AS p95, quantile_disc({CLIPPED}, 0.99)::DOUBLE AS p99, max({CLIPPED})::DOUBLE AS max FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    rows = inputs.read(spark, d, "events").select("event_type", samples.bounded("value").alias("value"))
    return samples.percentiles(rows, ["event_type"], "value")


@query()
def latency_percentiles_sketch(spark, d):
    rows = inputs.read(spark, d, "events").select("event_type", samples.bounded("value").alias("value"))
    return samples.percentiles(rows, ["event_type"], "value", exact=False)


SLO = 120.0


@query(
    f"""WITH e AS (SELECT event_id // {BATCH_ROWS} AS batch, value, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000 AS ms FROM events),
    b AS (SELECT batch, quantile_disc(value, 0.5)::DOUBLE AS p50, quantile_disc(value, 0.99)::DOUBLE AS p99, max(ms) AS elapsed_ms FROM e GROUP BY 1)
    SELECT *, coalesce(batch = (SELECT min(batch) FROM b WHERE p99 <= {SLO}), false) AS first_steady FROM b"""
)
def restart_warmup_timeline(spark, d):
    e = inputs.read(spark, d, "events").select(F.floor(F.col("event_id") / BATCH_ROWS).cast("long").alias("batch"), "value", inputs.epoch_us("ts").alias("us"))
    start = e.agg(F.min("us")).first()[0]
    rows = e.withColumn("ms", F.floor((F.col("us") - F.lit(start)) / 1000).cast("long"))
    return samples.warmup_timeline(rows, "batch", "value", "ms", SLO)


COUNTED = f"WITH e AS ({OPS}), r AS (SELECT *, row_number() OVER (PARTITION BY hash_hi, hash_lo, op ORDER BY seq) AS rn FROM e)"


@query(f"{COUNTED} SELECT op, count(*) AS attempted, count(*) FILTER (WHERE rn = 1) AS ok, count(*) FILTER (WHERE rn > 1) AS repeated FROM r GROUP BY 1")
def op_counters(spark, d):
    o = inputs.ops(spark, d)
    firsts = o.groupBy("op", *history.KEY).agg(F.count("*").alias("n"))
    return firsts.groupBy("op").agg(F.sum("n").alias("attempted"), F.count("*").alias("ok"), F.sum(F.col("n") - 1).alias("repeated"))


@query(f"WITH e AS ({OPS}) SELECT op, count(*) AS n, (max(ts_us) - min(ts_us)) // 1000 AS elapsed_ms, CASE WHEN (max(ts_us) - min(ts_us)) // 1000 > 0 THEN count(*) * 1000.0::DOUBLE / ((max(ts_us) - min(ts_us)) // 1000) ELSE 0.0 END::DOUBLE AS per_second FROM e GROUP BY 1")
def throughput_rates(spark, d):
    got = inputs.ops(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.floor((F.max("ts_us") - F.min("ts_us")) / 1000).cast("long").alias("elapsed_ms"))
    return got.withColumn("per_second", workload.rate(F.col("n"), F.col("elapsed_ms")))


TRIALS = f"SELECT user_id AS trial, quantile_disc(value, 0.99)::DOUBLE AS insert_p99, quantile_disc(value, 0.5)::DOUBLE AS queue_p99, quantile_disc(value, 0.2)::DOUBLE AS writer_p99, quantile_disc(value, 0.01)::DOUBLE AS depth_p99, count(*) AS pending, count(*) FILTER (WHERE event_type = 'error') AS failed FROM ({E}) GROUP BY 1"


def _trials(spark, d):
    pick = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)").cast("double")
    return inputs.read(spark, d, "events").groupBy(F.col("user_id").alias("trial")).agg(
        pick(0.99).alias("insert_p99"), pick(0.5).alias("queue_p99"), pick(0.2).alias("writer_p99"), pick(0.01).alias("depth_p99"),
        F.count("*").alias("pending"), F.count_if(F.col("event_type") == "error").alias("failed"),
    )


@query(
    f"""SELECT trial, CASE WHEN pending >= 85 THEN 'Saturated' WHEN insert_p99 >= 250 THEN 'Degraded' WHEN queue_p99 > writer_p99 * 2.0 AND depth_p99 < 1.0 THEN 'Scheduler-bound'
    WHEN queue_p99 > writer_p99 * 2.0 THEN 'Queue-bound' WHEN writer_p99 > queue_p99 * 2.0 THEN 'Engine-bound' ELSE 'Healthy' END AS verdict FROM ({TRIALS})"""
)
def verdicts(spark, d):
    c = F.col
    return _trials(spark, d).select("trial", workload.verdict(c("insert_p99"), c("queue_p99"), c("writer_p99"), c("depth_p99"), c("pending"), saturation=85, degraded_us=250.0).alias("verdict"))


@query(
    f"""SELECT trial, CASE WHEN queue_p99 > writer_p99 * 2.0 AND depth_p99 < 1.0 THEN 'waiting dominates though the queue is short: hand-off overhead'
    WHEN queue_p99 > writer_p99 * 2.0 THEN 'waiting in the queue dominates' WHEN writer_p99 > queue_p99 * 2.0 THEN 'writing dominates' ELSE 'waiting and writing are balanced' END AS meaning FROM ({TRIALS})"""
)
def interpretations(spark, d):
    return _trials(spark, d).select("trial", workload.interpretation(F.col("queue_p99"), F.col("writer_p99"), F.col("depth_p99")).alias("meaning"))


SCORED = f"SELECT trial, round(pending / greatest(1e-9, 500 / 1000.0) + pending / greatest(1e-9, 500 / 1000.0) * 0.35 - insert_p99 * 20.0 - queue_p99 * 12.0 - (failed::DOUBLE / pending) * 1000000.0, 3) AS score FROM ({TRIALS})"


def _scores(spark, d):
    c = F.col
    return _trials(spark, d).select("trial", F.round(workload.trial_score(c("pending"), c("pending"), F.lit(500), c("insert_p99"), c("queue_p99"), c("failed"), c("pending")), 3).alias("score"))


@query(SCORED)
def autotune_scores(spark, d):
    return _scores(spark, d)


@query(f"SELECT trial, score FROM ({SCORED}) ORDER BY score DESC, trial LIMIT 1")
def autotune_best(spark, d):
    return _scores(spark, d).orderBy(F.desc("score"), "trial").limit(1)


CONFIGS = "SELECT i, (1::BIGINT << (10 + i % 15)::INTEGER) AS slots, 50 + i % 45 AS load, 4.0 + i % 29 AS bits, (i * 1000003 + 1024) AS budget, 1 + i % 200 AS shards, i % 9 AS gens FROM (SELECT unnest(range(500)) AS i)"


def _configs(spark):
    i = F.col("id")
    return spark.range(500).select(
        i.alias("i"), F.expr("shiftleft(1L, cast(10 + id % 15 as int))").alias("slots"), (50 + i % 45).alias("load"), (F.lit(4.0) + i % 29).alias("bits"),
        (i * 1000003 + 1024).alias("budget"), (1 + i % 200).alias("shards"), (i % 9).alias("gens"),
    )


@query(
    f"""SELECT i, target, budget_bits, desired, (1::BIGINT << (length(bin(desired)) - 1)::INTEGER) AS final_bits FROM (
    SELECT *, greatest(least(target, budget_bits), 4096)::BIGINT AS desired FROM (
    SELECT i, ceil(slots * (load / 100.0::DOUBLE) * bits::DOUBLE)::BIGINT AS target, (budget * 8) // (shards * greatest(1, gens)) AS budget_bits FROM ({CONFIGS})))"""
)
def bloom_sizing(spark, d):
    c = F.col
    rows = _configs(spark).select("i", policies.bloom_target_bits_col(c("slots"), c("load"), c("bits")).alias("target"), policies.bloom_budget_bits_col(c("budget"), c("shards"), c("gens")).alias("budget_bits"))
    rows = rows.withColumn("desired", policies.bloom_desired_bits_col(c("target"), c("budget_bits"), F.lit(4096).cast("long")))
    return rows.withColumn("final_bits", policies.round_down_power_of_two_col(c("desired")))


@query(
    f"""SELECT i, used_at, depth_at, used_at <> 0 AND i * 40 >= used_at AS rolls_on_used, depth_at > 0 AND gens * 11 >= depth_at AS rolls_on_queue FROM (
    SELECT *, CASE WHEN i % 4 = 0 THEN 0 ELSE (slots * (load - 10)) // 100 END AS used_at, CASE WHEN i % 5 = 0 THEN 0 ELSE greatest(1, (shards * (i % 100)) // 100) END::INTEGER AS depth_at FROM ({CONFIGS}) WHERE i % 100 <> 0 OR i % 5 = 0)"""
)
def rollover_policy(spark, d):
    c = F.col
    rows = _configs(spark)
    rows = rows.withColumn("used_at", policies.used_slots_threshold_col(c("slots"), F.when(c("i") % 4 == 0, 0).otherwise(c("load") - 10)))
    rows = rows.withColumn("depth_at", policies.queue_depth_threshold_col(c("shards"), F.when(c("i") % 5 == 0, 0).otherwise(c("i") % 100)))
    return rows.select("i", "used_at", "depth_at", policies.rolls_on_used_col(c("i") * 40, c("used_at")).alias("rolls_on_used"), policies.rolls_on_queue_col(c("gens") * 11, c("depth_at")).alias("rolls_on_queue"))


@query("SELECT i, x, x > 0 AND (x & (x - 1)) = 0 AS is_pow2, CASE WHEN x <= 1 THEN 1 ELSE (1::BIGINT << (length(bin(x)) - 1)::INTEGER) END AS pow2_down FROM (SELECT i, (i * i * i)::BIGINT AS x FROM (SELECT unnest(range(2050)) AS i))")
def pow2_checks(spark, d):
    rows = spark.range(2050).select(F.col("id").alias("i"), (F.col("id") * F.col("id") * F.col("id")).alias("x"))
    return rows.select("i", "x", policies.is_power_of_two_col(F.col("x")).alias("is_pow2"), policies.round_down_power_of_two_col(F.col("x")).alias("pow2_down"))


@query("SELECT i, CASE WHEN i * 1049 <= 1048575 THEN lpad(lower(to_hex(i * 1049)), 5, '0') END AS generation, CASE WHEN i * 67 <= 65535 THEN lpad(lower(to_hex(i * 67)), 4, '0') END AS shard FROM (SELECT unnest(range(1100)) AS i)")
def path_tokens(spark, d):
    i = F.col("id")
    return spark.range(1100).select(i.alias("i"), ids.generation_token(i * 1049).alias("generation"), ids.shard_token(i * 67).alias("shard"))


@query(capacity.ORACLE)
def capacity_plan(spark, d):
    return capacity.plan(capacity.grid(spark))


SCRAMBLED = "((i::HUGEINT * 11400714819323198485) % 18446744073709551616)::UBIGINT"


@query(f"SELECT i, '<' || lpad(lower(to_hex(i::UBIGINT)), 16, '0') || '.' || lpad(lower(to_hex({SCRAMBLED})), 16, '0') || '@idledger.local>' AS message_id FROM (SELECT unnest(range(20000)) AS i)")
def gen_message_ids(spark, d):
    return spark.range(20000).select(F.col("id").alias("i"), ids.generated_message_id(F.col("id")).alias("message_id"))


@query(
    """SELECT i, substr(h, 9, 8) || '-' || substr(h, 5, 4) || '-' || substr(h, 1, 4) || '-' || substr(x, 15, 2) || substr(x, 13, 2) || '-' || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS server_id
    FROM (SELECT i, lpad(lower(to_hex(i::UBIGINT)), 16, '0') AS h, lpad(lower(to_hex(xor(i::UBIGINT, 11400714819323198485::UBIGINT))), 16, '0') AS x FROM (SELECT unnest(range(20000)) AS i))"""
)
def gen_server_ids(spark, d):
    return spark.range(20000).select(F.col("id").alias("i"), ids.generated_server_id(F.col("id")).alias("server_id"))


@query("SELECT count(*) AS attempts, count(DISTINCT i % 3000) AS inserted, count(*) - count(DISTINCT i % 3000) AS duplicates FROM (SELECT unnest(range(20000)) AS i)")
def dataset_clamp_dups(spark, d):
    rows = history.keyed(spark.range(20000).select(F.col("id").alias("seq"), ids.generated_message_id(ids.clamp_index(F.col("id"), 3000)).alias("message_id")), "message_id")
    got = history.add_status(rows)
    return got.agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "inserted").alias("inserted"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))


def _unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::UBIGINT::DOUBLE / {float(1 << 48)!r}::DOUBLE)"


@query(f"SELECT seq, CASE WHEN {_unit_sql('seq', chr(39) + 'u' + chr(39))} < 0.8 THEN floor({_unit_sql('seq', chr(39) + 'v' + chr(39))} * 1000 / 5) ELSE floor({_unit_sql('seq', chr(39) + 'v' + chr(39))} * 1000) END::BIGINT AS picked FROM (SELECT event_id AS seq FROM events)")
def zipf_lookup_skew(spark, d):
    """Four lookups in five go to the hottest fifth of 1,000 ids."""
    seq = F.col("event_id")
    u, v = ids.hashed_unit(seq, F.lit("u")), ids.hashed_unit(seq, F.lit("v"))
    return inputs.read(spark, d, "events").select(seq.alias("seq"), F.when(u < 0.8, F.floor(v * 1000 / 5)).otherwise(F.floor(v * 1000)).cast("long").alias("picked"))


@query(f"SELECT op, count(*) AS n FROM (SELECT CASE WHEN r < 50 THEN 'add' WHEN r < 90 THEN 'lookup' ELSE 'expire' END AS op FROM (SELECT floor({_unit_sql('event_id', chr(39) + 'op' + chr(39))} * 100) AS r FROM events)) GROUP BY 1")
def mixed_ops(spark, d):
    r = F.floor(ids.hashed_unit(F.col("event_id"), F.lit("op")) * 100)
    op = F.when(r < 50, "add").when(r < 90, "lookup").otherwise("expire")
    return inputs.read(spark, d, "events").select(op.alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, 10 + user_id % 50 AS duty, CASE event_id % 3 WHEN 0 THEN 'spike' WHEN 1 THEN 'ramp' ELSE 'wave' END AS profile FROM events)
    SELECT seq, round(CASE profile WHEN 'ramp' THEN least(99.0, greatest(1.0, duty * ((ms % 10000) / 10000.0::DOUBLE) * 2.0))
      WHEN 'wave' THEN least(99.0, greatest(1.0, duty * (0.2::DOUBLE + 0.8::DOUBLE * ((sin((ms % 8000) / 8000.0::DOUBLE * pi() * 2.0) + 1.0) * 0.5)) * 2.0)) ELSE duty::DOUBLE END::DOUBLE, 6) AS duty FROM e"""
)
def burst_duty(spark, d):
    profile = F.when(F.col("event_id") % 3 == 0, "spike").when(F.col("event_id") % 3 == 1, "ramp").otherwise("wave")
    at = F.floor(inputs.epoch_us("ts") / 1000).cast("long")
    return inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.round(workload.burst_duty(profile, 10 + F.col("user_id") % 50, at), 6).alias("duty"))


GUIDS = """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN h WHEN 1 THEN g WHEN 2 THEN '{' || g || '}' WHEN 3 THEN '(' || g || ')' WHEN 4 THEN '{' || g || ')' ELSE substr(g, 2) END AS text
    FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS g FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events))"""
_D = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


@query(f"SELECT seq, text, regexp_full_match(text, '([0-9a-fA-F]{{32}}|{_D}|[{{]{_D}[}}]|[(]{_D}[)])') AS is_guid FROM ({GUIDS})")
def uuid_validity(spark, d):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    g = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("event_id") % 6
    text = F.when(k == 0, h).when(k == 1, g).when(k == 2, F.concat(F.lit("{"), g, F.lit("}"))).when(k == 3, F.concat(F.lit("("), g, F.lit(")"))).when(k == 4, F.concat(F.lit("{"), g, F.lit(")"))).otherwise(F.substring(g, 2, 40))
    return inputs.read(spark, d, "events").select(F.col("event_id").alias("seq"), text.alias("text"), ids.is_guid(text).alias("is_guid"))


@query(f"SELECT count(*) AS rows, count(DISTINCT (uhi, ulo)) AS ids FROM ({L})")
def distinct_ids(spark, d):
    per = inputs.lines(spark, d).groupBy(*history.KEY).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"))


@query()
def distinct_ids_approx(spark, d):
    return inputs.lines(spark, d).agg(F.approx_count_distinct(F.struct(*history.KEY), 0.01).alias("ids"))


BLOOM_BITS = 1 << 16


def _bloom(spark, d):
    rows = generations.routed(history.keep_first(inputs.documents(spark, d)), 4)
    return rows, bloom.build(rows, BLOOM_BITS)


@query("SELECT count(DISTINCT md5(text)) AS keys, 0::BIGINT AS missed FROM documents")
def bloom_no_false_negative(spark, d):
    rows, words = _bloom(spark, d)
    return bloom.may_contain(rows, words, BLOOM_BITS).agg(F.count("*").alias("keys"), F.count_if(~F.col("may_contain")).alias("missed"))


@query(f"SELECT hash_hi, hash_lo, count(*) AS copies FROM ({E}) GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicate_keys(spark, d):
    return history.repeated_keys(inputs.events(spark, d))


from . import stored  # noqa: E402, F401  registers more queries
