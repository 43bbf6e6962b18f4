"""Workload runs over generated identifiers: phased, mixed, restart and auto-tune.

    python -m idledger.harness --mode phased --add-count 1000000 --root /tmp/history
"""

from __future__ import annotations

import argparse
import json
import math
import threading
import time
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import workload
from .functions.ids import clamp_index, generated_message_id, generated_server_id, hashed_unit
from .functions.policies import load_limit
from .operators import history, samples
from .options import HistoryOptions
from .shared import shared_path
from .sources.telemetry import process
from .store import HistoryStore


@dataclass(frozen=True)
class HarnessOptions:
    mode: str = "phased"
    root: str = ""
    add_count: int = 100_000
    lookup_count: int = 100_000
    batch_rows: int = 50_000
    dataset_size: int = 0
    target_generations: int = 0
    fill_factor: float = 1.0
    shard_count: int = 128
    slots_per_shard: int = 1 << 22
    max_load_factor_percent: int = 75
    max_retained_generations: int = 8
    forks: int = 8
    queue_capacity: int = 1_000_000
    mix_insert: int = 50
    mix_lookup: int = 40
    mix_expire: int = 10
    zipfian_skew: bool = False
    saturation_pending: int = 0
    degraded_p99_us: float = 0.0
    restart_slo_us: float = 0.0
    cold: bool = False
    lookup_forks: int = 8
    random_message_ids: bool = False
    duration_seconds: float = 0.0
    burst_profile: str = "none"
    burst_duty_percent: int = 50
    burst_sleep_ms: int = 0
    correlation_ms: int = 0
    cross_generation_check: str = "full"
    bloom_persist_mode: str = "throughput"
    bloom_checkpoint_interval: int = 1_000_000
    proactive_load_percent: int = 0
    queue_watermark_percent: int = 0
    probe_failure_threshold: int = 0
    scrub_samples: int = 256
    scrub_interval_ms: int = 0


CHOICES = {
    "mode": ("phased", "mixed", "restart", "autotune"), "burst_profile": ("none", "spike", "ramp", "wave"),
    "cross_generation_check": ("full", "active"), "bloom_persist_mode": ("throughput", "durability"),
}


def parse(arguments: list[str] | None = None) -> HarnessOptions:
    parser = argparse.ArgumentParser(prog="idledger.harness", description=__doc__)
    for f in fields(HarnessOptions):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(flag, type=type(f.default), default=f.default, choices=CHOICES.get(f.name))
    got = HarnessOptions(**vars(parser.parse_args(arguments)))
    for name in ("add_count", "lookup_count", "batch_rows", "shard_count", "forks", "lookup_forks"):
        if getattr(got, name) <= 0:
            parser.error(f"{name} must be over 0")
    if not 1 <= got.burst_duty_percent <= 100:
        parser.error("burst_duty_percent must be 1 to 100")
    if min(got.mix_insert, got.mix_lookup, got.mix_expire) < 0 or got.mix_insert + got.mix_lookup + got.mix_expire <= 0:
        parser.error("the mix must have a positive weight")
    return got


def add_target(o: HarnessOptions) -> int:
    """Rows that fill the wished number of generations, or add_count if that is more."""
    if o.target_generations <= 0:
        return o.add_count
    per = o.shard_count * o.slots_per_shard * o.max_load_factor_percent / 100.0 * o.fill_factor
    return max(o.add_count, int(per * o.target_generations))


def generated(spark: SparkSession, start: int, stop: int, dataset: int = 0, *, forks: int | None = None, seed: int | None = None) -> DataFrame:
    """Rows to add, over so many partitions; with a seed, indices that no other seed gives."""
    index = clamp_index(F.col("id"), dataset) if seed is None else F.xxhash64("id", F.lit(seed))
    return spark.range(start, stop, 1, forks).select(F.col("id").alias("seq"), generated_message_id(index).alias("message_id"), generated_server_id(index).alias("server_id"))


def picked(spark: SparkSession, count: int, stored: int, zipfian: bool, dataset: int = 0, forks: int | None = None) -> DataFrame:
    """Lookups: uniform over the stored indices, or four in five from the hottest fifth."""
    u, v = hashed_unit(F.col("id"), F.lit("u")), hashed_unit(F.col("id"), F.lit("v"))
    hot = F.when((u < 0.8) & F.lit(zipfian and stored > 10), F.floor(v * max(1, stored // 5))).otherwise(F.floor(v * max(1, stored)))
    return spark.range(0, count, 1, forks).select(F.col("id").alias("seq"), generated_message_id(clamp_index(hot.cast("long"), dataset)).alias("message_id"))


def mixed_ops(spark: SparkSession, o: HarnessOptions) -> DataFrame:
    total = o.mix_insert + o.mix_lookup + o.mix_expire
    roll = F.floor(hashed_unit(F.col("id"), F.lit("op")) * total)
    op = F.when(roll < o.mix_insert, "add").when(roll < o.mix_insert + o.mix_lookup, "lookup").otherwise("expire")
    back = F.floor(hashed_unit(F.col("id"), F.lit("at")) * (F.col("id") + 1)).cast("long")
    index = F.when(op == "add", F.col("id")).otherwise(back)
    return history.keyed(spark.range(o.add_count).select(F.col("id").alias("seq"), op.alias("op"), generated_message_id(clamp_index(index, o.dataset_size)).alias("message_id")), "message_id")


def _store(spark: SparkSession, o: HarnessOptions) -> HistoryStore:
    options = HistoryOptions(
        shard_count=o.shard_count, slots_per_shard=o.slots_per_shard, max_load_factor_percent=o.max_load_factor_percent, max_retained_generations=o.max_retained_generations,
        queue_capacity_per_shard=o.queue_capacity, cross_generation_check=o.cross_generation_check, bloom_persist_mode=o.bloom_persist_mode, bloom_checkpoint_interval=o.bloom_checkpoint_interval,
        proactive_rollover_load_factor_percent=o.proactive_load_percent, proactive_rollover_queue_watermark_percent=o.queue_watermark_percent,
        proactive_rollover_aggregate_probe_failures_threshold=o.probe_failure_threshold, slot_scrubber_samples_per_tick=o.scrub_samples, slot_scrubber_interval_ms=o.scrub_interval_ms or 30_000,
    )
    return HistoryStore(spark, o.root, options)


class Sampler:
    """Samples a store and the driver's process every so often, on a thread of its own, until it is stopped."""

    def __init__(self, store: HistoryStore, interval_ms: int):
        self.store, self.interval, self.rows, self.begun = store, interval_ms / 1000, [], time.perf_counter()
        self.done = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)
        if interval_ms:
            self.thread.start()

    def sample(self) -> None:
        m, at = self.store.manifest, process()
        self.rows.append((round((time.perf_counter() - self.begun) * 1000, 1), m.active_generation, sum(m.used.values()), sum(m.failures.values()), at.resident_bytes, at.cpu_seconds, at.written_bytes))

    def _run(self) -> None:
        while not self.done.wait(self.interval):
            self.sample()

    def stop(self) -> DataFrame:
        """The samples, with the change of failures from one to the next."""
        self.done.set()
        if self.thread.is_alive():
            self.thread.join()
        rows = self.store.spark.createDataFrame(self.rows, "elapsed_ms double, generation int, used_slots long, full_failures long, resident_bytes long, cpu_seconds double, written_bytes long")
        return samples.deltas(rows.withColumn("run", F.lit(0)), ["run"], "full_failures", "elapsed_ms").drop("run")


def _pause(o: HarnessOptions, elapsed_ms: float) -> None:
    """Wait for the share of burst_sleep_ms that the profile's duty leaves at this time."""
    if o.burst_profile == "none" or not o.burst_sleep_ms:
        return
    t, duty = elapsed_ms, float(o.burst_duty_percent)
    if o.burst_profile == "ramp":
        duty = min(99.0, max(1.0, duty * (t % 10_000 / 10_000) * 2))
    elif o.burst_profile == "wave":
        duty = min(99.0, max(1.0, duty * (0.2 + 0.8 * (math.sin(t % 8_000 / 8_000 * math.tau) + 1) / 2) * 2))
    time.sleep(o.burst_sleep_ms / 1000 * (1 - min(100.0, duty) / 100))


def _timed(f) -> tuple[float, object]:
    start = time.perf_counter()
    out = f()
    return (time.perf_counter() - start) * 1000, out


def _statuses(df: DataFrame) -> dict[str, int]:
    return {r["status"]: r["n"] for r in df.groupBy("status").agg(F.count("*").alias("n")).collect()}


def _report(spark: SparkSession, o: HarnessOptions, counts: dict, batches: list[tuple], elapsed: float, store: HistoryStore) -> dict:
    """Counters, rates, percentiles of batch times per row, and the verdict."""
    rows = spark.createDataFrame(batches, "kind string, batch long, us double, elapsed_ms double")
    spread = {r["kind"]: r.asDict() for r in samples.percentiles(rows, ["kind"], "us").collect()}
    p99 = spread.get("insert", {}).get("p99", 0.0)
    one = spark.range(1).select(workload.verdict(F.lit(p99), F.lit(0.0), F.lit(p99), F.lit(0.0), F.lit(0), saturation=o.saturation_pending, degraded_us=o.degraded_p99_us).alias("v"))
    seconds = elapsed / 1000
    return {
        "mode": o.mode, "elapsed_ms": round(elapsed, 1), **counts,
        "inserts_per_second": round(counts.get("inserted", 0) / seconds, 1), "lookups_per_second": round(counts.get("lookups", 0) / seconds, 1),
        "us_per_row": {k: {n: round(v, 3) for n, v in x.items() if n != "kind"} for k, x in spread.items()},
        "verdict": one.first()["v"], "generation": store.manifest.active_generation, "bytes": store.catalog.total_bytes(),
    }


def run_phased(spark: SparkSession, o: HarnessOptions) -> dict:
    """Insert, insert the same again, then look up."""
    store, target = _store(spark, o), add_target(o)
    sampler = Sampler(store, o.correlation_ms)
    counts = {"attempted": 0, "inserted": 0, "duplicate": 0, "lookups": 0, "found": 0}
    times, begun = [], time.perf_counter()
    for kind in ("insert", "duplicate"):
        for k, start in enumerate(range(0, target, o.batch_rows)):
            stop = min(target, start + o.batch_rows)
            if o.duration_seconds and time.perf_counter() - begun > o.duration_seconds:
                break
            seed = hash((kind, start)) & 0x7FFFFFFF if o.random_message_ids else None
            ms, got = _timed(lambda: _statuses(store.add_batch(generated(spark, start, stop, o.dataset_size, forks=o.forks, seed=seed), batch_id=f"{kind}-{start}", journal=False)))  # noqa: B023
            counts["attempted"] += stop - start
            for s in ("inserted", "duplicate"):
                counts[s] += got.get(s, 0)
            times.append((kind, k, ms * 1000 / (stop - start), (time.perf_counter() - begun) * 1000))
            if o.scrub_interval_ms:
                store.scrub_if_due()
            _pause(o, (time.perf_counter() - begun) * 1000)
    lookups(spark, o, store, counts, times, begun, min(target, o.dataset_size or target))
    report = _report(spark, o, counts, times, (time.perf_counter() - begun) * 1000, store)
    if o.correlation_ms:
        report["correlation"] = [r.asDict() for r in samples.tail(sampler.stop(), "elapsed_ms").collect()]
    return report


def lookups(spark, o, store, counts, times, begun, stored) -> None:
    probes = picked(spark, o.lookup_count, stored, o.zipfian_skew, o.dataset_size, o.lookup_forks)
    ms, got = _timed(lambda: store.lookup(probes).agg(F.count("*"), F.count_if("found")).first())
    counts["lookups"] += got[0]
    counts["found"] += got[1]
    times.append(("lookup", 0, ms * 1000 / max(1, got[0]), (time.perf_counter() - begun) * 1000))


def run_mixed(spark: SparkSession, o: HarnessOptions) -> dict:
    """Adds, lookups and expires in one sequence, replayed as if one by one."""
    ms, rows = _timed(lambda: history.replay(mixed_ops(spark, o)).groupBy("op", "result").agg(F.count("*").alias("n")).collect())
    return {"mode": o.mode, "elapsed_ms": round(ms, 1), "ops_per_second": round(o.add_count * 1000 / ms, 1), "results": {f"{r['op']}.{r['result']}": r["n"] for r in rows}}


def run_restart(spark: SparkSession, o: HarnessOptions) -> dict:
    """A phased run, then the store opened anew and looked up in batches until it is as fast as wished."""
    first = run_phased(spark, o)
    if o.cold:
        spark.catalog.clearCache()
    ms, store = _timed(lambda: _store(spark, o))
    times, begun = [], time.perf_counter()
    stored = min(add_target(o), o.dataset_size or add_target(o))
    for k in range(5):
        probes = picked(spark, max(1, o.lookup_count // 5), stored, o.zipfian_skew, o.dataset_size)
        took, n = _timed(lambda: store.lookup(probes).where("found").count())  # noqa: B023
        times.append((k, took * 1000 / max(1, o.lookup_count // 5), (time.perf_counter() - begun) * 1000, n))
    rows = spark.createDataFrame(times, "batch long, us double, elapsed_ms double, found long")
    line = samples.warmup_timeline(rows, "batch", "us", "elapsed_ms", o.restart_slo_us or float("inf")).orderBy("batch").collect()
    return first | {"mode": o.mode, "open_ms": round(ms, 1), "restart": [r.asDict() for r in line]}


def run_autotune(spark: SparkSession, o: HarnessOptions) -> dict:
    """A phased run for each trial; the first of the best scores wins."""
    results = []
    for k, trial in enumerate(workload.tuning_trials(o.shard_count, o.slots_per_shard, o.forks, o.queue_capacity)):
        own = replace(o, mode="phased", root=f"{o.root}/trial-{k:02d}", shard_count=trial["shards"], slots_per_shard=trial["slots"], forks=trial["forks"], queue_capacity=trial["queue"])
        r = run_phased(spark, own)
        results.append((k, json.dumps(trial), r["inserted"], r["lookups"], r["elapsed_ms"], r["us_per_row"]["insert"]["p99"]))
    rows = spark.createDataFrame(results, "trial long, settings string, inserted long, lookups long, elapsed_ms double, p99 double")
    zero = F.lit(0.0)
    scored = rows.withColumn("score", workload.trial_score(F.col("inserted"), F.col("lookups"), F.col("elapsed_ms"), F.col("p99"), zero, zero, F.col("inserted")))
    best = scored.orderBy(F.desc("score"), "trial").first()
    return {"mode": o.mode, "trials": [r.asDict() for r in scored.orderBy("trial").collect()], "best": json.loads(best["settings"]), "score": best["score"]}


RUNS = {"phased": run_phased, "mixed": run_mixed, "restart": run_restart, "autotune": run_autotune}


def main(arguments: list[str] | None = None) -> None:
    o = parse(arguments)
    assert load_limit(o.slots_per_shard, o.max_load_factor_percent) > 0
    spark = SparkSession.builder.appName("idledger-harness").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    o = o if o.root else replace(o, root=shared_path(spark, "harness"))  # executors share this folder
    print(json.dumps({"options": asdict(o), "report": RUNS[o.mode](spark, o)}, indent=1, default=str))


if __name__ == "__main__":
    main()
