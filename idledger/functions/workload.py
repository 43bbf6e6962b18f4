"""Bench arithmetic: duty cycles, verdicts, scores and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(count: Column, elapsed_ms: Column) -> Column:
    return F.when(elapsed_ms > 0, count * 1000.0 / elapsed_ms).otherwise(F.lit(0.0))


def burst_duty(profile: Column, duty: Column, at_ms: Column) -> Column:
    """The share of calls that go through undelayed, in percent: steady, a 10 s ramp or an 8 s wave."""
    ramp = duty * (F.pmod(at_ms, F.lit(10_000)) / 10_000.0) * 2.0
    wave = duty * (0.2 + 0.8 * ((F.sin(F.pmod(at_ms, F.lit(8_000)) / 8_000.0 * math.pi * 2.0) + 1.0) * 0.5)) * 2.0
    bounded = lambda x: F.least(F.lit(99.0), F.greatest(F.lit(1.0), x))
    return F.when(profile == "ramp", bounded(ramp)).when(profile == "wave", bounded(wave)).otherwise(duty.cast("double"))


#: The labels of a run, in the order in which they are tried.
VERDICTS = ("Saturated", "Degraded", "Scheduler-bound", "Queue-bound", "Engine-bound", "Healthy")


def verdict(insert_p99: Column, queue_p99: Column, writer_p99: Column, depth_p99: Column, pending: Column, *, saturation: int, degraded_us: float) -> Column:
    a, b, c, d, e, f = map(F.lit, VERDICTS)
    return (
        F.when((F.lit(saturation) > 0) & (pending >= saturation), a)
        .when((F.lit(degraded_us) > 0) & (insert_p99 >= degraded_us), b)
        .when((queue_p99 > writer_p99 * 2.0) & (depth_p99 < 1.0), c)
        .when(queue_p99 > writer_p99 * 2.0, d)
        .when(writer_p99 > queue_p99 * 2.0, e)
        .otherwise(f)
    )


def interpretation(queue_p99: Column, writer_p99: Column, depth_p99: Column) -> Column:
    """One sentence on what dominates insert latency."""
    return (
        F.when((queue_p99 > writer_p99 * 2.0) & (depth_p99 < 1.0), F.lit("waiting dominates though the queue is short: hand-off overhead"))
        .when(queue_p99 > writer_p99 * 2.0, F.lit("waiting in the queue dominates"))
        .when(writer_p99 > queue_p99 * 2.0, F.lit("writing dominates"))
        .otherwise(F.lit("waiting and writing are balanced"))
    )


def trial_score(inserted: Column, looked_up: Column, elapsed_ms: Column, insert_p99: Column, queue_p99: Column, failed: Column, attempted: Column) -> Column:
    seconds = F.greatest(F.lit(1e-9), elapsed_ms / 1000.0)
    failures = F.when(attempted == 0, F.lit(0.0)).otherwise(failed / attempted)
    return inserted / seconds + looked_up / seconds * 0.35 - insert_p99 * 20.0 - queue_p99 * 12.0 - failures * 1_000_000.0


def tuning_trials(shards: int, slots: int, forks: int, queue: int) -> list[dict[str, int]]:
    """The settings an auto-tune run tries: the given ones, then one change at a time; repeats are left out."""
    from .policies import round_down_power_of_two

    base = max(2, forks)
    small, large = (max(32, shards // 2), min(1 << 24, slots * 2)), (min(255, shards * 2), max(1 << 20, slots // 2))
    rows = [(shards, slots, f, queue) for f in (base, min(64, base * 2), max(2, base // 2))]
    rows += [(*small, base, queue), (*large, base, queue)]
    rows += [(shards, slots, base, q) for q in (max(100_000, queue // 2), min(4_000_000, queue * 2))]
    tidy = dict.fromkeys((s, round_down_power_of_two(n, 1 << 20), f, q) for s, n, f, q in rows)
    return [dict(zip(("shards", "slots", "forks", "queue"), t, strict=True)) for t in tidy]
