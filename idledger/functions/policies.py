"""Sizing and rollover policies, as plain Python and as Column expressions of the same name plus `_col`."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_power_of_two(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def is_power_of_two_col(x: Column) -> Column:
    x = x.cast("long")
    return (x > 0) & (x.bitwiseAND(x - F.when(x > F.lit(-(1 << 63)), F.lit(1)).otherwise(F.lit(0))) == 0)


def round_down_power_of_two(x: int, of_zero: int = 1) -> int:
    return of_zero if x == 0 else 1 << max(0, x.bit_length() - 1)


def round_down_power_of_two_col(x: Column, of_zero: int = 1) -> Column:
    x = x.cast("long")
    return F.when(x == 0, F.lit(of_zero).cast("long")).when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), F.length(F.bin(x)) - 1).cast("long"))


def load_limit(slots: int, load_percent: int) -> int:
    return slots * load_percent // 100


def bloom_target_bits(slots: int, load_percent: int, bits_per_entry: float) -> int:
    return math.ceil(slots * (load_percent / 100.0) * bits_per_entry)


def bloom_target_bits_col(slots: Column, load_percent: Column, bits_per_entry: Column) -> Column:
    return F.ceil(slots * (load_percent / 100.0) * bits_per_entry).cast("long")


def bloom_budget_bits(budget_bytes: int, shards: int, generations: int) -> int:
    share = shards * max(1, generations)
    return budget_bytes * 8 // share if share else budget_bytes * 8


def bloom_budget_bits_col(budget_bytes: Column, shards: Column, generations: Column) -> Column:
    share = shards * F.greatest(F.lit(1), generations)
    return F.call_function("floor", (budget_bytes * 8) / share).cast("long")


def bloom_desired_bits(target: int, budget: int, least: int) -> int:
    return max(min(target, budget), least)


def bloom_desired_bits_col(target: Column, budget: Column, least: Column) -> Column:
    return F.greatest(F.least(target, budget), least)


def used_slots_threshold(slots: int, percent: int) -> int:
    return slots * percent // 100 if percent else 0


def queue_depth_threshold(capacity: int, percent: int) -> int:
    return max(1, capacity * percent // 100) if percent else 0


def rolls_on_used(used: int, threshold: int) -> bool:
    return threshold != 0 and used >= threshold


def rolls_on_queue(pending: int, depth: int) -> bool:
    return depth > 0 and pending >= depth


def used_slots_threshold_col(slots: Column, percent: Column) -> Column:
    return F.when(percent == 0, F.lit(0)).otherwise(F.floor(slots * percent / 100)).cast("long")


def queue_depth_threshold_col(capacity: Column, percent: Column) -> Column:
    return F.when(percent == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(capacity * percent / 100))).cast("int")


def rolls_on_used_col(used: Column, threshold: Column) -> Column:
    return (threshold != 0) & (used >= threshold)


def rolls_on_queue_col(pending: Column, depth: Column) -> Column:
    return (depth > 0) & (pending >= depth)


def clamp_batch(n: int, most: int = 128) -> int:
    return min(max(n, 1), most)


@dataclass(frozen=True)
class BurstState:
    """How many requests the next burst may take, and how many weak bursts came in a row."""

    size: int
    weak: int = 0


def next_burst(state: BurstState, *, ceiling: int, taken: int, limit: int, pending: int, slow: bool, queue_capacity: int) -> BurstState:
    """The burst size after one burst: down by 2 when it was slow, down by 1 after three weak ones,
    up by 1, 2 or 4 when it was full, depending on what is still pending."""
    if slow:
        return BurstState(min(max(1, state.size - 2), ceiling))
    high = max(256, queue_capacity // 16)
    is_weak, full = taken <= max(1, limit // 4), taken >= limit
    weak = state.weak + 1 if is_weak else 0
    size = state.size
    if weak >= 3:
        size, weak = max(1, size - 1), 0
    if full and pending >= high:
        size += 4 if pending >= 2 * high else 2
    elif full and pending < high // 2 and not is_weak:
        size += 1
    return BurstState(min(max(size, 1), ceiling), weak)
