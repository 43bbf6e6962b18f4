"""Settings with the ranges they must be in; an error names the setting."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .functions.policies import bloom_budget_bits, bloom_desired_bits, bloom_target_bits, is_power_of_two, load_limit, queue_depth_threshold, round_down_power_of_two, used_slots_threshold
from .sources.telemetry import bloom_budget

MAX_BATCH = 128
MAX_PATH = 32_767
LEAST_BLOOM_BITS = 1024
#: Settings that tune() may change on an open store.
LIVE = frozenset("""max_walk_entries bloom_checkpoint_interval bloom_checkpoint_max_bytes bloom_persist_mode cross_generation_check
proactive_rollover_load_factor_percent proactive_rollover_queue_watermark_percent proactive_rollover_aggregate_probe_failures_threshold
slot_scrubber_samples_per_tick slot_scrubber_interval_ms max_rollover_retries""".split())


def _require(ok: bool, name: str, rule: str) -> None:
    if not ok:
        raise ValueError(f"{name}: {rule}")


@dataclass(frozen=True)
class HistoryOptions:
    shard_count: int = 128
    slots_per_shard: int = 1 << 22
    max_load_factor_percent: int = 75
    queue_capacity_per_shard: int = 1_000_000
    max_retained_generations: int = 8
    enable_walk_journal: bool = True
    max_walk_entries: int = 1_048_576
    bloom_memory_fraction: float = 0.80
    bloom_target_bits_per_entry: float = 10.0
    bloom_memory_budget_bytes: int = 0
    bloom_checkpoint_interval: int = 1_000_000
    bloom_checkpoint_max_bytes: int = 32 << 20
    bloom_persist_mode: str = "throughput"
    cross_generation_check: str = "full"
    proactive_rollover_load_factor_percent: int = 72
    proactive_rollover_queue_watermark_percent: int = 0
    proactive_rollover_aggregate_probe_failures_threshold: int = 0
    slot_scrubber_samples_per_tick: int = 256
    slot_scrubber_interval_ms: int = 30_000
    max_rollover_retries: int = 4

    def __post_init__(self):
        _require(0 < self.shard_count <= 0x10000, "shard_count", "1 to 65,536")
        _require(is_power_of_two(self.slots_per_shard), "slots_per_shard", "a power of two")
        _require(1 <= self.max_load_factor_percent <= 99, "max_load_factor_percent", "1 to 99")
        _require(self.queue_capacity_per_shard > 0, "queue_capacity_per_shard", "over 0")
        _require(self.max_retained_generations > 0, "max_retained_generations", "over 0")
        _require(self.max_walk_entries >= 0, "max_walk_entries", "0 or more")
        _require(0 < self.bloom_memory_fraction <= 0.95, "bloom_memory_fraction", "over 0, to 0.95")
        _require(4 <= self.bloom_target_bits_per_entry <= 32, "bloom_target_bits_per_entry", "4 to 32")
        _require(self.bloom_persist_mode in ("throughput", "durability"), "bloom_persist_mode", "throughput or durability")
        _require(self.cross_generation_check in ("full", "active"), "cross_generation_check", "full or active")
        percent, name = self.proactive_rollover_load_factor_percent, "proactive_rollover_load_factor_percent"
        if percent:
            slots = used_slots_threshold(self.slots_per_shard, percent)
            _require(0 < percent < self.max_load_factor_percent, name, "0, or less than max_load_factor_percent")
            _require(0 < slots < load_limit(self.slots_per_shard, self.max_load_factor_percent), name, "some slots, and fewer than the hard limit")
        _require(0 <= self.proactive_rollover_queue_watermark_percent <= 99, "proactive_rollover_queue_watermark_percent", "0 to 99")
        _require(self.proactive_rollover_aggregate_probe_failures_threshold >= 0, "proactive_rollover_aggregate_probe_failures_threshold", "0 or more")
        _require(1 <= self.slot_scrubber_samples_per_tick <= 100_000, "slot_scrubber_samples_per_tick", "1 to 100,000")
        _require(250 <= self.slot_scrubber_interval_ms <= 86_400_000, "slot_scrubber_interval_ms", "250 to 86,400,000")

    @property
    def load_limit(self) -> int:
        """Entries that a shard of a generation takes; more are counted as failures."""
        return load_limit(self.slots_per_shard, self.max_load_factor_percent)

    @property
    def queue_threshold(self) -> int:
        """Rows of one shard in one batch at which the next batch opens a generation; 0: never."""
        return queue_depth_threshold(self.queue_capacity_per_shard, self.proactive_rollover_queue_watermark_percent)

    @property
    def bloom_bits(self) -> int:
        """Bits of one shard's filter: what the entries ask for, within the memory budget, a power of two."""
        target = bloom_target_bits(self.slots_per_shard, self.max_load_factor_percent, self.bloom_target_bits_per_entry)
        budget = bloom_budget_bits(bloom_budget(self.bloom_memory_fraction, self.bloom_memory_budget_bytes), self.shard_count, self.max_retained_generations)
        return round_down_power_of_two(bloom_desired_bits(target, budget, LEAST_BLOOM_BITS))

    @property
    def rollover_threshold(self) -> int:
        """Used slots of one shard at which the next batch opens a generation."""
        return used_slots_threshold(self.slots_per_shard, self.proactive_rollover_load_factor_percent) or load_limit(self.slots_per_shard, self.max_load_factor_percent)


def validate_root(path: str | None) -> str:
    """A usable root: a path or URI that is not blank, too long or holds a NUL."""
    _require(bool(path and path.strip()), "path", "not blank")
    _require("\0" not in path, "path", "no NUL")
    _require(len(path) <= MAX_PATH, "path", f"at most {MAX_PATH:,} characters")
    return path if "://" in path else os.path.abspath(path)
