import pytest

from idledger.functions import policies as p
from idledger.functions.workload import tuning_trials
from idledger.options import HistoryOptions, validate_root


def test_bloom_sizing():
    assert p.bloom_target_bits(100, 50, 10.0) == 500
    assert p.bloom_budget_bits(1024, 4, 2) == 1024
    assert p.bloom_budget_bits(100, 8, 0) == 100


@pytest.mark.parametrize("case", [(100, 50, 10, 50), (100, 200, 10, 100), (5, 100, 10, 10)])
def test_desired_bits(case):
    assert p.bloom_desired_bits(*case[:3]) == case[3]


@pytest.mark.parametrize("slots,percent,want", [(1000, 0, 0), (100, 50, 50), (10, 33, 3)])
def test_used_slots_threshold(slots, percent, want):
    assert p.used_slots_threshold(slots, percent) == want


@pytest.mark.parametrize("capacity,percent,want", [(1000, 0, 0), (100, 10, 10), (100, 1, 1), (10, 5, 1)])
def test_queue_threshold(capacity, percent, want):
    assert p.queue_depth_threshold(capacity, percent) == want


@pytest.mark.parametrize("used,threshold,want", [(5, 10, False), (10, 10, True), (11, 10, True)])
def test_rolls_on_used(used, threshold, want):
    assert p.rolls_on_used(used, threshold) is want


@pytest.mark.parametrize("pending,depth,want", [(4, 5, False), (5, 5, True), (0, 0, False)])
def test_rolls_on_queue(pending, depth, want):
    assert p.rolls_on_queue(pending, depth) is want


@pytest.mark.parametrize("x,want", [(0, False), (1, True), (2, True), (3, False), (1024, True), (1023, False), (-1, False), (256, True)])
def test_power_of_two(x, want):
    assert p.is_power_of_two(x) is want


@pytest.mark.parametrize("x,want", [(0, 1), (1, 1), (2, 2), (3, 2), (1023, 512), (1024, 1024)])
def test_round_down(x, want):
    assert p.round_down_power_of_two(x) == want


def test_columns_equal_python(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in (-(1 << 63), -5, 0, 1, 2, 3, 1023, 1024, (1 << 62) + 1, (1 << 63) - 1)], "x long")
    for r in rows.select("x", p.is_power_of_two_col(F.col("x")).alias("a"), p.round_down_power_of_two_col(F.col("x")).alias("b")).collect():
        assert r["a"] == p.is_power_of_two(r["x"])
        assert r["b"] == (p.round_down_power_of_two(r["x"]) if r["x"] >= 0 else 1)


def test_burst_controller():
    state = p.BurstState(8)
    step = lambda s, **k: p.next_burst(s, **({"ceiling": 64, "taken": 8, "limit": 8, "pending": 0, "slow": False, "queue_capacity": 1000} | k))
    assert step(state).size == 9
    assert step(state, pending=300).size == 10
    assert step(state, pending=600).size == 12
    assert step(state, slow=True).size == 6
    for _ in range(3):
        state = step(state, taken=1)
    assert state == p.BurstState(7, 0)
    assert step(p.BurstState(63), pending=600).size == 64
    assert [p.clamp_batch(n) for n in (0, 5, 999)] == [1, 5, 128]


def test_trials_are_distinct():
    trials = tuning_trials(128, 1 << 22, 8, 1_000_000)
    assert len(trials) == 7
    assert len({tuple(t.values()) for t in trials}) == 7
    assert len(tuning_trials(32, 1 << 20, 2, 100_000)) < 7


@pytest.mark.parametrize(
    "name,value",
    [
        ("shard_count", 0), ("shard_count", -1), ("slots_per_shard", 3), ("slots_per_shard", 0), ("queue_capacity_per_shard", 0), ("max_retained_generations", 0),
        ("bloom_memory_fraction", 0.0), ("bloom_memory_fraction", 0.96), ("bloom_target_bits_per_entry", 3.9), ("bloom_target_bits_per_entry", 32.1),
        ("proactive_rollover_load_factor_percent", 75), ("proactive_rollover_queue_watermark_percent", -1), ("proactive_rollover_queue_watermark_percent", 100),
        ("proactive_rollover_aggregate_probe_failures_threshold", -1), ("slot_scrubber_samples_per_tick", 0), ("slot_scrubber_samples_per_tick", 100_001),
        ("slot_scrubber_interval_ms", 249), ("slot_scrubber_interval_ms", 86_400_001), ("max_walk_entries", -1), ("max_load_factor_percent", 0),
    ],
)
def test_options_name_the_bad_setting(name, value):
    with pytest.raises(ValueError, match=f"^{name}:"):
        HistoryOptions(**{name: value})


@pytest.mark.parametrize("slots,load,proactive", [(2, 51, 50), (64, 75, 1)])
def test_proactive_slots_must_lie_inside(slots, load, proactive):
    with pytest.raises(ValueError, match="^proactive_rollover_load_factor_percent:"):
        HistoryOptions(slots_per_shard=slots, max_load_factor_percent=load, proactive_rollover_load_factor_percent=proactive)


@pytest.mark.parametrize("path", [None, "", "  ", "a\0b", "x" * 40_000])
def test_bad_roots(path):
    with pytest.raises(ValueError, match="^path:"):
        validate_root(path)


def test_good_root(tmp_path):
    assert validate_root(str(tmp_path)) == str(tmp_path)
