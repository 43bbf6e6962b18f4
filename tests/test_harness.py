import pytest

from idledger import harness as h


def test_options():
    o = h.parse(["--mode", "mixed", "--add-count", "5", "--zipfian-skew"])
    assert (o.mode, o.add_count, o.zipfian_skew, o.shard_count) == ("mixed", 5, True, 128)
    for bad in (["--mode", "x"], ["--add-count", "0"], ["--mix-insert", "0", "--mix-lookup", "0", "--mix-expire", "0"]):
        with pytest.raises(SystemExit):
            h.parse(bad)
    assert h.add_target(h.HarnessOptions(target_generations=2, shard_count=2, slots_per_shard=1024, add_count=10)) == 3072


def test_restart_run(spark, tmp_path):
    o = h.HarnessOptions(mode="restart", root=str(tmp_path / "a"), add_count=300, lookup_count=200, batch_rows=200, shard_count=4, slots_per_shard=1 << 10)
    r = h.run_restart(spark, o)
    assert (r["attempted"], r["inserted"], r["duplicate"], r["found"]) == (600, 300, 300, 200)
    assert r["verdict"] == "Engine-bound" and len(r["restart"]) == 5 and r["restart"][0]["first_steady"]


def test_mixed_run(spark):
    r = h.run_mixed(spark, h.HarnessOptions(mode="mixed", add_count=2000))
    assert sum(r["results"].values()) == 2000 and r["results"]["lookup.hit"] > 0


def test_tuned_run(spark, tmp_path, caplog):
    caplog.set_level("DEBUG", logger="idledger")
    flags = """--add-count 400 --lookup-count 50 --batch-rows 200 --shard-count 2 --slots-per-shard 1024 --random-message-ids --correlation-ms 50 --burst-profile wave
    --burst-sleep-ms 20 --bloom-persist-mode durability --scrub-interval-ms 250 --scrub-samples 8 --queue-watermark-percent 1 --queue-capacity 5000 --max-retained-generations 8""".split()
    o = h.parse([*flags, "--root", str(tmp_path / "a")])
    r = h.run_phased(spark, o)
    assert (r["attempted"], r["inserted"], r["duplicate"]) == (800, 800, 0) and r["generation"] == 5
    assert r["correlation"] and max(x["generation"] for x in r["correlation"]) > 1
    seen = {x.event for x in caplog.records if x.name == "idledger"}
    assert {"created", "committed", "rolled_over", "bloom_stored", "scrubbed"} <= seen


def test_autotune(spark, tmp_path, monkeypatch):
    trials = [{"shards": 2, "slots": 1 << 10, "forks": f, "queue": 1000} for f in (2, 4)]
    monkeypatch.setattr(h.workload, "tuning_trials", lambda *a: trials)
    r = h.run_autotune(spark, h.HarnessOptions(mode="autotune", root=str(tmp_path / "a"), add_count=100, lookup_count=50, batch_rows=100))
    assert len(r["trials"]) == 2 and r["best"] in trials and r["score"] == max(t["score"] for t in r["trials"])
