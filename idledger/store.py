"""A history of message identifiers in Parquet: add, look up, expire, walk, with rollover and retention."""

from __future__ import annotations

import copy
import time
import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Manifest, ManifestConflict
from .functions.ids import is_blank, is_guid
from .log import event
from .operators import bloom, generations, history, walk
from .operators.history import KEY
from .options import LIVE, MAX_BATCH, HistoryOptions, validate_root

ENTRIES = "hash_hi long, hash_lo long, server_hi long, server_lo long, shard_id int, seq long"
JOURNAL = "pos long, message_id string, server_id string, created_at timestamp, hash_hi long, hash_lo long"
WORDS = "generation int, shard_id int, word_idx int, word long"
TOMBSTONES = "hash_hi long, hash_lo long, at long, is_set boolean"
INVALID = "invalid"
#: Tombstone folders that are read before they are merged.
MOST_TOMBSTONES = 16


def _checksum(entries: DataFrame) -> int:
    """A checksum of entries in whatever order and files: the sum of the rows' CRC-32."""
    row = F.concat_ws(",", *(F.col(c).cast("string") for c in ("hash_hi", "hash_lo", "server_hi", "server_lo", "shard_id", "seq")))
    return int(entries.agg(F.coalesce(F.sum(F.crc32(row.cast("binary"))), F.lit(0))).first()[0])


class HistoryStore:
    """One writer at a time commits; readers see whole batches. State is the manifest alone, so opening
    a root again finds every retained generation, tombstone and journal entry."""

    def __init__(self, spark: SparkSession, root: str, options: HistoryOptions | None = None):
        self.spark, self.options = spark, options or HistoryOptions()
        self.catalog = Catalog(spark, validate_root(root))
        found = self.catalog.load()
        self.manifest = found or Manifest(shard_count=self.options.shard_count, slots_per_shard=self.options.slots_per_shard)
        for name in ("shard_count", "slots_per_shard"):
            if getattr(self.manifest, name) != getattr(self.options, name):
                raise ValueError(f"{name}: the store has {getattr(self.manifest, name)}")
        self.is_open = True
        if found:
            event("opened", root=self.catalog.root, version=found.version, generation=found.active_generation)
        else:
            event("created", root=self.catalog.root, shards=self.options.shard_count, slots=self.options.slots_per_shard)

    def tune(self, **changes) -> None:
        """Change settings of an open store; they are checked as at the beginning, and hold from the next call."""
        for name in changes:
            if name not in LIVE:
                raise ValueError(f"{name}: not to be changed on an open store")
        self.options = replace(self.options, **changes)
        event("tuned", changes=changes)

    def close(self) -> None:
        """Store the words of all retained generations; reads and writes are refused from now on."""
        if self.is_open:
            self.persist_words()
            self.is_open = False
            event("closed", root=self.catalog.root, version=self.manifest.version)

    # Reading.

    def _read(self, paths: Iterable[str], schema: str) -> DataFrame:
        if not self.is_open:
            raise ValueError("the store is closed")
        listed = [f"{self.catalog.root}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*listed) if listed else self.spark.createDataFrame([], schema)

    def entries(self, *, active_only: bool = False) -> DataFrame:
        """The stored keys of the retained generations; files of others are not opened."""
        kept = [self.manifest.active_generation] if active_only else self.manifest.retained(self.options.max_retained_generations)
        return self._read((b["entries"] for b in self.manifest.batches.values() if b["entries"] and b["generation"] in kept), ENTRIES)

    def expired(self) -> DataFrame:
        """The tombstones: keys that were last set, not cleared."""
        log = self._read(self.manifest.expired, TOMBSTONES)
        return log.groupBy(*KEY).agg(F.max_by("is_set", "at").alias("is_set")).where("is_set").drop("is_set")

    def words(self) -> DataFrame:
        """The stored words of the retained generations' filters: generation, shard_id, word_idx, word."""
        kept = self.manifest.retained(self.options.max_retained_generations)
        return self._read((b["path"] for g, b in self.manifest.bloom.items() if int(g) in kept), WORDS)

    def _candidates(self, keys: DataFrame, *, active_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """The entries that keys have to be compared with, and the keys that words do not rule out.

        Words rule a key out where they cover every batch that is looked at.
        """
        m, stored = self.manifest, self.entries(active_only=active_only)
        looked = {m.active_generation} if active_only else set(m.retained(self.options.max_retained_generations))
        batches = {k: b["generation"] for k, b in m.batches.items() if b["entries"] and b["generation"] in looked}
        covered = {k for g, b in m.bloom.items() if int(g) in looked and b["bits"] == self.options.bloom_bits for k in b["batches"]}
        if not batches or not set(batches) <= covered:
            return stored, keys
        routed = generations.routed(keys.select(*KEY).distinct(), self.options.shard_count)
        asked = routed.withColumn("generation", F.explode(F.array(*(F.lit(g) for g in sorted(set(batches.values()))))))
        asked = asked.withColumn("ask", F.struct("generation", *KEY))
        may = bloom.may_contain(asked, self.words(), self.options.bloom_bits, by=["generation", "shard_id"], id_column="ask")
        left = may.where("may_contain").select("ask.hash_hi", "ask.hash_lo").distinct()
        return stored, keys.join(left, KEY, "left_semi")

    def journal(self) -> DataFrame:
        """All inserts in order; those of retired generations stay."""
        return self._read((b["journal"] for b in self.manifest.batches.values() if b["journal"]), JOURNAL)

    @property
    def evicted_walk_entries(self) -> int:
        return walk.evicted_count(self.manifest.journal_rows, self.options.max_walk_entries)

    def lookup(self, ids: DataFrame, column: str = "message_id") -> DataFrame:
        """ids with found: stored in a retained generation and not expired. Blank ids are not found."""
        keyed = history.keyed(ids, column)
        stored, possible = self._candidates(keyed)
        stored = stored.select(*KEY).join(possible.select(*KEY), KEY, "left_semi") if possible is not keyed else stored
        return history.lookup(keyed, stored, self.expired() if self.manifest.expired else None).drop(*KEY)

    def contains(self, message_id: str) -> bool:
        self._check_id(message_id)
        one = self.spark.createDataFrame([(message_id,)], "message_id string")
        return bool(self.lookup(one).first()["found"])

    def walk(self, position: int = 0, limit: int | None = None, flags: int = 0) -> DataFrame:
        """Journal entries (pos, message_id, server_id, created_at) from a position on, less expired ones; flags are ignored.
        The next position is the last pos plus one."""
        rows = walk.walk(self.journal(), self.expired(), position=position, limit=limit, evicted=self.evicted_walk_entries)
        return rows.select("pos", "message_id", "server_id", "created_at")

    def walk_next(self, position: int = 0) -> tuple[int, tuple | None]:
        """One step of a cursor: the next position and the entry, or None at the end."""
        row = self.walk(position, 1).first()
        return (row["pos"] + 1, (row["message_id"], row["server_id"], row["created_at"])) if row else (max(position, self.manifest.journal_rows), None)

    def pressure(self) -> DataFrame:
        return generations.shard_pressure(self.entries(active_only=True), self.options.shard_count, failures=self.failures())

    def snapshot(self) -> DataFrame:
        return generations.snapshot(self.pressure(), self.manifest.active_generation)

    def audit(self) -> DataFrame:
        """Keys that are stored more than once."""
        return history.repeated_keys(self.entries())

    def scrub(self, samples: int | None = None, seed: int = 0) -> dict[str, int]:
        """Check a random sample of entries: how many were looked at, are stored more than once, are in a wrong shard, or
        are missing in their generation's words, which are then rebuilt. The counts are added to the log of scrubs."""
        entries = self.entries()
        some = entries.orderBy(F.xxhash64("hash_hi", "hash_lo", F.lit(seed))).limit(samples or self.options.slot_scrubber_samples_per_tick)
        copies = entries.join(some.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"))
        wrong = some.where(F.col("shard_id") != generations.shard_of(F.col("hash_lo"), self.options.shard_count)).count()
        out = {"sampled": some.count(), "repeated": copies.where("n > 1").count(), "misplaced": wrong, "missing": self._repair(samples or self.options.slot_scrubber_samples_per_tick, seed)}
        m = copy.deepcopy(self.manifest)
        for k, v in {"scrubs": 1, **out}.items():
            m.scrubs[k] = m.scrubs.get(k, 0) + v
        m.scrubs["last"] = time.time()
        self.manifest = self.catalog.commit(m, set())
        event("scrubbed", **out)
        return {k: out[k] for k in ("sampled", "repeated", "misplaced")}

    def _repair(self, samples: int, seed: int) -> int:
        lost = 0
        for g, b in list(self.manifest.bloom.items()):
            covered = self._read((self.manifest.batches[k]["entries"] for k in b["batches"] if self.manifest.batches[k]["entries"]), ENTRIES)
            some = covered.orderBy(F.xxhash64("hash_hi", "hash_lo", F.lit(seed))).limit(samples).withColumn("generation", F.lit(int(g)))
            asked = some.withColumn("ask", F.struct(*KEY))
            missing = bloom.may_contain(asked, self._read([b["path"]], WORDS), b["bits"], by=["generation", "shard_id"], id_column="ask").where("not may_contain").count()
            if missing:
                lost += missing
                event("bloom_repaired", missing=missing, generation=int(g))
                self._store_words(int(g), afresh=True)
        return lost

    def scrub_log(self) -> dict[str, float]:
        """How many scrubs there were, and what all of them looked at and found."""
        return dict(self.manifest.scrubs)

    def scrub_if_due(self) -> dict[str, int] | None:
        """A scrub, if the last one is slot_scrubber_interval_ms ago."""
        due = time.time() - self.manifest.scrubs.get("last", 0) >= self.options.slot_scrubber_interval_ms / 1000
        return self.scrub() if due else None

    def failures(self) -> DataFrame:
        """(shard_id, full_failures, pending): entries beyond the limit of the active generation's shards, where not zero."""
        rows = [(int(k), v, 0) for k, v in self.manifest.failures.items()]
        return self.spark.createDataFrame(rows, "shard_id int, full_failures long, pending long")

    def verify(self) -> list[str]:
        """The batches of retained generations whose entries do not match the checksum they were committed with."""
        kept, bad, seen = set(self.manifest.retained(self.options.max_retained_generations)), [], set()
        for name, b in self.manifest.batches.items():
            if b["entries"] and b["generation"] in kept and b.get("checksum") is not None and b["entries"] not in seen:
                seen.add(b["entries"])
                if _checksum(self._read([b["entries"]], ENTRIES)) != b["checksum"]:
                    event("checksum", batch=name)
                    bad.append(name)
        return bad

    # Writing.

    @staticmethod
    def _check_id(message_id: str) -> None:
        if not message_id or not message_id.strip():
            raise ValueError("message_id: not blank")

    def add_batch(self, rows: DataFrame, *, batch_id: str | None = None, journal: bool = True) -> DataFrame:
        """Insert rows (message_id, server_id, seq; created_at if known) that are not stored; rows with status.

        seq is unique and orders the batch: the first row of an id is inserted, later ones are duplicates.
        Blank ids, null ones and server ids that are not GUIDs are invalid. A batch_id that was committed
        before changes nothing and gives the statuses it gave then.
        """
        batch_id = batch_id or uuid.uuid4().hex
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.current_timestamp())
        keyed = history.keyed(rows, "message_id").withColumn("valid", ~is_blank(F.col("message_id")) & is_guid(F.col("server_id")))
        for attempt in range(self.options.max_rollover_retries + 1):
            if batch_id in self.manifest.batches:
                event("repeated", batch=batch_id)
                break
            try:
                self._commit(keyed.where("valid"), batch_id, journal and self.options.enable_walk_journal)
                break
            except ManifestConflict:
                newest = self.catalog.load()
                if newest.active_generation == self.manifest.active_generation or attempt == self.options.max_rollover_retries:
                    raise
                event("retry", generation=newest.active_generation, attempt=attempt + 1, most=self.options.max_rollover_retries)
                self.manifest = newest
        mine = self.manifest.batches[batch_id]
        inserted = self._read([mine["entries"]] if mine["entries"] else [], ENTRIES).select("seq", F.lit(True).alias("is_new"))
        status = F.when(~F.col("valid"), INVALID).when(F.col("is_new"), history.INSERTED).otherwise(history.DUPLICATE)
        return keyed.join(inserted, "seq", "left").withColumn("status", status).select(*[c for c in rows.columns if c != "created_at"], "status")

    def _commit(self, rows: DataFrame, batch_id: str, journal: bool) -> None:
        m = copy.deepcopy(self.manifest)
        stored, possible = self._candidates(rows, active_only=self.options.cross_generation_check == "active")
        fresh = history.new_only(possible, stored.select(*KEY))
        if possible is not rows:  # what the words rule out is new for certain
            ruled_out = rows.join(possible.select(*KEY), KEY, "left_anti")
            fresh = fresh.unionByName(history.keep_first(ruled_out))
        fresh = generations.routed(history.keyed(fresh.withColumnsRenamed({"hash_hi": "mh", "hash_lo": "ml"}), "server_id").withColumnsRenamed({"hash_hi": "server_hi", "hash_lo": "server_lo", "mh": "hash_hi", "ml": "hash_lo"}), self.options.shard_count)
        stage = f"staging/batch={batch_id}-{uuid.uuid4().hex}"
        columns = [f.name for f in self.spark.createDataFrame([], ENTRIES).schema]
        fresh.select(*columns, "message_id", "server_id", "created_at").write.parquet(f"{self.catalog.root}/{stage}")
        written = self.spark.read.parquet(f"{self.catalog.root}/{stage}")
        counts = {str(r["shard_id"]): r["n"] for r in written.groupBy("shard_id").agg(F.count("*").alias("n")).collect()}  # at most shard_count rows
        n = sum(counts.values())
        out = {"generation": m.active_generation, "entries": None, "journal": None, "inserted": n, "checksum": None}
        if n:
            out["entries"] = f"entries/generation_id={m.active_generation}/batch={batch_id}-{uuid.uuid4().hex}"
            written.select(*columns).sortWithinPartitions("shard_id", *KEY).write.option("parquet.bloom.filter.enabled#hash_lo", "true").parquet(f"{self.catalog.root}/{out['entries']}")
            out["checksum"] = _checksum(written)
            if journal:
                out["journal"] = f"journal/batch={batch_id}-{uuid.uuid4().hex}"
                placed = walk.with_positions(written, "seq", m.journal_rows)
                placed.select("pos", "message_id", "server_id", "created_at", *KEY).write.parquet(f"{self.catalog.root}/{out['journal']}")
                m.journal_rows += n
            if m.expired:
                cleared = self.expired().join(written.select(*KEY), KEY, "left_semi")
                if not cleared.isEmpty():
                    m.expired.append(self._write_tombstones(cleared, m.version + 1, False))
        o, cause = self.options, ""
        for s, k in counts.items():
            before, m.used[s] = m.used.get(s, 0), m.used.get(s, 0) + k
            surplus = max(0, m.used[s] - max(before, o.load_limit))
            if surplus:
                m.failures[s] = m.failures.get(s, 0) + surplus
                event("shard_full", shard=s, generation=m.active_generation, surplus=surplus)
        m.batches[batch_id] = out
        if m.used and max(m.used.values()) >= o.rollover_threshold:
            cause = "a shard reached its used slots"
        elif o.queue_threshold and counts and max(counts.values()) >= o.queue_threshold:
            cause = "a shard's share of a batch reached the queue watermark"
        elif 0 < o.proactive_rollover_aggregate_probe_failures_threshold <= sum(m.failures.values()):
            cause = "entries beyond the shards' limits reached the threshold"
        closed = m.active_generation
        if cause:
            m.active_generation, m.used, m.failures = closed + 1, {}, {}
        words = self._words_after(m, closed, bool(cause))
        self.manifest = self.catalog.commit(m, {batch_id})
        self.catalog.delete(stage)
        event("committed", batch=batch_id, inserted=n, generation=closed)
        if cause:
            event("rolled_over", generation=closed + 1, cause=cause)
        if words:
            event("bloom_stored", generation=closed, bits=o.bloom_bits)
        if len(self.manifest.expired) > MOST_TOMBSTONES:
            self._merge_tombstones()

    # Words of the generations' filters.

    @staticmethod
    def _uncovered(m: Manifest, generation: int) -> list[str]:
        covered = set(m.bloom.get(str(generation), {}).get("batches", ()))
        return [k for k, b in m.batches.items() if b["generation"] == generation and b["entries"] and k not in covered]

    def _words_after(self, m: Manifest, generation: int, closed: bool) -> bool:
        """Words are stored when a generation closes; before that after every batch, or after every bloom_checkpoint_interval
        inserts. They are listed in m, so that a batch, what it closes and its words are one version."""
        o, waiting = self.options, sum(m.batches[k]["inserted"] for k in self._uncovered(m, generation))
        due = closed or (waiting and (o.bloom_persist_mode == "durability" or waiting >= o.bloom_checkpoint_interval))
        if due and not closed and o.bloom_bits // 8 > o.bloom_checkpoint_max_bytes:
            event("bloom_skipped", generation=generation, bytes=o.bloom_bits // 8, most=o.bloom_checkpoint_max_bytes)
            return False
        return bool(due) and self._write_words(m, generation)

    def _write_words(self, m: Manifest, generation: int, afresh: bool = False) -> bool:
        """Add the words of the batches that are not covered to the stored ones of a generation, all of them `afresh`, and
        list them in m; whether there were any."""
        bits, old = self.options.bloom_bits, m.bloom.get(str(generation))
        afresh = afresh or not old or old["bits"] != bits
        names = [k for k, b in m.batches.items() if b["generation"] == generation and b["entries"]] if afresh else self._uncovered(m, generation)
        if not names:
            return False
        rows = self._read(dict.fromkeys(m.batches[k]["entries"] for k in names), ENTRIES).withColumn("generation", F.lit(generation))
        words, by = bloom.build(rows, bits, by=["generation", "shard_id"]), ["generation", "shard_id"]
        if not afresh:
            words = bloom.merge(self._read([old["path"]], WORDS), words, by=by)
        name = f"bloom/generation_id={generation}-{uuid.uuid4().hex}"
        words.select("generation", "shard_id", "word_idx", "word").write.parquet(f"{self.catalog.root}/{name}")
        m.bloom[str(generation)] = {"path": name, "bits": bits, "batches": names if afresh else [*old["batches"], *names]}
        return True

    def _store_words(self, generation: int, afresh: bool = False) -> None:
        m = copy.deepcopy(self.manifest)
        if self._write_words(m, generation, afresh):
            self.manifest = self.catalog.commit(m, set())
            event("bloom_stored", generation=generation, bits=self.options.bloom_bits)

    def persist_words(self) -> None:
        """Store the words of all retained generations, those without any included."""
        for g in self.manifest.retained(self.options.max_retained_generations):
            if self._uncovered(self.manifest, g):
                self._store_words(g)

    # Tombstones.

    def _write_tombstones(self, keys: DataFrame, at: int, is_set: bool) -> str:
        name = f"expired/version={uuid.uuid4().hex}"
        keys.select(*KEY, F.lit(at).cast("long").alias("at"), F.lit(is_set).alias("is_set")).write.parquet(f"{self.catalog.root}/{name}")
        return name

    def _merge_tombstones(self) -> None:
        m = copy.deepcopy(self.manifest)
        m.expired = [self._write_tombstones(self.expired(), m.version + 1, True)]
        event("tombstones_merged", count=len(self.manifest.expired))
        self.manifest = self.catalog.commit(m, set())

    def add(self, message_id: str, server_id: str) -> bool:
        """True if the id is new."""
        return self.add_items([(message_id, server_id)])[0]

    def add_items(self, items: list[tuple[str, str]]) -> list[bool]:
        """A small batch in order; at most MAX_BATCH items. Raises on blank ids and bad server ids."""
        if len(items) > MAX_BATCH:
            raise ValueError(f"items: at most {MAX_BATCH}")
        for message_id, _ in items:
            self._check_id(message_id)
        rows = self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(items)], "seq long, message_id string, server_id string")
        if rows.where(~is_guid(F.col("server_id"))).limit(1).count():
            raise ValueError("server_id: not a GUID")
        got = {r["seq"]: r["status"] == history.INSERTED for r in self.add_batch(rows).select("seq", "status").collect()}
        return [got[i] for i in range(len(items))]

    def expire(self, ids: DataFrame, column: str = "message_id") -> int:
        """Set tombstones, also on ids that were never added; how many are new."""
        valid = history.keyed(ids.where(~is_blank(F.col(column))), column)
        m = copy.deepcopy(self.manifest)
        name = self._write_tombstones(history.expire(valid, self.expired() if m.expired else None), m.version + 1, True)
        count = self._read([name], TOMBSTONES).count()
        if count:
            m.expired.append(name)
            self.manifest = self.catalog.commit(m, set())
            event("expired", count=count)
        return count

    def expire_ids(self, ids: list[str]) -> int:
        for i in ids:
            self._check_id(i)
        return self.expire(self.spark.createDataFrame([(i,) for i in ids], "message_id string"))

    def sync(self) -> int:
        """Every batch is durable once it is committed; the version that readers see."""
        return self.manifest.version

    def compact(self, generation: int) -> int:
        """Rewrite a closed generation's batches as one, sorted by shard and key; how many batches it replaced."""
        m = copy.deepcopy(self.manifest)
        old = [b for b in m.batches.values() if b["generation"] == generation and b["entries"]]
        if len({b["entries"] for b in old}) < 2:
            return 0
        name = f"entries/generation_id={generation}/compact-{uuid.uuid4().hex}"
        rows = self._read(dict.fromkeys(b["entries"] for b in old), ENTRIES)
        rows.repartitionByRange("shard_id", *KEY).sortWithinPartitions("shard_id", *KEY).write.parquet(f"{self.catalog.root}/{name}")
        first, *rest = old
        first["entries"], first["checksum"] = name, _checksum(rows)
        for b in rest:
            b["entries"] = None
        self.manifest = self.catalog.commit(m, {k for k, b in m.batches.items() if b["generation"] == generation})
        event("compacted", count=len(old), generation=generation)
        return len(old)

    def vacuum(self) -> list[str]:
        """Delete files that no retained generation, journal or tombstone set uses; their names."""
        kept = set(self.manifest.retained(self.options.max_retained_generations))
        used = {b["entries"] for b in self.manifest.batches.values() if b["generation"] in kept} | {b["journal"] for b in self.manifest.batches.values()} | set(self.manifest.expired) | {b["path"] for g, b in self.manifest.bloom.items() if int(g) in kept}
        gone = []
        folders = [f"entries/{g}" for g in self.catalog.children("entries")] + ["journal", "expired", "bloom", "staging"]
        for folder in folders:
            for name in self.catalog.children(folder):
                if f"{folder}/{name}" not in used:
                    self.catalog.delete(f"{folder}/{name}")
                    gone.append(f"{folder}/{name}")
        if gone:
            m = copy.deepcopy(self.manifest)
            m.bloom = {g: b for g, b in m.bloom.items() if int(g) in kept}
            dropped = {k for k, b in m.batches.items() if b["generation"] not in kept and b["entries"]}
            for k in dropped:
                m.batches[k]["entries"] = None
            self.manifest = self.catalog.commit(m, dropped)
            event("vacuumed", count=len(gone))
        return gone
