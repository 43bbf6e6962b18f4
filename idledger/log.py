"""Named events of a store, on the standard logger "idledger"."""

from __future__ import annotations

import logging

logger = logging.getLogger("idledger")

#: Event: level and message.
EVENTS = {
    "opened": (logging.INFO, "opened {root} at version {version}, generation {generation}"),
    "created": (logging.INFO, "created {root}: {shards} shards of {slots} slots"),
    "upgraded": (logging.WARNING, "{root} was written in format {found}; it is read as format {format}"),
    "closed": (logging.INFO, "closed {root} at version {version}"),
    "committed": (logging.DEBUG, "batch {batch}: {inserted} inserted into generation {generation}"),
    "repeated": (logging.INFO, "batch {batch} was committed before; nothing changes"),
    "conflict": (logging.WARNING, "version {version} of {root} was committed by another writer"),
    "retry": (logging.WARNING, "another writer opened generation {generation}; try {attempt} of {most}"),
    "rolled_over": (logging.INFO, "generation {generation} opens: {cause}"),
    "shard_full": (logging.WARNING, "shard {shard} of generation {generation} holds {surplus} entries beyond its limit"),
    "expired": (logging.DEBUG, "{count} tombstones set"),
    "tombstones_merged": (logging.INFO, "{count} tombstone files became one"),
    "bloom_stored": (logging.INFO, "words of generation {generation} stored: {bits} bits a shard"),
    "bloom_skipped": (logging.INFO, "words of generation {generation} not stored between rollovers: {bytes} bytes a shard exceed {most}"),
    "bloom_repaired": (logging.WARNING, "{missing} sampled keys were missing in the words of generation {generation}; rebuilt"),
    "scrubbed": (logging.INFO, "{sampled} entries looked at: {repeated} repeated, {misplaced} misplaced, {missing} missing in words"),
    "checksum": (logging.ERROR, "batch {batch} does not match its checksum"),
    "compacted": (logging.INFO, "{count} batches of generation {generation} became one"),
    "vacuumed": (logging.INFO, "{count} folders deleted"),
    "tuned": (logging.INFO, "settings changed: {changes}"),
}


def event(name: str, **fields) -> None:
    level, message = EVENTS[name]
    if logger.isEnabledFor(level):
        logger.log(level, message.format(**fields), extra={"event": name, **{f"event_{k}": v for k, v in fields.items()}})
