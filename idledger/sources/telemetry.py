"""What the driver's process and machine report about themselves."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

#: Assumed where the machine does not say.
DEFAULT_MEMORY = 16 << 30


@dataclass(frozen=True)
class Telemetry:
    at: float
    resident_bytes: int
    cpu_seconds: float
    read_bytes: int
    written_bytes: int


def _fields(path: str) -> dict[str, int]:
    try:
        with open(path) as f:
            rows = (line.split(":", 1) for line in f if ":" in line)
            return {k.strip(): int(v.split()[0]) for k, v in rows if v.split() and v.split()[0].isdigit()}
    except OSError:
        return {}


def process() -> Telemetry:
    io, status, times = _fields("/proc/self/io"), _fields("/proc/self/status"), os.times()
    return Telemetry(time.time(), status.get("VmRSS", 0) * 1024, times.user + times.system, io.get("read_bytes", 0), io.get("write_bytes", 0))


def installed_memory() -> int:
    return _fields("/proc/meminfo").get("MemTotal", 0) * 1024 or DEFAULT_MEMORY


def bloom_budget(fraction: float, fixed: int = 0) -> int:
    """Bytes for filters: the fixed number, or a share of the installed memory."""
    return fixed or int(installed_memory() * fraction)
