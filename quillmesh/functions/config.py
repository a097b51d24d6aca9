"""Settings of an index, their bounds, and the errors that the library raises."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace


class IndexFault(Exception):
    """Any error of an index; transient ones may be tried again."""

    transient = False


class ConfigError(IndexFault):
    """A setting is outside its bounds."""


class QueryError(IndexFault):
    """A search was asked for with wrong arguments."""


class DataError(IndexFault):
    """Rows to be written break a rule."""


class CommitConflict(IndexFault):
    """Another writer has published the version first."""

    transient = True


@dataclass(frozen=True)
class Config:
    """vector_size and location never change once an index exists; the rest may."""

    vector_size: int = 384
    shard_size: int = 10_000
    batch_bytes: int = 1 << 20
    batch_ops: int = 1000
    batch_interval_ms: int = 100
    slop: int = 3
    min_slop: int = 1
    max_slop: int = 100
    adaptive_slop: bool = False
    bloom_size: int = 1024
    bloom_rate: float = 0.01
    policy: str = "by_position"
    max_text_bytes: int = 10 << 20

    def problems(self) -> list[str]:
        """What is wrong with the settings, in words."""
        bounds = {
            "vector_size": (1, 10_000), "shard_size": (1, 1_000_000), "batch_bytes": (1 << 10, 1 << 30), "batch_ops": (1, 1_000_000),
            "batch_interval_ms": (1, 30_000), "min_slop": (1, self.max_slop), "slop": (self.min_slop, self.max_slop), "bloom_size": (1, 1 << 31),
        }
        out = [f"{k} must be from {a} to {b}: {getattr(self, k)}" for k, (a, b) in bounds.items() if not a <= getattr(self, k) <= b]
        if self.policy not in {"none", "by_document", "by_position", "exact"}:
            out.append(f"unknown policy {self.policy}")
        if self.max_text_bytes and not 1 << 10 <= self.max_text_bytes <= 1 << 30:
            out.append(f"max_text_bytes must be 0 or from 1 KiB to 1 GiB: {self.max_text_bytes}")
        return out

    def is_valid(self) -> bool:
        return not self.problems()

    def checked(self) -> Config:
        if found := self.problems():
            raise ConfigError("; ".join(found))
        return self

    def merged(self, **changes) -> Config:
        if changes.get("vector_size", self.vector_size) != self.vector_size:
            raise ConfigError("vector_size can't change once an index exists")
        return replace(self, **changes).checked()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text)).checked()

    @classmethod
    def high_performance(cls, **changes) -> Config:
        return cls(shard_size=20_000, batch_interval_ms=50, slop=5, **changes)

    @classmethod
    def memory_optimized(cls, **changes) -> Config:
        return cls(shard_size=5_000, batch_interval_ms=200, slop=2, **changes)


def effective_slop(config: Config, n_shards: int) -> int:
    """The default breadth, widened with the dimension and the number of shards where adaptive_slop is on."""
    if not config.adaptive_slop:
        return config.slop
    wider = int(max(math.log2(config.vector_size) / 10, 0.1)) + int(max(math.sqrt(n_shards / 10), 1))
    return min(max(config.slop + wider, config.min_slop), config.max_slop)


def optimal_slop(dimension: int, n_shards: int) -> int:
    """A breadth for an index of so many shards: 3, wider for long vectors, never wider than the shards allow."""
    if n_shards <= 1:
        return 1
    wanted = 3 + (2 if dimension > 512 else 1 if dimension > 256 else 0)
    most = n_shards if n_shards <= 5 else 5 + (n_shards - 5) // 3 if n_shards <= 20 else 10 + (n_shards - 20) // 8 if n_shards <= 100 else 20
    return min(wanted, most, n_shards)


def bloom_parameters(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for n keys at a rate of false positives; 1 to 10 hashes."""
    bits = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return bits, min(max(math.ceil(bits / n * math.log(2)), 1), 10)


def batch_capacity(batch_bytes: int, margin: float, dimension: int) -> int:
    """Postings that fit a batch of so many bytes, from 10 to 1000."""
    return max(10, min(1000, int(batch_bytes * (1 - margin)) // (29 + 4 * dimension + 50)))
