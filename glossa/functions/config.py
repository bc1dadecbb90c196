"""Configuration of a dictionary and its bit-flag form."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Bits of the flag word.
NUM_TRIES_MASK = 0x7F
CACHE_BITS = {"huge": 0x80, "large": 0x100, "normal": 0x200, "small": 0x400, "tiny": 0x800}
TAIL_BITS = {"text": 0x1000, "binary": 0x2000}
ORDER_BITS = {"label": 0x10000, "weight": 0x20000}
CACHE_MASK, TAIL_MASK, ORDER_MASK, CONFIG_MASK = 0xF80, 0xF000, 0xF0000, 0xFFFFF
INVALID_KEY_ID = 0xFFFFFFFF


def _pick(flags: int, mask: int, bits: dict[str, int], default: str, what: str) -> str:
    value = flags & mask
    if not value:
        return default
    for name, bit in bits.items():
        if bit == value:
            return name
    raise ValueError(f"invalid {what} flags: {value:#x}")


@dataclass(frozen=True)
class DictConfig:
    """order decides ids and enumeration; num_tries, cache and tail are recorded and have no effect on results."""

    order: str = "weight"
    num_tries: int = 3
    tail: str = "text"
    cache: str = "normal"

    def __post_init__(self) -> None:
        if self.order not in ORDER_BITS:
            raise ValueError(f"order must be one of {', '.join(ORDER_BITS)}")
        if self.tail not in TAIL_BITS:
            raise ValueError(f"tail must be one of {', '.join(TAIL_BITS)}")
        if self.cache not in CACHE_BITS:
            raise ValueError(f"cache must be one of {', '.join(CACHE_BITS)}")
        if not 1 <= self.num_tries <= NUM_TRIES_MASK:
            raise ValueError(f"num_tries must be from 1 to {NUM_TRIES_MASK}")

    @classmethod
    def from_flags(cls, flags: int) -> DictConfig:
        """Zero bits of a group stand for its default."""
        if flags & ~CONFIG_MASK or flags < 0:
            raise ValueError(f"invalid configuration flags: {flags:#x}")
        return cls(
            order=_pick(flags, ORDER_MASK, ORDER_BITS, "weight", "node order"),
            num_tries=flags & NUM_TRIES_MASK or 3,
            tail=_pick(flags, TAIL_MASK, TAIL_BITS, "text", "tail mode"),
            cache=_pick(flags, CACHE_MASK, CACHE_BITS, "normal", "cache level"),
        )

    def flags(self) -> int:
        return self.num_tries | CACHE_BITS[self.cache] | TAIL_BITS[self.tail] | ORDER_BITS[self.order]

    def to_dict(self) -> dict:
        return asdict(self)
