"""General-purpose compressors over serialized integer series."""

from __future__ import annotations

import bz2
import lzma

import numpy as np

try:
    import zstandard
except ImportError:  # optional
    zstandard = None
try:
    import brotli
except ImportError:  # optional
    brotli = None


def width_of(span: int) -> int:
    """Bytes of the narrowest unsigned integer for 0..span."""
    return next(w for w in (1, 2, 4, 8) if span < 1 << 8 * w or w == 8)


def serialize(a: np.ndarray) -> tuple[bytes, int]:
    """(bytes, width): the series above its least value in the narrowest unsigned integers."""
    a = np.asarray(a).astype(np.int64)
    if not len(a):
        return b"", 1
    low = int(a.min())
    w = width_of(int(a.max()) - low)
    return (a - low).astype(f"<u{w}").tobytes(), w


def deserialize(data: bytes, width: int, low: int) -> np.ndarray:
    """The series that `serialize` gave, from its least value."""
    return np.frombuffer(data, f"<u{width}").astype(np.int64) + low


def shuffle(data: bytes, width: int) -> bytes:
    """All first bytes, then all second bytes, and so on."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def methods() -> dict:
    found = {"xz": lambda b: lzma.compress(b, preset=9 | lzma.PRESET_EXTREME), "bz2": lambda b: bz2.compress(b, 9)}
    if zstandard is not None:
        found["zstd"] = lambda b: zstandard.ZstdCompressor(level=22).compress(b)
    if brotli is not None:
        found["brotli"] = lambda b: brotli.compress(b, quality=11)
    return found


def sizes(a: np.ndarray) -> dict[str, int]:
    """Compressed bytes by method and layout: raw, shuffled, differences, shuffled differences."""
    a = np.asarray(a).astype(np.int64)
    out = {}
    for name, values in (("raw", a), ("delta", np.diff(a, prepend=a[:1]))):
        data, w = serialize(values)
        for layout, b in ((name, data), (f"{name}_shuffled", shuffle(data, w))):
            out |= {f"{m}_{layout}": len(f(b)) for m, f in methods().items()}
    return out


def best_bytes(q: np.ndarray, header: int = 0) -> int:
    """The smaller of xz and zstd on the serialized indices, and a header."""
    data, _ = serialize(q)
    return min(len(f(data)) for m, f in methods().items() if m in ("xz", "zstd")) + header


def bucketed_bytes(q: np.ndarray, spread: np.ndarray, step: float, buckets: int = 8) -> int:
    """Streams split by quantile buckets of the predicted spread, compressed apart; 8 bytes for each bucket's edge."""
    s = np.maximum(np.asarray(spread, float) / max(step, 1e-9), 1e-6)
    b = np.searchsorted(np.quantile(s, np.linspace(0, 1, buckets + 1)[1:-1]), s)
    return sum(best_bytes(np.asarray(q)[b == i]) for i in range(buckets) if (b == i).any()) + 8 * buckets
