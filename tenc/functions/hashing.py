"""Row-key hashes: the only source of randomness in the package.

Every draw depends on the row key, a seed and optionally a fold, never on partitioning, so a
retried task or a different cluster size gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed seeds (must equal the published benchmark settings).
SAMPLE_SEED = 5
MODEL_SEED = 42
SPLIT_SEED = 32


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash(keys: str | list[str], seed: int, *extra: Column | int | str) -> Column:
    """Hex digest of ``key|seed|extra``; of several keys each part carries its length, or ``-``."""
    names = [keys] if isinstance(keys, str) else list(keys)
    texts = [F.col(k).cast("string") for k in names]
    if len(texts) > 1:
        texts = [
            F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
            for t in texts
        ]
    parts = texts + [F.lit(str(seed))]
    parts += [e.cast("string") if isinstance(e, Column) else F.lit(str(e)) for e in extra]
    return F.md5(F.concat_ws("|", *parts))


def hash_word(digest: Column | str, word: int = 0) -> Column:
    """The ``word``-th group of 32 bits of a hex digest as a long."""
    return F.conv(F.substring(_as_column(digest), 1 + 8 * word, 8), 16, 10).cast("long")


def uniform(digest: Column | str, word: int = 0) -> Column:
    """A uniform number in [0, 1)."""
    return hash_word(digest, word) / F.lit(4294967296.0)


def standard_normal(digest: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform of two digest words."""
    u1 = (hash_word(digest, 0) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * uniform(digest, 1))
