"""Pattern scans shared by the secret and personal-data operators: spans found in whole texts, and
the digest of spans that their queries return."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, str]  # start, end (exclusive), kind; code points


def joined(spans: Iterable[Span], kinds: list[str]) -> str:
    """``kind:start:end`` of the spans by start, then kind in the listed order, then end; comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], order.get(x[2], len(order)), x[2], x[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def folded(text: str) -> str:
    """Lower case with the same length: the one letter whose lower case is longer is mapped first."""
    return text.replace("İ", "i").lower()
