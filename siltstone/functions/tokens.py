"""Token counters for budgets."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol

# Fixed value: how the usual vocabularies cut text before merging.
_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)|[^\r\n\w]?[^\W\d_]+|\d{1,3}| ?[^\s\w]+[\r\n]*|_+|\s*[\r\n]|\s+", re.I)


class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


def estimate(text: str) -> int:
    """A cautious count without a vocabulary: each piece costs a third of its bytes, one at least; an empty text 0."""
    return sum(max(1, -(-len(p.encode("utf-8", "surrogatepass")) // 3)) for p in _PIECES.findall(text))


@lru_cache(maxsize=1)
def default_counter() -> TokenCounter:
    """Exact counts where the usual vocabulary is at hand, else the estimate."""
    try:
        import tiktoken

        encoding = tiktoken.get_encoding("cl100k_base")
    except Exception:  # not installed, or its vocabulary can't be read here
        return estimate
    return lambda text: len(encoding.encode(text, disallowed_special=()))
