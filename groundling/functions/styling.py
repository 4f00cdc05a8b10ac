"""Sequential style repair in plain Python: it runs in executors' Python workers.

Each pass reads what the pass before wrote, so one alternation of all terms
would not give the same text; a pass whose term a text does not hold costs one
plain search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from groundling.functions.vocabulary import style_passes


def _low(text: str) -> str:
    """Lower case, with the letters that a search without case takes for ASCII ones."""
    return text.replace("ſ", "s").replace("ı", "i").replace("İ", "i").lower()


@lru_cache(maxsize=1)
def _passes() -> list[tuple[str, re.Pattern, str]]:
    return [(term.lower(), re.compile((r"(?<![0-9A-Za-z_])%s(?![0-9A-Za-z_])" if bounded else "%s") % re.escape(term), re.IGNORECASE), to) for term, to, bounded in style_passes()]


def repair(text: str) -> str:
    """Banned terms replaced, with the case of the first letter kept."""
    low = _low(text)
    for term, pattern, to in _passes():
        if term in low:  # a plain search tells most passes that they have nothing to do
            text = pattern.sub(lambda m, to=to: to[0].upper() + to[1:] if m[0][0].isupper() else to, text)
            low = _low(text)
    return text


def repair_all(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One text at a time becomes a Python string, so a batch of long ones is held once."""
    for batch in texts:
        yield pa.array((repair(text.as_py()) for text in batch), pa.string(), size=len(batch))
