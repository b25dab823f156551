"""Cutting texts at places where a byte-level pre-tokenizer always starts a new token.

The pre-tokenizer gives a single space to the token after it. A space between two characters that are not white
space therefore always begins a token, and a text may be cut before it: the tokens of the parts are those of the
whole. A single line break between two such characters is a token of its own, and a text may be cut before it, too.
Parts repeat very often, so callers do their work once for each distinct part of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Everything that some library takes for white space, and format characters near it.
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_UNEVEN = f"( [{_BLANK}]|[{_BLANK}] |^ | $)"
_PY_BLANK = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _BLANK)
_SAFE = re.compile(f"(?<=[^{_PY_BLANK}])(?=[ \n][^{_PY_BLANK}])")


def cut(text: str) -> list[str]:
    """The parts of one text; joined they are the text."""
    return _SAFE.split(text) if text else []


def distinct_parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(rows, part of each place, offsets by row, distinct parts), at most twice: for texts with plain spaces, and others, or of more lines than words.

    Null texts have no parts, as empty ones.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lines = pc.greater(pc.count_substring(texts, "\n"), pc.count_substring(texts, " "))
    uneven = pc.or_(pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, "")), lines).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~uneven)
    if len(even):
        lists = pc.split_pattern(texts.take(pa.array(even)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], lists.flatten()
        later, first = flat.dictionary_encode(), flat.take(pa.array(offsets[:-1])).dictionary_encode()
        index = later.indices.to_numpy().astype(np.int64)
        index[offsets[:-1]] = first.indices.to_numpy() + len(later.dictionary)
        yield even, index, offsets, [f" {x}" for x in later.dictionary.to_pylist()] + first.dictionary.to_pylist()
    odd = np.flatnonzero(uneven)
    if len(odd):
        seen: dict[str, int] = {}
        parts = [cut(x) for x in texts.take(pa.array(odd)).to_pylist()]
        index = np.array([seen.setdefault(p, len(seen)) for x in parts for p in x], np.int64)
        yield odd, index, np.cumsum([0, *map(len, parts)]), list(seen)


def expanded(index: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place in turn, the numbers starts[index], starts[index] + 1, ..., counts[index] of them."""
    n = counts[index]
    return np.repeat(starts[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
