"""Ids of byte-level BPE vocabularies for all texts of a slice at once.

The split of such a tokenizer puts a text's characters into runs of letters, numbers, other marks and white space, each run with one space before
it; English endings after an apostrophe stand alone. :func:`starts` finds the parts of many texts with a few comparisons of neighbours, and
:class:`ByteTokenizer` looks them up by hash; only parts that are new reach the tokenizer's model.
"""

from __future__ import annotations

import functools
import os
import sys

import numpy as np

from tidemark.llm.packing import PartTokenizer
from tidemark.llm.textbytes import prefix_hash

#: A Python worker remembers the ids of so many parts of texts, in arrays of about 100 MB, and then starts anew.
PARTS = 1 << 21
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Endings that follow an apostrophe, by their number of letters.
ENDINGS = {1: "s t m d", 2: "re ve ll"}
_PROBES = (
    "It's they'll  we've I'd 'tis don'T 'sS\n\n's x'll'rez",
    " a  b   c\t\td\n e \n f  ",
    "3.14 1st x2y ²³ ½ Ⅷ a_b -- ...!?  x y\u0085z\x1cw",
    "ÉTÉ naïve Straße 日本語のテキスト é 🙂🙂 ​ k'é",
)


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            a, b = run.span()
            out[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    return out


def starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a part begins at each code point; ``first`` marks those that begin a text."""
    n = len(chars)
    kind = kinds()[chars]
    white = kind == SPACE
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    blank = np.zeros(n, dtype=bool)  # a space just before
    blank[1:] = chars[:-1] == 32
    # the last of several white characters stands alone or with what follows, unless the text ends with it
    ends = np.ones(n, dtype=bool)
    ends[:-1] = first[1:]
    last = np.zeros(n, dtype=bool)
    last[:-1] = ~white[1:] & ~ends[:-1]
    out = first | np.where(white, (before != SPACE) | last, np.where(before == SPACE, ~blank, kind != before))
    # endings after an apostrophe that begins a part
    at = np.flatnonzero((chars == ord("'")) & out)
    text_end = np.append(np.flatnonzero(first), n)
    room = text_end[np.searchsorted(text_end, at, side="right")] - at if len(at) else at
    for size, some in ENDINGS.items():
        for ending in some.split():
            hit = room > size
            for k, letter in enumerate(ending, 1):
                hit &= chars[np.minimum(at + k, n - 1)] == ord(letter)
            out[at[hit] + 1] = False
            behind = at[hit & (room > size + 1)] + size + 1
            out[behind] = True
    return out


class ByteTokenizer(PartTokenizer):
    """Ids of texts by a byte-level BPE file of ``tokenizers``, remembered for each part. A file that splits otherwise is refused with an error."""

    def __init__(self, path: str, most: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        letters = [b for b in range(256) if b in {*range(33, 127), *range(161, 173), *range(174, 256)}]
        self.written = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
        self._clear()
        for probe in _PROBES:
            data = np.frombuffer(probe.encode(), dtype=np.uint8)
            if self.tokenizer.encode(probe, add_special_tokens=False).ids != self.ids(data, np.array([0, len(data)]))[0].tolist():
                raise ValueError(f"{path}: ids of a text are not those of its parts")

    def _encode(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.written))]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the offsets of each text's own."""
        if self.count > self.most - (1 << 18) and self.count:
            self._clear()
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(chars), dtype=bool)
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[np.searchsorted(place, begins)] = True
        start = place[starts(chars, first)]
        unit = self._entries(prefix_hash(data), data, start, np.append(start[1:], len(data)))
        size = self.size[unit]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[unit] - upto[:-1], size) + np.arange(upto[-1])
        return self.flat[at], upto[np.searchsorted(start, offsets)]


@functools.lru_cache(maxsize=1)
def worker_byte_tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of this Python worker, kept from task to task."""
    return ByteTokenizer(path)
