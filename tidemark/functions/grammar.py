"""Which tokens may follow which: a table over classes of tokens, for decoding one token at a time and for checking whole tables.

The state behind a token is the token's class; behind shifts it is how many stand there. An event is one or more shifts and then fields in
a fixed order, each at most once, but for pitches, of which there may be several, each with or without a length. A meter asks for a place in the bar.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import music as M

CLASSES: dict[str, range] = {
    "end": range(M.EOS, M.EOS + 1),
    "shift": M.SHIFT,
    "time": M.TIME,
    "meter": M.METER,
    "eighth": M.EIGHTH,
    "section": M.SECTION,
    "key": M.KEY,
    "triad": M.TRIAD,
    "chord": M.CHORD,
    "pitch": M.PITCH,
    "length": M.DURATION,
}
#: Shifts that may stand together.
MOST_SHIFTS = 4
_ANY = "time meter eighth section key chord pitch"
#: State, and the classes that may follow. ``other``: behind a token of no class.
FOLLOWS: dict[str, str] = {
    **{f"shift {n}": ("" if n == MOST_SHIFTS else "shift ") + _ANY for n in range(MOST_SHIFTS + 1)},
    "other": f"end shift {_ANY}",
    "time": "end shift meter eighth section key chord pitch",
    "meter": "end shift eighth",
    "eighth": "end shift section key chord pitch",
    "section": "end shift key chord pitch",
    "key": "end shift chord pitch",
    "triad": "end shift pitch",
    "chord": "end shift pitch",
    "pitch": "end shift length pitch",
    "length": "end shift pitch",
}
START = "shift 0"


def class_of(token: int) -> str:
    return next((name for name, ids in CLASSES.items() if token in ids), "other")


def after(state: str, token: int) -> str:
    """The state behind ``token``."""
    name = class_of(token)
    if name != "shift":
        return name
    before = int(state.split()[1]) if state.startswith("shift") else 0
    return f"shift {min(before + 1, MOST_SHIFTS)}"


@functools.cache
def permitted(state: str) -> np.ndarray:
    """Token ids that may follow a state, in order."""
    return np.concatenate([np.arange(CLASSES[name].start, CLASSES[name].stop) for name in CLASSES if name in FOLLOWS[state].split()])


def class_column(token: Column) -> Column:
    """:func:`class_of` of a column."""
    out = F
    for name, ids in CLASSES.items():
        out = out.when((token >= ids.start) & (token < ids.stop), name)
    return out.otherwise("other")


def follows_column(state: Column, name: Column) -> Column:
    """Whether a class may follow a state, for columns of both names."""
    table = F.create_map(*[F.lit(x) for s, names in FOLLOWS.items() for x in (s, names)])
    return F.array_contains(F.split(F.try_element_at(table, state), " "), name)
