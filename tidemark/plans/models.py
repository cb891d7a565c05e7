"""Models that a plan is given: what they take and give is checked before any task runs, and what a task holds of them is closed with it.

A model is loaded where it is used, once in a Python worker. This package has none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

#: Sizes of an array; None: any.
Shape = tuple[int | None, ...]


@dataclass(frozen=True)
class Model:
    """``load`` gives the model; ``inputs`` and ``outputs`` are the names and shapes it says it has."""

    load: Callable[[], Any]
    inputs: Mapping[str, Shape] = field(default_factory=dict)
    outputs: Mapping[str, Shape] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash(self.load)


class Session(Protocol):
    """A decoder at work on one context, with what it remembers of the tokens it has been given. It lives in one task."""

    def step(self, token: int) -> np.ndarray:
        """Scores of all tokens that might come next."""

    def close(self) -> None: ...


class Transcriber(Protocol):
    """An encoder, and a decoder that is opened for what the encoder has given."""

    def encode(self, samples: np.ndarray) -> Any: ...

    def open(self, context: Any) -> Session: ...


@functools.cache
def loaded(load: Callable[[], Any]) -> Any:
    return load()


def require(model: Model | Callable[[], Any], inputs: Mapping[str, Shape], outputs: Mapping[str, Shape]) -> Callable[[], Any]:
    """The model's loader, if it takes and gives what the plan hands it; a bare loader says nothing about itself and passes."""
    if not isinstance(model, Model):
        return model
    for kind, wanted, has in (("input", inputs, model.inputs), ("output", outputs, model.outputs)):
        if missing := sorted(set(wanted) - set(has)):
            raise ValueError(f"the model has no {kind} {missing[0]!r}, only {sorted(has)}")
        if kind == "input" and (more := sorted(set(has) - set(wanted))):
            raise ValueError(f"the model asks for an input {more[0]!r} that the plan does not give")
        for name, shape in wanted.items():
            own = has[name]
            if len(own) != len(shape) or any(a is not None and b is not None and a != b for a, b in zip(own, shape, strict=True)):
                raise ValueError(f"{kind} {name!r} of the model is {own}, not {shape}")
    return model.load


@contextmanager
def session(model: Transcriber, samples: np.ndarray) -> Iterator[Session]:
    """A decoder opened on encoded samples, closed at the end whatever happens."""
    own = model.open(model.encode(samples))
    try:
        yield own
    finally:
        own.close()
