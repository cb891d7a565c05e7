"""Models that hear frames or spectra, as separators of :mod:`tidemark.plans.stems`: what is around the model on its way in and out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidemark.operators import signal as S
from tidemark.plans.models import Model, loaded, require

#: (2, frames, frame) to frames of the same shape, windowed twice.
FrameModel = Callable[[np.ndarray], np.ndarray]
#: (2, segment) samples and their (2, bins, frames) spectrum to (sources, 2, segment) samples and (sources, 2, bins, frames) spectra.
SpectrumModel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Frames:
    """A separator of chunks around a model of frames."""

    def __init__(self, load: Callable[[], FrameModel], chunk: int, frame: int, hop: int):
        self.load, self.chunk, self.frame, self.hop = load, chunk, frame, hop

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        model = loaded(self.load)

        def hear(audio: np.ndarray) -> np.ndarray:
            given = np.stack([S.framed(c, self.frame, self.hop) for c in audio])
            made = np.asarray(model(given))
            if made.shape != given.shape:
                raise ValueError(f"the model gave frames of {made.shape} for those of {given.shape}")
            return np.stack([S.overlap_added(c, self.hop, self.chunk) for c in made])

        return hear


def from_frames(model: Model | Callable[[], FrameModel], chunk: int = 352_800, frame: int = 2048, hop: int = 441) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for :func:`tidemark.plans.stems.separate`. A model that takes another number of frames is refused here."""
    shape = (2, (chunk + 2 * (frame // 2) - frame) // hop + 1, frame)
    return _Frames(require(model, {"frames": shape}, {"recon": shape}), chunk, frame, hop)


class _Spectra:
    """A core of segments around a model of samples and their spectrum."""

    def __init__(self, load: Callable[[], SpectrumModel], segment: int, sources: int, frame: int, hop: int):
        self.load, self.segment, self.sources, self.frame, self.hop = load, segment, sources, frame, hop

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        model, frame, hop = loaded(self.load), self.frame, self.hop
        # frames begin three halves of a hop before their place, and the spectrum leaves its highest bin out
        lead, count, bins = hop // 2 * 3, -(-self.segment // hop), frame // 2

        def hear(audio: np.ndarray) -> np.ndarray:
            spectrum = np.stack([S.stft(c.astype(np.float64), frame, hop, lead, count)[:bins] for c in audio])
            time, spectra = (np.asarray(x) for x in model(audio, spectrum))
            if time.shape != (self.sources, 2, self.segment) or spectra.shape != (self.sources, *spectrum.shape):
                raise ValueError(f"the model gave arrays of {time.shape} and {spectra.shape}")
            top = np.zeros((1, count))
            waves = [[S.istft(np.vstack([c, top]), self.segment, frame, hop, lead, 2) for c in source] for source in spectra]
            return time + np.array(waves)

        return hear


def from_spectra(model: Model | Callable[[], SpectrumModel], segment: int = 343_980, sources: int = 4, frame: int = 4096, hop: int = 1024) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for :class:`tidemark.plans.stems.Core`: every source is what the model says in samples and in its spectrum, added up."""
    spectrum = (2, frame // 2, -(-segment // hop))
    load = require(model, {"mix": (2, segment), "spec": spectrum}, {"time": (sources, 2, segment), "freq": (sources, *spectrum)})
    return _Spectra(load, segment, sources, frame, hop)
