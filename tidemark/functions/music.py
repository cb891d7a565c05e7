"""Tokens of a transcription model, and names of keys and chords.

A note name is a place on the line of fifths (F -1, C 0, G 1, ...): its letter is the place modulo seven, a sharp adds seven,
and its pitch class is seven times the place modulo twelve. Chord tones are steps on that line from the root, from which both
their spelling and their semitones follow.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The model's vocabulary, as ranges of token ids.
PAD, SOS, EOS, OUT = 0, 1, 2, 3
PROMPT = (SOS, 4, 5, 6, 7, 9, 11, OUT)
SHIFT = range(260, 517)
TIME = range(517, 30_517)
METER = range(30_517, 30_709)
EIGHTH = range(30_709, 30_965)
SECTION = range(30_965, 30_988)
KEY = range(30_988, 31_012)
TRIAD = range(31_012, 31_037)
CHORD = range(31_037, 31_398)
PITCH = range(31_398, 31_654)
DURATION = range(31_654, 31_678)
TIME_HZ = 100.0

# Names and note lengths (in sixteenths) of the vocabulary, in its order.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAJOR_KEYS = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
MINOR_KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "Bb", "B")
SECTIONS = (
    "silence", "intro", "outro", "verse", "chorus", "bridge", "pre-chorus", "post-chorus", "interlude", "fade-out",
    "loop", "rap", "preshot", "irregular", "instrumental", "intro and verse", "pre-chorus and chorus",
    "verse and pre-chorus", "solo", "theme", "development", "variation", "pre-outro",
)
DURATIONS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096)
#: Qualities with their inversions, in the vocabulary's order, and their tones as steps on the line of fifths.
QUALITIES: dict[str, tuple[tuple[str, ...], tuple[int, ...]]] = {
    "maj": (("/2", "/3", "/5"), (0, 4, 1)),
    "min": (("/2", "/b3", "/5"), (0, -3, 1)),
    "dim": ((), (0, -3, -6)),
    "aug": ((), (0, 4, 8)),
    "maj7": (("/3", "/5", "/7"), (0, 4, 1, 5)),
    "min7": (("/b3", "/5", "/b7"), (0, -3, 1, -2)),
    "7": (("/3", "/5", "/b7"), (0, 4, 1, -2)),
    "hdim7": ((), (0, -3, -6, -2)),
    "dim7": ((), (0, -3, -6, -9)),
    "minmaj7": ((), (0, -3, 1, 5)),
    "sus2": ((), (0, 2, 1)),
    "sus4": ((), (0, -1, 1)),
    "sus4(b7)": ((), (0, -1, 1, -2)),
    "maj6": ((), (0, 4, 1, 3)),
    "min6": ((), (0, -3, 1, 3)),
}
#: Steps of the degrees that a bass can have.
BASS = {"2": 2, "b3": -3, "3": 4, "5": 1, "b7": -2, "7": 5}

FIELDS = ("timestamp", "rhythm", "structure", "key", "chord", "melody")
_LETTERS = "FCGDAEB"


def place_of(name: str) -> int | None:
    """Place of a note name on the line of fifths; None if it cannot be read."""
    if not re.fullmatch(r"[A-G][#b]*", name):
        return None
    return _LETTERS.index(name[0]) - 1 + 7 * (name.count("#") - name.count("b"))


def name_of(place: int) -> str:
    octave, letter = divmod(place + 1, 7)
    return _LETTERS[letter] + ("#" * octave if octave > 0 else "b" * -octave)


def pitch_class(name: str) -> int | None:
    place = place_of(name)
    return None if place is None else place * 7 % 12


def pitch_class_of(name: Column) -> Column:
    """:func:`pitch_class` of a column of note names."""
    natural = F.element_at(F.create_map(*[F.lit(v) for k, letter in enumerate(_LETTERS) for v in (letter, (k - 1) * 7 % 12)]), F.substring(name, 1, 1))
    raised = F.length(F.regexp_replace(name, "[^#]", "")) - F.length(F.regexp_replace(name, "[^b]", ""))
    return F.when(F.regexp_like(name, F.lit("^[A-G][#b]*$")), F.pmod(natural + raised, F.lit(12)))


def key_names() -> list[str]:
    return [f"{k}:major" for k in MAJOR_KEYS] + [f"{k}:minor" for k in MINOR_KEYS]


@functools.cache
def chord_names() -> tuple[str, ...]:
    """The vocabulary: none, then by quality and root the inversions and the root position."""
    return ("N", *(f"{root}:{quality}{bass}" for quality, (basses, _) in QUALITIES.items() for root in SHARPS for bass in (*basses, "")))


def triad_names() -> list[str]:
    return ["N", *(f"{r}:maj" for r in SHARPS), *(f"{r}:min" for r in SHARPS)]


def _parse(label: str) -> tuple[int, str, str] | None:
    """(place of the root, quality, degree of the bass) of a chord label."""
    root, colon, rest = label.partition(":")
    quality, _, bass = rest.partition("/")
    place = place_of(root)
    return (place, quality, bass) if colon and place is not None and quality in QUALITIES else None


@functools.cache
def spell(label: str, key: str) -> str:
    """A chord label with the root whose chord lies closest to the key on the line of fifths.

    The key's own seven notes lie within three places of its centre, two above the tonic of its signature; a tone costs what
    it lies beyond, the root twice. One root for each letter is tried, in the order C to B, and the first best wins.
    Labels or keys that cannot be read leave the label as it is.
    """
    chord, (tonic, _, mode) = _parse(label), key.partition(":")
    tonic_class = pitch_class(tonic)
    if chord is None or tonic_class is None or not mode:
        return label
    signature = place_of(MAJOR_KEYS[(tonic_class + (3 if mode == "minor" else 0)) % 12])
    place, quality, _ = chord
    roots = []
    for letter in "CDEFGAB":
        natural = _LETTERS.index(letter) - 1
        accidental = (place * 7 - natural * 7 + 6) % 12 - 6
        roots.append(natural + 7 * accidental)

    def cost(root: int) -> int:
        beyond = [max(abs(root + step - signature - 2) - 3, 0) for step in QUALITIES[quality][1]]
        return sum(beyond) + beyond[0]

    return name_of(min(roots, key=cost)) + label[label.index(":") :]


@functools.cache
def chord_pitches(label: str) -> tuple[int, ...]:
    """MIDI pitches: the bass in the octave from 36, the tones and the bass's own from 48 on; none for labels that cannot be read."""
    chord = _parse(label)
    if chord is None:
        return ()
    place, quality, degree = chord
    root, bass = place * 7 % 12, BASS.get(degree, 0) * 7 % 12
    tones = {step * 7 % 12 for step in QUALITIES[quality][1]} | {bass}
    return tuple(sorted({48 + root + t for t in tones} | {36 + (root + bass) % 12}))


def spelling_table(spark: SparkSession) -> DataFrame:
    """(raw, key, label): every chord of the vocabulary in every key; some nine thousand rows, for a broadcast join."""
    return spark.createDataFrame([(c, k, spell(c, k)) for k in key_names() for c in chord_names()], "raw string, key string, label string")


def pitch_table(spark: SparkSession) -> DataFrame:
    """(label, pitches): the pitches of every chord name that spelling can give."""
    names = {spell(c, k) for k in key_names() for c in chord_names()} | set(chord_names())
    return spark.createDataFrame([(c, list(chord_pitches(c))) for c in sorted(names)], "label string, pitches array<int>")


def _within(token: Column, ids: range) -> Column:
    return (token >= ids.start) & (token < ids.stop)


def field_of(token: Column) -> Column:
    """Which field of an event a token belongs to; null for the others."""
    out = F.when(_within(token, TIME), "timestamp").when(_within(token, METER) | _within(token, EIGHTH), "rhythm")
    out = out.when(_within(token, SECTION), "structure").when(_within(token, KEY), "key")
    return out.when(_within(token, TRIAD) | _within(token, CHORD), "chord").when(_within(token, PITCH) | _within(token, DURATION), "melody")


def _name_at(token: Column, ids: range, names: list[str] | tuple[str, ...]) -> Column:
    return F.when(_within(token, ids), F.get(F.array(*map(F.lit, names)), token - ids.start))


def section_name(token: Column) -> Column:
    return _name_at(token, SECTION, SECTIONS)


def key_name(token: Column) -> Column:
    return _name_at(token, KEY, key_names())


def chord_name(token: Column) -> Column:
    return F.coalesce(_name_at(token, CHORD, chord_names()), _name_at(token, TRIAD, triad_names()))


def meter_of(token: Column) -> Column:
    """struct(numerator, denominator) of a meter token."""
    index = token - METER.start
    return F.when(_within(token, METER), F.struct((F.floor(index / 6) + 1).cast("int").alias("numerator"), F.pow(F.lit(2), index % 6).cast("int").alias("denominator")))


def eighth_of(token: Column) -> Column:
    return F.when(_within(token, EIGHTH), token - EIGHTH.start)


def seconds_of(token: Column) -> Column:
    return F.when(_within(token, TIME), (token - TIME.start) / TIME_HZ)


def time_token(seconds: Column) -> Column:
    """The token of a time in a window, to the nearest hundredth, within the vocabulary."""
    return F.least(F.greatest(F.round(seconds * TIME_HZ).cast("int"), F.lit(0)), F.lit(len(TIME) - 1)) + TIME.start


def shift_tokens(subbeats: Column) -> Column:
    """Tokens whose shifts add up to ``subbeats``."""
    from tidemark.functions.arrays import split_steps

    return split_steps(subbeats, len(SHIFT) - 1, SHIFT.start)


def short_chord(label: Column) -> Column:
    """Lead-sheet name: a plain maj goes, a plain min is m and min7 is m7; other qualities stay behind the root."""
    parts = F.split(label, ":", 2)
    quality = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    short = F.when(quality == "maj", "").when(quality == "min", "m").when(quality == "min7", "m7").otherwise(quality)
    return F.concat(F.get(parts, F.lit(0)), short)
