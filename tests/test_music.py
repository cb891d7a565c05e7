import numpy as np
import pytest

from tidemark.functions import music as M
from tidemark.functions import grammar as G
from tidemark.plans.transcription import Transcription, describe, encode_events, follow, greedy_decode, overlap_prefix, parse_events, stitch

IN_C_MINOR = [("D#:maj", "Eb:maj"), ("G#:maj", "Ab:maj"), ("A#:7/3", "Bb:7/3"), ("D#:min7/b7", "Eb:min7/b7"), ("C:min", "C:min"), ("N", "N"), ("X", "X")]
ELSEWHERE = [
    ("C:maj", "E:major", "C:maj"), ("A#:maj", "G:major", "Bb:maj"), ("D#:maj", "G:major", "Eb:maj"), ("G#:7", "C:major", "Ab:7"),
    ("A#:min", "C:major", "Bb:min"), ("C#:hdim7", "G:major", "C#:hdim7"), ("F:hdim7", "G#:minor", "E#:hdim7"),
]


@pytest.mark.parametrize(("raw", "key", "expected"), [(r, "C:minor", e) for r, e in IN_C_MINOR] + ELSEWHERE)
def test_spelling(raw, key, expected):
    assert M.spell(raw, key) == expected


def test_spelling_keeps_pitches():
    for key in M.key_names():
        for chord in M.chord_names():
            assert M.chord_pitches(M.spell(chord, key)) == M.chord_pitches(chord)


def test_vocabulary_and_pitches():
    assert len(M.chord_names()) == len(M.CHORD) and len(M.DURATIONS) == len(M.DURATION) and len(M.SECTIONS) == len(M.SECTION)
    assert M.chord_pitches("D:min") == (38, 50, 53, 57)
    assert M.chord_pitches("G:maj/5") == (38, 55, 59, 62)
    assert M.chord_pitches("F#:min7/b3") == (45, 54, 57, 61, 64)
    assert M.chord_pitches("H:maj") == () and M.chord_pitches("N") == ()


def test_the_vocabulary_is_as_listed():
    """Fixed values, written out once more: the queries' SQL is filled with the code's own lists."""
    assert " ".join(M.key_names()[:12]) == "C:major Db:major D:major Eb:major E:major F:major F#:major G:major Ab:major A:major Bb:major B:major"
    assert " ".join(M.key_names()[12:]) == "C:minor C#:minor D:minor D#:minor E:minor F:minor F#:minor G:minor G#:minor A:minor Bb:minor B:minor"
    sections = "silence,intro,outro,verse,chorus,bridge,pre-chorus,post-chorus,interlude,fade-out,loop,rap,preshot,irregular,instrumental,intro and verse,pre-chorus and chorus,verse and pre-chorus,solo,theme,development,variation,pre-outro"
    assert ",".join(M.SECTIONS) == sections
    assert M.DURATIONS == (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096)
    assert M.PROMPT == (1, 4, 5, 6, 7, 9, 11, 3) and M.EOS == 2
    starts = {"SHIFT": 260, "TIME": 517, "METER": 30_517, "EIGHTH": 30_709, "SECTION": 30_965, "KEY": 30_988, "TRIAD": 31_012, "CHORD": 31_037, "PITCH": 31_398, "DURATION": 31_654}
    assert {name: getattr(M, name).start for name in starts} == starts and M.DURATION.stop == 31_678
    names = M.chord_names()
    assert len(names) == 361 and names[:6] == ("N", "C:maj/2", "C:maj/3", "C:maj/5", "C:maj", "C#:maj/2") and names[-1] == "B:min6"
    tones = {"maj": "0 4 7", "min": "0 3 7", "dim": "0 3 6", "aug": "0 4 8", "maj7": "0 4 7 11", "min7": "0 3 7 10", "7": "0 4 7 10", "hdim7": "0 3 6 10", "dim7": "0 3 6 9", "minmaj7": "0 3 7 11", "sus2": "0 2 7", "sus4": "0 5 7", "sus4(b7)": "0 5 7 10", "maj6": "0 4 7 9", "min6": "0 3 7 9"}
    assert {q: " ".join(str(t) for t in sorted(s * 7 % 12 for s in steps)) for q, (_, steps) in M.QUALITIES.items()} == tones
    assert {d: s * 7 % 12 for d, s in M.BASS.items()} == {"2": 2, "b3": 3, "3": 4, "5": 7, "b7": 10, "7": 11}
    assert M.triad_names()[:3] == ["N", "C:maj", "C#:maj"] and M.triad_names()[13] == "C:min" and len(M.triad_names()) == 25


def sequence():
    """4/4 from the first event, a chord and notes on the way."""
    t = lambda s: M.TIME.start + round(s * 100)
    four = M.METER.start + 3 * 6 + 2
    maj7 = M.CHORD.start + M.chord_names().index("G#:maj7")
    return [
        *M.PROMPT, 260, t(0.0), four, M.EIGHTH.start, M.SECTION.start + 3, M.KEY.start + 8, maj7,
        264, t(0.35), M.EIGHTH.start + 2, 264, t(0.71), M.EIGHTH.start + 4, 264, t(1.06), M.EIGHTH.start + 6, M.PITCH.start + 68, M.DURATION.start + 1,
        262, M.PITCH.start + 68 + 128, M.DURATION.start + 5, M.EOS, 300,
    ]


def tokens_of(spark, tokens):
    return spark.createDataFrame([("s", 0, i, t) for i, t in enumerate(tokens)], "track_id string, window_no int, pos int, token int")


def test_tokens_to_events_and_back(spark):
    tokens = sequence()
    events = parse_events(tokens_of(spark, tokens))
    told = describe(events).orderBy("event_no").collect()
    assert [r["subbeat"] for r in told] == [0, 4, 8, 12, 14]
    assert (told[0]["meter"]["numerator"], told[0]["meter"]["denominator"]) == (4, 4)
    assert (told[0]["section"], told[0]["key"], told[0]["chord"]) == ("verse", "Ab:major", "G#:maj7")
    assert told[3]["timestamp"] == 1.06 and told[3]["notes"][0].asDict() == {"pitch": 68, "track": 0, "subbeats": 2}
    assert told[4]["notes"][0]["track"] == 1
    assert encode_events(events).first()["tokens"] == tokens[: tokens.index(M.EOS)]


def test_transcription_views(spark):
    windows = spark.createDataFrame([("s", 0, 0.0, 0.0, 2.0, 2.0, 0)], "track_id string, window_no int, start double, accept_start double, accept_end double, duration double, base int")
    events = stitch(describe(parse_events(tokens_of(spark, sequence()))), windows).cache()
    song = Transcription(events)
    assert [(round(r["time"], 2), r["number"]) for r in song.beats.orderBy("time").collect()] == [(0.0, 1), (0.35, 2), (0.71, 3), (1.06, 4)]
    assert [(r["start"], r["end"], r["label"]) for r in song.chords.collect()] == [(0.0, 2.0, "Ab:maj7")]
    assert [(r["pitch"], r["track"]) for r in song.notes.orderBy("start").collect()] == [(68, 0), (68, 1)]
    assert song.summary.first()["summary"] == "Ab major, 4/4, 171 bpm, 1 bars"
    files = {r["name"]: bytes(r["content"]) for r in song.files().collect()}
    assert len(files) == 9 and files["key.lab"] == b"0.0\t2.0\tAb:major\n"
    assert files["chords.mid"][:4] == b"MThd" and files["beat.lab"].count(b"\n") == 4
    spans = spark.createDataFrame([("s", 0.3, 2.0)], "track_id string, from double, until double")
    prefix = overlap_prefix(events, spans).first()
    assert prefix["base"] == 4 and prefix["tokens"][:8] == list(M.PROMPT)
    four = M.METER.start + 3 * 6 + 2
    assert prefix["tokens"][8:12] == [260, M.TIME.start + 5, four, M.EIGHTH.start + 2]


def states(tokens):
    out = [G.START]
    for t in tokens:
        out.append(G.after(out[-1], t))
    return out


def test_grammar_follows_a_sequence():
    tokens = sequence()
    said = tokens[len(M.PROMPT) : tokens.index(M.EOS) + 1]
    for state, t in zip(states(said), said, strict=False):
        assert t in G.permitted(state)
    assert M.EOS not in G.permitted(G.START)
    for n in range(5):
        assert (260 in G.permitted(states([260] * n)[-1])) == (n < 4)
    meter = G.permitted(states([260, M.METER.start])[-1])
    assert M.EIGHTH.start in meter and M.KEY.start not in meter and M.EOS in meter
    assert set(G.permitted("length")) == {M.EOS, *M.SHIFT, *M.PITCH}
    assert not set(M.TRIAD) & set(np.concatenate([G.permitted(s) for s in G.FOLLOWS]).tolist())  # read, never said
    assert set(G.FOLLOWS) == {*(f"shift {n}" for n in range(5)), "other", *G.CLASSES} - {"shift", "end"}


def test_a_table_of_tokens_is_checked_like_a_sequence(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        own = [*M.PROMPT, *(int(rng.choice(list(G.CLASSES.values())[rng.integers(len(G.CLASSES))])) if rng.random() < 0.95 else 200 for _ in range(40))]
        rows += [(f"s{k}", 0, i, t) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "track_id string, window_no int, pos int, token int")
    got = {(r["track_id"], r["pos"]): (r["state"], r["fits"]) for r in follow(df).collect()}
    want = {}
    for k in range(60):
        own = [t for n, _, i, t in rows if n == f"s{k}" and i >= len(M.PROMPT)]
        for i, (state, t) in enumerate(zip(states(own), own, strict=False)):
            want[f"s{k}", i + len(M.PROMPT)] = (state, state != "end" and t in G.permitted(state))
    assert got == want


class Wish:
    """A decoder that wants given tokens behind the prompt, and counts what it is given."""

    def __init__(self, wish):
        self.wish, self.given, self.closed = wish, [], False

    def step(self, token):
        self.given.append(token)
        scores = np.zeros(M.DURATION.stop)
        scores[self.wish[min(max(len(self.given) - len(M.PROMPT), 0), len(self.wish) - 1)]] = 1
        return scores

    def close(self):
        self.closed = True


def test_greedy_decoding_obeys_the_grammar_and_gives_each_token_once():
    wish = [260, M.TIME.start + 10, M.EIGHTH.start, M.EOS]
    decoder = Wish(wish)
    assert greedy_decode(decoder, M.PROMPT, 10.0) == [*M.PROMPT, *wish]
    assert decoder.given == [*M.PROMPT, *wish[:-1]]
    assert greedy_decode(Wish(wish), M.PROMPT, 0.1) == [*M.PROMPT, *wish[:2], M.EOS]
    assert greedy_decode(Wish([M.PITCH.start]), M.PROMPT, 9.0, most=12) == [*M.PROMPT, *[M.PITCH.start] * 4, M.EOS]
    # what is wished but not allowed is passed over for the first token of equal score
    assert greedy_decode(Wish([M.DURATION.start, M.EOS, M.EOS]), M.PROMPT, 9.0)[len(M.PROMPT)] == M.SHIFT.start
