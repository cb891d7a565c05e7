"""Licences of files: TF-IDF cosine of their lines to templates, then inheritance from the nearest directory with a licence.

Every line of every text is a possible notice. Terms are weighted by term
frequency and by inverse document frequency over all lines of the corpus; only the templates' terms have their frequency
counted, so what is counted is bounded by the templates, and any other word weighs as one that occurs nowhere else. A file's
own licence is that of the licence text, title or header that a run of its words equals best, over as many lines as they take, at
``BLOCK_LEAST`` or more; or else its best line's or best notice's inside a longer line, at ``LEAST`` or more. Every run of a template's
length is held against it, wherever it begins and whatever it begins with; runs end with the text. Only runs that a bound shows to be
below are left out: a text must have terms with ``BLOCK_LEAST`` squared of the template's own square, and a run's length is at least that of
its words if all differed. A notice inside a longer line must have four words in a row with its template. Wrapping and comment signs
play no part. A licence file speaks for its directory; a file without a licence of its own
takes that of the nearest ancestor directory that has one, found by a join of directories with their ancestors' paths.

Defined cases: texts that are null or empty have no licence of their own; rows with a null path neither inherit nor pass on; between
equal scores the earlier line and then the earlier template name wins; of several licence files in one directory the
best score and then the smaller path wins; an empty table gives no rows; repeated rows get equal results; texts of any length are
compared whole: a task holds a text, the numbers of its words (four bytes each), and slices of both; columns other than id, text and path
are not read, whatever their names.
"""

from __future__ import annotations

import functools
import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut

LEAST = 0.6
BLOCK_LEAST = 0.9
#: Characters of a text that are split into words at once, and places of runs that are compared at once.
PIECE, PLACES = 1 << 20, 1 << 15
#: Words that a Python worker has numbers for before it starts anew.
MOST_WORDS = 1 << 19

#: Notices as their licences' publishers recommend them, several for one licence where usage differs.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD 3-Clause license", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."

#: Titles and headers of more than a line, and short licence texts; the long ones are in ``license_texts``.
BLOCKS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _BSD_END,),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991", _GNU.format("", 2)),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007", _GNU.format("", 3)),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007", _GNU.format("Lesser ", 3)),
    "MIT": (_MIT,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")


def license_blocks() -> dict[str, tuple[str, ...]]:
    """``BLOCKS`` and the whole texts of long licences."""
    long = {name: (pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode(),) for name in LONG}
    return {name: BLOCKS.get(name, ()) + long.get(name, ()) for name in sorted({*BLOCKS, *long})}


_TERM = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")
_SPACE = re.compile(r"\s")


def terms(text: str) -> list[str]:
    """Lower-case words and numbers, with inner dots and hyphens."""
    return _TERM.findall(text.lower())


class Matcher:
    """Templates as vectors of length one, and the weights of their terms."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], lines: int, df: Mapping[str, int]):
        self.rare = math.log(1 + lines) + 1
        self.idf = {t: math.log((1 + lines) / (1 + df.get(t, 0))) + 1 for t in vocabulary(templates)}
        self.vectors = [(name, self._unit(Counter(terms(t)))) for name in sorted(templates) for t in templates[name]]
        self.names = [name for name, _ in self.vectors]
        # the templates of each term: what shares none of them has a cosine of zero to all
        self.where: dict[str, list[tuple[int, float]]] = {}
        for k, (_, vector) in enumerate(self.vectors):
            for t, x in vector.items():
                self.where.setdefault(t, []).append((k, x))

    def _unit(self, count: Mapping[str, int]) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.rare) for t, n in count.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / length for t, x in v.items()}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """Highest cosine to a template, and its name; the earlier name if several tie."""
        dots, square = [0.0] * len(self.names), 0.0
        for t, n in Counter(words).items():
            x = n * self.idf.get(t, self.rare)
            square += x * x
            for k, y in self.where.get(t, ()):
                dots[k] += x * y
        length = math.sqrt(square) or 1.0
        score, name = 0.0, None
        for other, dot in zip(self.names, dots, strict=True):
            if dot / length > score + 1e-12:
                score, name = dot / length, other
        return min(score, 1.0), name


class Words(dict):
    """Numbers of words: those of templates first, in order, then others as they come."""

    def __init__(self, own: set[str]):
        super().__init__((t, k) for k, t in enumerate(sorted(own)))
        self.own = len(self)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's words, piece by piece; pieces end at white space, where no word goes on."""
        if len(self) > MOST_WORDS:
            for word in list(self)[self.own :]:
                del self[word]
        parts, at = [], 0
        while at < len(text):
            end = _SPACE.search(text, min(at + PIECE, len(text)))
            piece = text[at : end.start() if end else len(text)]
            found = _TERM.findall(piece.lower())
            parts.append(np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found)))
            at += len(piece) + 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def counts_within(ids: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each id of ``of`` stands in ``ids[start:end]``, for arrays of all three."""
    n = len(ids) + 1
    key = np.sort(ids.astype(np.int64) * n + np.arange(len(ids)))
    return np.searchsorted(key, of.astype(np.int64) * n + end) - np.searchsorted(key, of.astype(np.int64) * n + start)


class Templates:
    """Templates held against the runs of a text that have as many words."""

    def __init__(self, matcher: Matcher, templates: Mapping[str, tuple[str, ...]], words: Words):
        self.matcher, self.words = matcher, words
        own = [(name, terms(text)) for name in sorted(templates) for text in templates[name]]
        self.names, self.sizes = [name for name, _ in own], np.array([len(t) for _, t in own], dtype=np.int64)
        self.ids = [np.array([words[t] for t in some], dtype=np.int32) for _, some in own]
        #: weight of each template's word, 0 in the last row for all others; idf of each word
        self.vector = np.zeros((words.own + 1, len(own)))
        for k, (_, some) in enumerate(own):
            for t, x in matcher._unit(Counter(some)).items():
                self.vector[words[t], k] = x
        self.idf = np.full(words.own + 1, matcher.rare)
        for t, x in matcher.idf.items():
            self.idf[words[t]] = x
        self.share = self.vector**2

    def score(self, k: int, ids: np.ndarray) -> float:
        """Cosine of a run to a template."""
        found, n = np.unique(ids, return_counts=True)
        own = np.minimum(found, self.words.own)
        x = n * self.idf[own]
        return round(min(float(x @ self.vector[own, k]) / math.sqrt(float(x @ x) or 1.0), 1.0), 12)

    def squares(self, ids: np.ndarray, start: int, stop: int, size: int) -> np.ndarray:
        """Squared lengths of the runs of ``size`` words from each of the places ``start`` to ``stop``."""
        own = np.minimum(ids, self.words.own)
        begin = np.arange(start, stop)
        end = np.minimum(begin + size, len(ids))
        # from one run to the next, its first word goes and the word behind it comes
        goes = -self.idf[own[begin]] ** 2 * (2 * counts_within(ids, ids[begin], begin, end) - 1)
        more = np.flatnonzero(end < len(ids))
        comes = np.zeros(len(begin))
        comes[more] = self.idf[own[end[more]]] ** 2 * (2 * counts_within(ids, ids[end[more]], begin[more] + 1, end[more]) + 1)
        _, n = np.unique(ids[start : end[0]], return_counts=True)
        first = float(((n * self.idf[np.minimum(np.unique(ids[start : end[0]]), self.words.own)]) ** 2).sum())
        return first + np.concatenate([[0.0], np.cumsum(goes + comes)[:-1]])

    def best(self, ids: np.ndarray, least: float) -> tuple[float, str | None, int]:
        """Highest cosine of a run to a template, its name and the run's first word; of equals the longer, then the earlier. Below ``least``: none."""
        found: tuple[float, int, int, int] = (0.0, 0, 0, -1)
        if not len(ids):
            return 0.0, None, 0
        seen = np.zeros(self.words.own + 1, dtype=bool)
        seen[np.minimum(ids, self.words.own)] = True
        seen[-1] = False
        for k in np.flatnonzero(self.share[seen].sum(axis=0) >= least * least - 1e-9).tolist():
            size = int(self.sizes[k])
            for a in range(0, len(ids), PLACES):
                part = ids[a : a + PLACES + size]
                own, begin = np.minimum(part, self.words.own), np.arange(min(PLACES, len(part), len(ids) - a))
                dots = np.concatenate([[0.0], np.cumsum(self.idf[own] * self.vector[own, k])])
                alone = np.concatenate([[0.0], np.cumsum(self.idf[own] ** 2)])
                end = np.minimum(begin + size, len(part))
                dot = dots[end] - dots[begin]
                maybe = np.flatnonzero(dot * dot >= least * least * (alone[end] - alone[begin]) - 1e-9)
                if not len(maybe):
                    continue
                low, high = int(maybe[0]), int(maybe[-1]) + 1
                score = np.round(dot[low:high] / np.sqrt(np.maximum(self.squares(part, low, high, size), 1e-12)), 9)
                p = low + int(score.argmax())
                if score.max() >= least - 1e-9 and (top := (float(score.max()), size, -(a + p))) > found[:3]:
                    found = (*top, k)
        score, size, begin, k = found
        exact = self.score(k, ids[-begin : -begin + size]) if k >= 0 else 0.0
        return (exact, self.names[k], -begin) if exact >= least else (0.0, None, 0)

    def _fours(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all four words in a row that templates have, and where they stand."""
        n = max(0, len(ids) - 3)
        rows = np.stack([ids[i : n + i] for i in range(4)], axis=1).astype(np.int64)
        at = np.flatnonzero((rows < self.words.own).all(axis=1))
        return rows[at] @ (self.words.own ** np.arange(3, -1, -1, dtype=np.int64)), at

    @functools.cached_property
    def _sharing(self) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        """The templates' own four words in a row, sorted, and where they stand in which."""
        where: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.ids):
            for key, at in zip(*map(np.ndarray.tolist, self._fours(own)), strict=True):
                where.setdefault(key, []).append((k, at))
        return np.array(sorted(where), dtype=np.int64), where

    def best_sharing(self, ids: np.ndarray) -> tuple[float, str | None, int]:
        """The same over runs that have four words in a row, where they stand in the template, whatever their cosine."""
        found: tuple[float, int, int, int] = (0.0, 0, 0, -1)
        known, where = self._sharing
        keys, places = self._fours(ids)
        some = np.isin(keys, known)
        for key, p in zip(keys[some].tolist(), places[some].tolist(), strict=True):
            for k, at in where[key]:
                begin, size = max(p - at, 0), int(self.sizes[k])
                top = (self.score(k, ids[begin : begin + size]), size, -begin)
                if top > found[:3]:
                    found = (*top, k)
        return found[0], self.names[found[3]] if found[3] >= 0 else None, -found[2]


def vocabulary(templates: Mapping[str, tuple[str, ...]]) -> set[str]:
    return {t for some in templates.values() for text in some for t in terms(text)}


def line_frequencies(texts: DataFrame, templates: Mapping[str, tuple[str, ...]]) -> tuple[int, dict[str, int]]:
    """Lines of the corpus, and in how many of them each term of a template occurs."""
    known = frozenset(vocabulary(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, df = 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                for line in lines_of(text.as_py() or ""):
                    lines += 1
                    if some := known.intersection(_TERM.findall(line.lower())):
                        df.update(some)
        df[""] = lines
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    df = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return df.pop("", 0), df


def lines_of(text: str) -> Iterator[str]:
    """The lines of a text, one at a time."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def line_of(text: str, word: int) -> int:
    """The line in which the word of this number stands."""
    k = -1
    for k, line in enumerate(lines_of(text)):
        if word < (n := len(_TERM.findall(line.lower()))):
            return k
        word -= n
    return k


def detect_licenses(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST, id_col: str = "id", text_col: str = "text", path_col: str = "path", blocks: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, path, own_license, score, line, lines): the licence of a file's best block or line and the line where it begins (from 0), null below ``least``.

    blocks: licence texts and headers of several lines; :func:`license_blocks` if not given.
    """
    texts = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    matcher = Matcher(templates, *line_frequencies(texts.select("text"), templates))
    blocks = license_blocks() if blocks is None else blocks
    own = vocabulary(templates) | vocabulary(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # short lines that repeat, such as a notice in every file, are compared once
        known = matcher.where.keys()
        compare = lambda line: (0.0, None) if known.isdisjoint(words := _TERM.findall(line)) else matcher.best(words)
        remembered = functools.lru_cache(1 << 12)(compare)
        words = Words(own)
        notices, long = Templates(matcher, templates, words), Templates(matcher, blocks, words)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for cell in batch.column(2):
                score, name, at, n = 0.0, None, None, 0
                if (text := cell.as_py()) is not None:
                    for n, line in enumerate(lines_of(text), 1):
                        s, other = (remembered if len(line) < 400 else compare)(line.lower())
                        if s > score + 1e-12:
                            score, name, at = s, other, n - 1
                    ids = words.of(text)
                    for (s, other, begin), enough in ((notices.best_sharing(ids), score + 1e-9), (long.best(ids, BLOCK_LEAST), BLOCK_LEAST)):
                        if other is not None and s >= enough:
                            score, name, at = s, other, line_of(text, begin)
                good = score >= least
                for c, v in zip(out, (name if good else None, score, at if good else None, n), strict=True):
                    c.append(v)
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["id", "path", "own_license", "score", "line", "lines"])

    return texts.mapInArrow(run, "id long, path string, own_license string, score double, line int, lines int")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit_licenses(found: DataFrame, speaks: Column) -> DataFrame:
    """``found`` with license and license_path: a file's own, or that of the nearest directory upwards with a licence file.

    speaks: whether a row of :func:`detect_licenses` is a licence file.
    """
    found = cut(found.withColumn("dir", directory(F.col("path"))))
    owners = found.where(speaks & F.col("own_license").isNotNull() & F.col("path").isNotNull())
    order = F.struct((-F.col("score")).alias("worse"), "path", "own_license")
    best = owners.groupBy(F.col("dir").alias("up")).agg(F.min(order).alias("best"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    dirs = found.where("own_license is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("a"))
    near = dirs.select("dir", "a.depth", F.col("a.up").alias("up2")).join(best, F.col("up2") == F.col("up")).groupBy("dir").agg(F.max(F.struct("depth", "best"))["best"].alias("best"))
    # a table of its own, so that the join can split a directory with very many files
    out = found.join(cut(near.withColumnRenamed("dir", "d2")), F.col("dir") == F.col("d2"), "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "id", "path", "own_license", "score", "line",
        F.when(own, F.col("own_license")).otherwise(F.col("best.own_license")).alias("license"),
        F.when(own, F.col("path")).otherwise(F.col("best.path")).alias("license_path"),
    )
