"""A folder of songs from files to files, as a run that tells how far it is, can be cancelled, and leaves all of its output or none."""

from __future__ import annotations

import queue
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import songs
from tidemark.plans import stems as T
from tidemark.plans.models import Model, Transcriber
from tidemark.plans.tables import settled
from tidemark.plans.transcribe import transcribe
from tidemark.sources.wav import read_wav, staged, write_files


@dataclass(frozen=True)
class Event:
    """Where a run is: a stage begins, or is done with something to say."""

    stage: str
    note: str | None = None
    folder: str | None = None


class Cancelled(Exception):
    """The run was cancelled."""


class Run:
    """Work on a thread of its own, whose Spark jobs carry one tag."""

    def __init__(self, spark: SparkSession, work: Callable[[Callable[[Event], None]], None]):
        self.spark, self.tag = spark, f"tidemark-run-{uuid.uuid4().hex}"
        self._events: queue.Queue[Event | None] = queue.Queue()
        self._work, self._stopped, self._error = work, False, None
        self._thread = InheritableThread(target=self._run)
        self._thread.start()

    def _say(self, event: Event) -> None:
        if self._stopped:
            raise Cancelled
        self._events.put(event)

    def _run(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            self._work(self._say)
        except BaseException as error:  # told to whoever waits
            self._error = Cancelled() if self._stopped else error
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self._events.put(None)

    def events(self) -> Iterator[Event]:
        """What the run says, until it ends; an error comes at the end."""
        while (event := self._events.get()) is not None:
            yield event
        self._events.put(None)
        self.wait()

    def cancel(self) -> None:
        """Ends the run's jobs and whatever it would have done next."""
        self._stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self) -> None:
        self._thread.join()
        if self._error:
            raise self._error


def split_folder(
    spark: SparkSession,
    source: str,
    target: str,
    vocals: Model | Callable[[], T.Separator],
    horns: Model | Callable[[], T.Separator],
    band: Mapping[str, Model | Callable[[], T.Separator]] | T.Core,
    options: T.Options = T.Options(),
    transcriber: Model | Callable[[], Transcriber] | None = None,
    chunk: int = 352_800,
    rate: int = 44_100,
    **how: object,
) -> Run:
    """Every WAV file in a folder, or one, to a folder of its name in ``target``; repeated names are numbered.

    Each stem is made once and kept until it is written. Files appear in ``target`` when all of them are there; after an error or a
    cancellation there are none. how: what :func:`tidemark.plans.transcribe.transcribe` takes.
    """
    if options.transcribe and transcriber is None:
        raise ValueError("transcribing takes a transcriber")

    def work(say: Callable[[Event], None]) -> None:
        say(Event("read"))
        mix = settled(read_wav(spark, source, rate))
        heard = None
        if options.transcribe:
            say(Event("transcribe"))
            heard = transcribe(mix, transcriber, **how)
            told = heard.summary.orderBy("track_id").limit(20).collect()
            say(Event("transcribe", note="; ".join(f"{r['track_id']}: {r['summary']}" for r in told)))

        def kept(name: str, stem: DataFrame) -> DataFrame:
            say(Event(name))
            return settled(stem)

        made = songs.split(mix, vocals, horns, band, options, heard, chunk, keep=kept)
        if made.grid is not None:
            say(Event("beats", note=f"{made.grid.count()} songs with a steady beat"))
        say(Event("write"))
        out = songs.files(made, options.device)
        if heard is not None:
            out = out.union(heard.files().select(F.concat_ws("/", "track_id", F.lit("transcription"), "name").alias("name"), "content"))
        with staged(target) as (stage, names):
            write_files(out, stage)
            say(Event("write", note="staged"))
        for name in names:
            say(Event("done", folder=f"{target.rstrip('/')}/{name}"))

    return Run(spark, work)
