"""Repair of conversations by error-correcting Earley parsing: the cheapest edits that make the roles a sentence of a grammar.

A conversation is a sentence whose words are the roles of its rows. ``GRAMMAR`` says which sentences are in order; error productions
let a row be deleted, or read as another role, and let a role without a row be inserted, each at a cost. A chart has one column
for each place between rows. A column holds items (rule, dot); each item keeps the least (cost, audit), the audit being the edits' initials
so far. Predictions and completions inside a column, insertions included, are relaxed until nothing gets less; reading a row takes the
items to the next column. The completed start symbol in the last column is the repair.

Rules have nonterminals at their left end only (others are refused), so every item begins at the first row and a column has no more items
than the grammar has dots. Two audits of an item with equal costs read equally many rows, and one that goes on where the other ends would
have cost more, so neither begins the other and the lesser one stays so whatever follows: keeping one audit for an item is exact.

What all items of a column have in common at the front of their audits is decided. It leaves the chart, and the rows it speaks of leave the
task, so a conversation of any length is read once, in order, in the memory that its undecided end takes. A column without what is decided,
and with costs counted from its cheapest item, is one of few; ``Chart`` remembers what each word makes of each, so a row costs a lookup.
Items that cost more than ``BEYOND`` above the cheapest are left out, as no repair goes on from them: an insertion or two, or one
deletion, take the cheapest item to a place that is as good. (Rows that are neither user's nor assistant's may all stay undecided while
they follow each other, as a role might be inserted before each; their texts wait in memory.)

Rows are dealt by conversation and sorted by Spark. A conversation's rows are read by one task, one after the other (an edit depends on
all before it); nothing is collected. Its faults (a blank row, a row said before, a truncated one) are found by window functions first.

Defined cases: a null role or text counts as one space; a null conversation id is a conversation of its own; rows without a turn come first,
and rows of one turn by role and text; a conversation without rows gives none; texts of any length are passed through whole; a role of
the grammar is told by its first letter; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A system row may open; then user and assistant take turns, and the assistant is last. Or nothing is said.
GRAMMAR = (("Goal", ()), ("Goal", ("Talk",)), ("Talk", ("Start", "user", "assistant")), ("Talk", ("Talk", "user", "assistant")), ("Start", ()), ("Start", ("system",)))
GOAL = "Goal"
#: Roles that a row may be read as, or that may be inserted without one.
FREE = ("user", "assistant")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: From any item to one as good as any other: two insertions (an opened talk must not end yet) and a deletion (a system row that only opens).
BEYOND = 2 * INSERT + DELETE
BLANK, SAID, CUT_OFF = "blank", "duplicate", "truncated"

#: (rule, dot) and the least (cost, audit) of it.
Column_ = tuple[tuple[int, int, int, str], ...]
#: First letter of the role, and the fault, of a row.
Word = tuple[str, str | None]


class Chart:
    """Columns of a chart under a grammar with error productions, made when they are first met."""

    def __init__(self, grammar: tuple = GRAMMAR, goal: str = GOAL, most: int = 1 << 16):
        self.names = {name for name, _ in grammar}
        if any(part in self.names for _, parts in grammar for part in parts[1:]):
            raise ValueError("a nonterminal stands inside a rule")
        self.grammar, self.goal, self.most = grammar, goal, most
        predicted = {(rule, 0): (0, "") for rule in range(len(grammar))}
        self.waiting = [(item, self.next(item)) for item in predicted]
        self.first = self._column(self._closed(predicted))[2]
        self.seen: dict[tuple[Column_, Word], tuple[int, str, Column_]] = {}
        self.ends: dict[Column_, tuple[int, str]] = {}

    def next(self, item: tuple[int, int]) -> str | None:
        """What stands behind the dot."""
        parts = self.grammar[item[0]][1]
        return parts[item[1]] if item[1] < len(parts) else None

    def _closed(self, items: dict[tuple[int, int], tuple[int, str]]) -> dict[tuple[int, int], tuple[int, str]]:
        """With completions and insertions. What waits for a nonterminal was predicted in the first column, at no cost."""
        best, open_ = dict(items), deque(items)
        while open_:
            item = open_.popleft()
            cost, audit = best[item]
            behind = self.next(item)
            if behind is None:
                made = [((rule, dot + 1), (cost, audit)) for (rule, dot), wanted in self.waiting if wanted == self.grammar[item[0]][0]]
            elif behind in FREE:
                made = [((item[0], item[1] + 1), (cost + INSERT, audit + "I"))]
            else:
                made = []
            for other, value in made:
                if other not in best or value < best[other]:
                    best[other] = value
                    open_.append(other)
        return best

    def _column(self, items: dict[tuple[int, int], tuple[int, str]]) -> tuple[int, str, Column_]:
        """The least cost, the audit that all items share, and the column without both."""
        least = min(cost for cost, _ in items.values())
        items = {item: value for item, value in items.items() if value[0] <= least + BEYOND}
        shared = os.path.commonprefix([audit for _, audit in items.values()])
        return least, shared, tuple(sorted((*item, cost - least, audit[len(shared) :]) for item, (cost, audit) in items.items()))

    def read(self, column: Column_, word: Word) -> tuple[int, str, Column_]:
        """What a row makes of a column: cost and edits that are decided, and the next column."""
        found = self.seen.get((column, word))
        if found is None:
            letter, fault = word
            made: dict[tuple[int, int], tuple[int, str]] = {}

            def put(item: tuple[int, int], value: tuple[int, str]) -> None:
                if item not in made or value < made[item]:
                    made[item] = value

            for rule, dot, cost, audit in column:
                put((rule, dot), (cost + DELETE, audit + "D"))
                behind = self.next((rule, dot))
                if fault in (BLANK, SAID) or behind is None or behind in self.names:
                    continue
                more = cost + (TRUNCATED if fault == CUT_OFF else 0)
                if behind[0] == letter:
                    put((rule, dot + 1), (more + KEEP, audit + "K"))
                if behind in FREE:
                    put((rule, dot + 1), (more + REROLE, audit + "R"))
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.seen[column, word] = self._column(self._closed(made))
        return found

    def end(self, column: Column_) -> tuple[int, str]:
        """Cost and edits that are left when no row follows."""
        if column not in self.ends:
            if len(self.ends) >= self.most:
                self.ends.clear()
            self.ends[column] = min((cost, audit) for rule, dot, cost, audit in column if self.grammar[rule][0] == self.goal and self.next((rule, dot)) is None)
        return self.ends[column]


def least_repair(words: list[Word], chart: Chart | None = None) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    chart = chart or Chart()
    column, cost, audit = chart.first, 0, ""
    for word in words:
        more, edits, column = chart.read(column, word)
        cost, audit = cost + more, audit + edits
    more, edits = chart.end(column)
    return cost + more, audit + edits


def with_faults(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault): each row with its first fault, dealt and sorted by conversation in the order of turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "_again"]
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    body = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = F.when(body == "", BLANK).when(F.col("_again"), SAID).when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT_OFF)
    # the deal serves the window too, so rows are shuffled once
    dealt = own.repartition("conv_id").withColumn("_again", again).withColumn("fault", fault)
    return dealt.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")


STEPS = "conv_id {id}, step long, edit string, turn long, was string, role string, text string, fault string, cost long"
_NAMES = ["conv_id", "step", "edit", "turn", "was", "role", "text", "fault", "cost"]
_EDITS = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}


class _Repair:
    """Steps of one conversation after the other, each as soon as it is decided."""

    def __init__(self, chart: Chart):
        self.chart = chart

    def begin(self, conv: object) -> None:
        self.conv, self.column, self.step, self.said = conv, self.chart.first, 0, 0
        self.rows: deque[tuple] = deque()

    def _steps(self, audit: str) -> Iterator[tuple]:
        for edit in audit:
            turn, was, text, fault = self.rows.popleft() if edit != "I" else (None, None, "", None)
            role = was
            if edit in "RI":
                role = FREE[self.said % 2]
            cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == CUT_OFF and edit in "KR" else 0)
            if edit != "D" and not (edit == "K" and self.said == 0 and was[:1] == "s"):
                self.said += 1
            yield self.conv, self.step, _EDITS[edit], turn, was, role, text, fault, cost
            self.step += 1

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        self.rows.append((turn, role, text, fault))
        _, edits, self.column = self.chart.read(self.column, (role[:1], fault))
        return self._steps(edits)

    def end(self) -> Iterator[tuple]:
        return self._steps(self.chart.end(self.column)[1])


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of each conversation, one row each: (conv_id, step, edit, turn, was, role, text, fault, cost).

    ``edit`` is keep, rerole, delete or insert; ``was`` the role before and ``role`` the one after; inserted rows have an empty text and no turn.
    Steps that are not deletions are the repaired conversation. Of repairs that cost the same, the one whose edits' initials come first in
    ASCII is taken. The steps of a conversation come together and in order.
    """
    faulty = with_faults(rows, id_col, turn_col, role_col, text_col)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, begun, size, out = _Repair(Chart()), False, 0, []

        def batch_of(steps: list[tuple]) -> pa.RecordBatch:
            columns = zip(*steps, strict=True) if steps else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [id_type, *kinds[1:]], strict=True)], _NAMES)

        id_type = pa.string()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or conv != work.conv:
                    out += work.end() if begun else ()
                    work.begin(conv)
                    begun = True
                out += work.read(*row)
                size += len(row[2])
                if len(out) >= 4096 or size >= 1 << 22:
                    yield batch_of(out)
                    size, out = 0, []
        if begun:
            yield batch_of([*out, *work.end()])

    return faulty.mapInArrow(run, STEPS.format(id=faulty.schema["conv_id"].dataType.simpleString()))


REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Roles of neighbours that are in order, by their first letters.
LEGAL = ("su", "ua", "au")


def repair_report(steps: DataFrame) -> DataFrame:
    """One row for each conversation in ``steps`` as :func:`repair` gives them: faults, cost, audit and the digest of what is left.

    gaps: turns missing between the first and the last; illegal: neighbours whose roles do not follow each other, before the repair.
    The digest is over lines ``role:text``. Steps are read in the order they come, so nothing is shuffled or held.
    """
    names = ["blank", "duplicate", "truncated"]
    columns = [c.split()[0] for c in REPORT.split(", ")]

    class Sum:
        def __init__(self, conv: object):
            self.conv, self.count, self.illegal, self.cost, self.audit = conv, dict.fromkeys(names, 0), 0, 0, []
            self.digest, self.lines, self.before = hashlib.sha256(), 0, None
            self.least = self.most = None
            self.turns = 0

        def add(self, edit: str, turn: int | None, was: str | None, role: str, text: str, fault: str | None, cost: int) -> None:
            self.cost += cost
            self.audit.append(edit[0].upper())
            if fault:
                self.count[fault] += 1
            if edit != "insert":
                self.illegal += self.before is not None and self.before + was[:1] not in LEGAL
                self.before = was[:1]
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.most
                self.most = turn
            if edit != "delete":
                self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1

        def row(self) -> tuple:
            gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
            return (self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, id_type = None, pa.string()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for conv, *step in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")], strict=True):
                if own is None or conv != own.conv:
                    if own is not None:
                        done.append(own.row())
                    own = Sum(conv)
                own.add(*step)
            if done:
                yield batch_of(done)
        if own is not None:
            yield batch_of([own.row()])

    return steps.mapInArrow(run, REPORT.format(id=steps.schema["conv_id"].dataType.simpleString()))


def with_all(report: DataFrame, conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``report`` with a row of zeros for each conversation that has no rows left."""
    ids = conversations.select(F.col(id_col).alias("_id")).distinct()
    joined = ids.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in report.columns if c not in ("conv_id", "audit", "repaired_sha256")}
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("_id").alias("conv_id"), *[v.alias(c) for c, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
