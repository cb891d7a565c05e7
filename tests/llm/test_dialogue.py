"""Repair of conversations: the chart against plain dynamic programming and against every repair, the report against SQL and by hand."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.conftest import SF, same_rows
from tidemark.llm import dialogue, queries
from tidemark.llm.oracles import OP11_SQL

INF = (10**9, "")


def plain(words):
    """Least (cost, audit) by states: nothing said, a system row said, the assistant's turn, the user's turn; nothing is left out."""
    plus = lambda v, c, e: (v[0] + c, v[1] + e)

    def insert(v):
        v[2] = min(v[2], *(plus(v[k], 3, "I") for k in (0, 1, 3)))
        v[3] = min(v[3], plus(v[2], 3, "I"))
        return v

    state = insert([(0, ""), INF, INF, INF])
    for letter, fault in words:
        new = [plus(v, 4, "D") for v in state]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            for a, b, want in ((0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                if letter == want:
                    new[b] = min(new[b], plus(state[a], more, "K"))
                if want != "s":
                    new[b] = min(new[b], plus(state[a], more + 3, "R"))
        state = insert(new)
    return min(state[0], state[3])


def every(words, most=2):
    """Least (cost, audit) over all edits with at most ``most`` insertions before each row and at the end."""
    best = INF
    for edits in itertools.product("KRD", repeat=len(words)):
        for held in itertools.product(range(most + 1), repeat=len(words) + 1):
            cost, audit, roles, fine = 3 * sum(held), "I" * held[0], ["?"] * held[0], True
            for (letter, fault), e, n in zip(words, edits, held[1:], strict=True):
                fine &= e == "D" or fault not in ("blank", "duplicate")
                cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if fault == "truncated" and e != "D" else 0)
                audit += e + "I" * n
                roles += ([letter] if e == "K" else ["?"] if e == "R" else []) + ["?"] * n
            if fine and (cost, audit) < best:
                sentence = [("ua"[k % 2], "ua"[(k + 1) % 2]) for k in range(len(roles))]
                if any(len(roles[off:]) % 2 == 0 and (not off or (roles[0] == "s" and len(roles) > 1)) and all(r in ("?", want[0]) for r, want in zip(roles[off:], sentence, strict=False)) for off in (0, 1) if off <= len(roles)):
                    best = (cost, audit)
    return best


def test_chart_equals_dynamic_programming():
    rng, chart = random.Random(5), dialogue.Chart()
    for _ in range(3000):
        words = [(rng.choice("suaax"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 14))]
        assert dialogue.least_repair(words, chart) == plain(words), words


def test_chart_equals_every_repair():
    kinds = [("s", None), ("u", None), ("a", None), ("u", "truncated"), ("x", None), ("a", "blank")]
    for n in range(3):
        for words in itertools.product(kinds, repeat=n):
            assert dialogue.least_repair(list(words)) == every(words), words


def test_long_conversations_are_decided_as_they_are_read():
    chart, rng = dialogue.Chart(), random.Random(7)
    words = [("ua"[(k + (k > 4000)) % 2] if rng.random() < 0.9 else "s", rng.choice([None, "truncated"])) for k in range(20_000)]
    column, audit, undecided = chart.first, "", 0
    for word in words:
        _, edits, column = chart.read(column, word)
        audit += edits
        undecided = max(undecided, *(len(item[3]) for item in column))
    assert audit + chart.end(column)[1] == plain(words)[1] and undecided < 200 and len(chart.seen) < 3000


def test_a_small_memory_gives_the_same():
    words = [(c, None) for c in "suauaasuuaxa"]
    assert dialogue.least_repair(words, dialogue.Chart(most=2)) == plain(words)


def test_other_grammars():
    chart = dialogue.Chart((("Goal", ()), ("Goal", ("Talk",)), ("Talk", ("user",)), ("Talk", ("Talk", "user"))))
    assert dialogue.least_repair([("u", None), ("a", None), ("u", "blank")], chart) == (7, "KRD")
    with pytest.raises(ValueError):
        dialogue.Chart((("Goal", ("user", "Goal")),))


def by_hand(rows):
    """The contract's columns for rows (conv_id, turn, role, text), one conversation after the other."""
    out = {}
    text_of = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, fate = text_of(role), text_of(text), zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        words, seen, faults = [], set(), []
        for _, role, text in kept:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            words.append((role[:1], fault))
        cost, audit = plain(words)
        queue, lines, said, opened = list(kept), [], 0, False
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else queue.pop(0)
            if e == "D":
                continue
            if e == "K" and not lines and role[:1] == "s":
                opened = True
            else:
                role = role if e == "K" else ("user", "assistant")[said % 2]
                said += 1
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and opened in (True, False)
        turns = [r[0] for r in kept if r[0] is not None]
        letters = [w[0] for w in words]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + extra)
    told = df.select("conv_id", "turn", "role", "text")
    got = dialogue.with_all(dialogue.repair_report(dialogue.repair(queries.damaged(told))), told).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_report_equals_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why", " \t\n", "", None, "ok? ", "a.b", "é!", "日本。", "x" * 300_000 + "."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], rng.choice(texts)) for conv in range(120) for turn in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in (None, 0, 0, 5)] + [(7, None, None, None), (500, None, "user", "a.")] + [(300 + k % 40, 7 * (k // 40), "assistant", f"{k}.") for k in range(200)]
    rows += rows[:30]  # repeated rows, ties in turn
    assert report(spark, rows) == by_hand(rows)


def test_conversations_across_batches(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t}." if t % 11 else "cut") for c in (1, 2, 3) for t in range(9000)]
    assert report(spark, rows) == by_hand(rows)


def test_steps_tell_what_was_done(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x"), (1, 1, "user", "There.", "x"), (1, 2, "tool", " ", "x")], "conv_id long, turn int, role string, text string, edit string")
    got = [tuple(r) for r in dialogue.repair(df).collect()]
    assert got == [
        (1, 0, "keep", 0, "user", "user", "Hi.", None, 0),
        (1, 1, "rerole", 1, "user", "assistant", "There.", None, 3),
        (1, 2, "delete", 2, "tool", "tool", " ", "blank", 4),
    ]
    lone = spark.createDataFrame([(2, 5, "assistant", "Well")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in dialogue.repair(lone).collect()] == [(2, 0, "delete", 5, "assistant", "assistant", "Well", "truncated", 4)]
    pair = lone.union(spark.createDataFrame([(2, 6, "user", "So?"), (2, 7, "assistant", "So.")], lone.schema))
    assert [(r["edit"], r["role"], r["turn"], r["cost"]) for r in dialogue.repair(pair).collect()] == [("delete", "assistant", 5, 4), ("keep", "user", 6, 0), ("keep", "assistant", 7, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair(none).count() == 0
    assert dialogue.with_all(dialogue.repair_report(dialogue.repair(none)), none).count() == 0


def test_dialogue_equals_sql(spark, duck):
    assert same_rows(queries.op11_dialogue(spark, SF), duck, OP11_SQL) > 10
