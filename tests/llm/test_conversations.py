import hashlib
import random
import re
import zlib

import pytest

from hitweave.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seq long, hash string, gone_by string"
NAMES = {"u": "user", "a": "assistant"}
GOAL = re.compile(r"(s?(ua)+)?")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(parts)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Figures of one conversation, with all edit strings compared as strings."""
    messages = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in messages:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in messages]
    turns = [r[1] for r in messages if r[1] is not None]

    best = {"": (0, "", ())}

    def add(found, result, value):
        if GOAL.fullmatch(result) or GOAL.fullmatch(result + "a") or result == "s":
            state = "" if result == "" else "s" if result == "s" else result[-1]
            if state not in found or value[:2] < found[state][:2]:
                found[state] = value

    def insertions(best):
        for _ in range(3):
            found = dict(best)
            for state, (cost, letters, lines) in best.items():
                for r in "ua":
                    add(found, state + r if state != "a" else "ua" + r, (cost + 3, letters + "I", (*lines, (NAMES[r], ""))))
            best = found
        return best

    for (_, _, role, text), code, initial in zip(messages, faults, initials, strict=True):
        found = {}
        for state, (cost, letters, lines) in insertions(best).items():
            full = {"a": "ua", "u": "u"}.get(state, state)
            add(found, full, (cost + 4, letters + "D", lines))
            if code not in ("blank", "duplicate"):
                more = 3 * (code == "truncated")
                if initial in ("s", "u", "a"):
                    add(found, full + initial, (cost + more, letters + "K", (*lines, (role, text))))
                for r in "ua":
                    add(found, full + r, (cost + 3 + more, letters + "R", (*lines, (NAMES[r], text))))
        best = found
    cost, letters, lines = min((v for k, v in insertions(best).items() if k in ("", "a")), key=lambda v: v[:2])
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, letters,
        hashlib.sha256(text.encode()).hexdigest(),
    )


def expected(rows, ids=None):
    groups = {i: [] for i in (ids if ids is not None else {r[0] for r in rows})}
    for r in rows:
        groups[r[0]].append(r)
    return {k: brute(v) for k, v in groups.items()}


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def some_rows(seed, convs=150, most=9):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "three", "four ", "", " \t", "Why?\n", "é漢 .", "five. x"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "u", "ape"] if seed % 2 else ["user", "assistant", "user", "assistant", "system"])
            t = rng.choice([turn, turn, turn, None, 3])
            rows.append((conv if conv else None, t, role, rng.choice([*texts, None])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rows = some_rows(seed)
    plain = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    assert got(c.audit(table(spark, rows))) == expected(plain)


def test_damage_and_conversations_that_lose_all(spark):
    rows = some_rows(7, 400, 4)
    out = got(c.audit(c.damage(table(spark, rows))))
    want = expected(damaged(rows), {r[0] for r in rows})
    assert out == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in out.values()


def test_state_goes_across_batches_and_to_the_spool_file(spark):
    rng = random.Random(1)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(900)} text" + rng.choice([".", ".", ""])) for i in range(3000)]
    rows += [(2, None, "user", f"{i}.") for i in range(500)] + [(3, 1, "user", "a."), (3, 2, "assistant", "b.")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        out = got(c.audit(table(spark, rows), most=5000))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == expected(rows)
    assert got(c.audit(table(spark, rows))) == out


def test_steps_stay_few():
    rng = random.Random(2)
    steps, state = c.Steps(), c.START
    for _ in range(200_000):
        state, _k = steps.take(state, rng.choice("suatx"), rng.choice([0, 0, 1, 2, 3]))
    assert len(steps.steps) < 5000


def test_repaired_messages(spark):
    rows = [(5, 0, "system", "S."), (5, 1, "user", "Q?"), (5, 1, "user", "Q?"), (5, 2, "assistant", "A"), (5, 4, "tool", "T."), (6, 0, "user", " ")]
    out = c.repaired(table(spark, rows)).orderBy("conv_id", "seq")
    assert [(r.conv_id, r.edit, r.turn, r.fault, r.role, r.text) for r in out.collect()] == [
        (5, "K", 0, "", "system", "S."), (5, "K", 1, "", "user", "Q?"), (5, "R", 4, "", "assistant", "T."),
    ]
    assert got(c.audit(table(spark, rows)))[5][:-1] == (1, 0, 1, 1, 2, 11, "KKDDR")


def test_long_text_and_hot_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "word " * 3000 + ".") for i in range(400)]
    rows += [(2, i, "user", "again.") for i in range(3000)] + [(3, 0, "user", "x" * 3_000_000), (4, 0, "user", "\n" * 1_000_000)]
    out = got(c.audit(table(spark, rows), most=1 << 20))
    assert out == expected(rows)


def test_empty_table(spark):
    assert got(c.audit(c.damage(table(spark, [], 1)))) == {}
    assert c.repaired(table(spark, [], 1)).columns == ["conv_id", "seq", "edit", "turn", "was", "fault", "role", "text"]
