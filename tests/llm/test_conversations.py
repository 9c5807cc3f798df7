"""Repair of conversations against a forward search over (cost, audit), with the edge cases of the operator."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from curvetrail.llm import conversations as cv

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = {"0": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
LEGAL = {"0": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, faults):
    """(cost, audit, turns) by dynamic programming over states, letter by letter."""

    def inserted(states):
        changed = True
        while changed:
            changed = False
            for s, (role, to) in ROLES.items():
                if s in states:
                    cost, audit, turns = states[s]
                    new = (cost + 2, audit + "I", (*turns, role + ":"))
                    if to not in states or new[:2] < states[to][:2]:
                        states[to], changed = new, True
        return states

    states = inserted({"0": (0, "", ())})
    for (role, text), fault in zip(rows, faults):
        after = {}

        def put(s, value):
            if s not in after or value[:2] < after[s][:2]:
                after[s] = value

        for s, (cost, audit, turns) in states.items():
            put(s, (cost + 3, audit + "D", turns))
            if fault in ("b", "d"):
                continue
            extra = int(fault == "t")
            if role[:1] and role[:1] in LEGAL[s]:
                put(role[:1], (cost + extra, audit + "K", (*turns, f"{role}:{text}")))
            new, to = ROLES[s]
            put(to, (cost + 2 + extra, audit + "R", (*turns, f"{new}:{text}")))
        states = inserted(after)
    return min((states[s] for s in "0a" if s in states), key=lambda v: v[:2])


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, kept = cheapest([r[1:] for r in own], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["", "t", "d"])), max_size=9), st.integers(0, 9))
def test_walk_is_the_cheapest_and_least(rows, cut):
    """One segment, and two segments chained by their tables, against the search."""
    rows = [(role, f"x{i}", 1, fault) for i, (role, fault) in enumerate(rows)]
    cost, audit, turns = cheapest([r[:2] for r in rows], [r[3] for r in rows])
    graph = cv.Graph(rows)
    dist = graph.distances(cv.AT_END)
    got, _ = graph.walk(dist, cv.START, True)
    assert (dist[0][cv.START] + graph.forced, got, tuple(cv.repaired(rows, got, cv.START))) == (cost, audit, turns)
    one, two = cv.Graph(rows[:cut]), cv.Graph(rows[cut:])
    table = two.chain()
    after = tuple(min(table[4 * s + t] + cv.AT_END[t] for t in range(4)) for s in range(4))
    head, state = one.walk(one.distances(after), cv.START, False)
    tail, _ = two.walk(two.distances(cv.AT_END), state, True)
    table = one.chain()
    assert head + tail == audit and min(table[t] + after[t] for t in range(4)) == cost


def conversations(rng):
    texts = [None, "", " ", "hi", "hi.", "ok!", "\t\n", "yes?", "é", "  no. "]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = []
    for c in range(120):
        for t in range(rng.randrange(0, 14)):
            turn = rng.choice([None, t, t, t, t - 1]) if rng.random() < 0.3 else t
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {t}."))
    rows += [(500, t, ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles), f"m{rng.randrange(200)}" + rng.choice(".! ")) for t in range(400)]
    rows += [(501, 7, "user", "same.")] * 50 + [(None, None, None, None)] * 3 + [(502, -(1 << 63), "user", "a."), (502, (1 << 63) - 1, "assistant", "b."), (503, 1, "user", "long " * 20_000)]
    return rows


def test_repair(spark):
    """Conversations of one segment and of many, a long one, repeated rows, null ids, turns, roles and texts."""
    rows = conversations(random.Random(3))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, mark string").repartition(5)
    want = plain(rows)
    want[502] = ((1 << 64) - 2 if want[502][0] >= 1 << 63 else want[502][0], *want[502][1:])
    for size in (4096, 3):
        got = {}
        for r in cv.repair(cv.damaged(df), size).collect():
            assert r.conv_id not in got
            got[r.conv_id] = tuple(r)[1:]
        assert got.pop(502) == (None if want[502][0] >= 1 << 63 else want[502][0], *want[502][1:])
        assert got == {k: v for k, v in want.items() if k != 502}
    assert cv.repair(cv.damaged(df.where("false"))).count() == 0
