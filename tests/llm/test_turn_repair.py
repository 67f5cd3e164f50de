"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from communitylens.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies int, conv string"


def brute(rows):
    """(cost, audit, lines) of the cheapest edit, by a search over all of them."""
    ini = [r[0][:1] for r in rows]
    best = None
    stack = [(0, 0, "", "", ())]
    seen = {}
    while stack:
        i, cost, out, audit, lines = stack.pop()
        key = (i, out[-1:] if out else "", bool(out))
        if best is not None and cost > best[0]:
            continue
        if seen.get(key, (1 << 30, "")) < (cost, audit):
            continue
        seen[key] = (cost, audit)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        nxt = "a" if out.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}
        if not audit.endswith("II"):
            stack.append((i, cost + 5, out + nxt, audit + "I", lines + (name[nxt] + ":",)))
        if i < len(rows):
            role, text, fault = rows[i]
            stack.append((i + 1, cost + 2, out, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if ini[i] == nxt or (ini[i] == "s" and not out):
                    stack.append((i + 1, cost + more, out + ini[i], audit + "K", lines + (f"{role}:{text}",)))
                if ini[i] != nxt:
                    stack.append((i + 1, cost + 1 + more, out + nxt, audit + "R", lines + (f"{name[nxt]}:{text}",)))
    return best


def reports(data):
    """conv_id -> the contract's columns, row by row."""
    convs = {}
    for c, t, r, x, *_ in data:
        r, x = (" " if r is None else r), (" " if x is None else x)
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs.setdefault(c, [])
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        convs[c] += [(t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, marked, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for t, r, x in rows:
            body = x.strip(" \t\n\v\f\r")
            f = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            marked.append((r, x, f))
            if f:
                n[f] += 1
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = brute(marked)
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", "  \n", "What now? ", "é ç.", None, "long " * 30 + "."]
    for c in range(n):
        for t in range(rng.randint(1, most)):
            role = rng.choices(["user", "assistant", "system", "tool", None, "", "unknown"], [8, 8, 2, 1, 1, 1, 1])[0]
            if rng.random() < .5:
                role = ["user", "assistant"][t % 2]
            turn = None if rng.random() < .05 else t + rng.randint(0, 1)
            yield c, turn, role, rng.choice(texts) if rng.random() < .4 else f"text {rng.randint(0, 30)}.", "x", 3, "y"


def got(spark, data, block_rows):
    turns = tr.read_turns(spark.createDataFrame(data, SCHEMA).repartition(3))
    rows = tr.repair(tr.damage(turns), convs=turns, block_rows=block_rows).collect()
    assert len(rows) == len({r.conv for r in rows})
    return {r.conv: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("block_rows", [32, 3])
def test_equals_exhaustive_search(spark, block_rows):
    data = list(conversations(1, 120, 9)) + [(None, None, None, None, None, None, None), (None, 1, "user", "Hi.", "", 1, ""),
                                             (None, 1, "user", "Hi.", "", 1, ""), (77_000, 3, "assistant", "w" * 300_000 + ".", "", 1, "")]
    assert got(spark, data, block_rows) == reports(data)


def test_long_conversation_in_many_blocks(spark):
    data = [(5, t, ["user", "assistant"][(t + t // 37) % 2], f"turn {t}" + ("" if t % 11 == 0 else "."), "", 1, "") for t in range(1500)]
    data += [(6, 4, "user", "same words.", "", 1, "")] * 500  # one group of equal rows
    turns = tr.read_turns(spark.createDataFrame(data, SCHEMA))
    found = {r.conv: r for r in tr.audits(turns, block_rows=16).collect()}
    whole = {r.conv: r for r in tr.audits(turns.where("conv = 6"), block_rows=4000).collect()}
    assert found[6] == whole[6] and found[6].audit in ("D" * 500, "K" + "D" * 499 + "I") and found[6].duplicate == 499
    # the same by a running minimum over the grammar's states
    state = {"0": (0, "")}
    nxt = {"0": "u", "u": "a", "a": "u"}
    for _, t, role, text, *_ in data[:1500]:
        after = {}
        more = 0 if text.endswith(".") else 5

        def put(q, v):
            if q not in after or v < after[q]:
                after[q] = v
        for p, (cost, audit) in state.items():
            put(p, (cost + 2, audit + "D"))
            for k in (0, 1):
                q = nxt[nxt[p]] if k else nxt[p]
                put(q, (cost + 5 * k + more + (role[0] != q), audit + "I" * k + ("K" if role[0] == q else "R")))
        state = after
    best = min([state["0"], state["a"], (state["u"][0] + 5, state["u"][1] + "I")])
    assert (found[5].cost, found[5].audit) == best


def test_band_drops_nothing():
    rng = random.Random(3)
    for _ in range(150):
        code = " ".join(rng.choice("suax") + rng.choice("kktd") + str(rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 6)))
        (_, _, cost, audit), = tr.block_table(code, True, True)
        rows = []
        for initial, kind, n in tr._units(code):
            role = {"s": "system", "u": "user", "a": "assistant", "x": "x"}[initial]
            rows += [(role, str(len(rows)), {"d": "blank", "t": "truncated", "k": None}[kind])] * n
        assert (cost, audit) == brute(rows)[:2]


def test_repaired_turns_follow_the_grammar(spark):
    turns = tr.read_turns(spark.createDataFrame(list(conversations(2, 40, 12)), SCHEMA))
    rows = tr.repaired_turns(turns, block_rows=4).orderBy("conv", "place").collect()
    for _, g in itertools.groupby(rows, key=lambda r: r.conv):
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in g))


def test_empty_table(spark):
    turns = tr.read_turns(spark.createDataFrame([], SCHEMA))
    assert tr.repair(tr.damage(turns), convs=turns).count() == 0 and tr.repaired_turns(turns).count() == 0
    gone = [(c, 0, "user", "Hi.", "", 1, "") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    assert set(got(spark, gone, 32).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
