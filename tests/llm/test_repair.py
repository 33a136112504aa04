import hashlib
import random
import re
import zlib
from itertools import product

from tidewire.llm import repair

WELL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def every_script(codes):
    """(cost, audit) of every script of at most two inserts a gap: brute force over the products of edits."""
    rows = [("sua-"[c >> 2], c & 3) for c in codes]
    best = None
    inserts = [()] + [(x,) for x in "ua"] + list(product("ua", repeat=2))
    for gaps in product(inserts, repeat=len(rows) + 1):
        for edits in product("KDua", repeat=len(rows)):
            out, audit, cost = "", "", 0
            for i, e in enumerate(edits):
                out, audit, cost = out + "".join(gaps[i]), audit + "I" * len(gaps[i]), cost + 2 * len(gaps[i])
                role, fault = rows[i]
                if e == "D":
                    audit, cost = audit + "D", cost + 3
                    continue
                if fault in (1, 2):
                    cost = None
                    break
                out, audit, cost = out + (role if e == "K" else e), audit + ("K" if e == "K" else "R"), cost + (0 if e == "K" else 2) + (fault == 3)
            if cost is None:
                continue
            out, audit, cost = out + "".join(gaps[-1]), audit + "I" * len(gaps[-1]), cost + 2 * len(gaps[-1])
            if WELL.match(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_is_exhaustive():
    rng = random.Random(2)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        codes = bytes(rng.randrange(4) * 4 + rng.choice([0, 0, 1, 2, 3]) for _ in range(n))
        assert repair.solve(codes) == every_script(codes), codes


def test_chunks_do_not_show():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(4) * 4 + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(14)))
        whole = repair.solve(codes)
        assert {repair.solve(codes, size) for size in (1, 2, 3, 5)} == {whole}


def test_long_conversation():
    rng = random.Random(4)
    codes = bytes(rng.randrange(3) * 4 + rng.choice([0, 0, 0, 3]) for _ in range(30_000))
    cost, audit = repair.solve(codes)
    assert sum(e != "I" for e in audit) == len(codes) and cost > 0


def brute(rows):
    """The contract by plain Python: rows (conv_id, turn, role, text) -> one tuple a conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes = set(), []
        for _, role, text in own:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not inside else 2 if (role, text) in seen else 3 if inside[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(max("sua".find(role[:1] or "-"), -1) % 4 * 4 + fault)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = repair.solve(bytes(codes))
        lines, i, state = [], 0, ""
        for e in audit:
            other = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{other}:")
            else:
                _, role, text = own[i]
                i += 1
                if e == "D":
                    continue
                lines.append(f"{role if e == 'K' else other}:{text}")
            state = lines[-1][0]
        assert WELL.match("".join(x[0] for x in lines))
        kinds = [c & 3 for c in codes]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def told(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS code", "'own' AS audit", "1 AS copy_")
    return sorted((tuple(r) for r in repair.repair(repair.damage(t), t.select("conv_id")).collect()), key=str)


def test_whole_operator(spark):
    rng = random.Random(6)
    words = ["Yes.", "No", "", " \n", None, "Why?", "a longer text that goes on. ", "Yes."]
    rows = [(rng.choice([1, 2, 3, 4, None, 5, 6]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(words)) for _ in range(120)]
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)] + rows[:5]
    rows += [(8, 0, "user", "x" * 300_000 + ".")]
    assert told(spark, rows) == brute(rows)


def test_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert told(spark, [(gone, 0, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert told(spark, []) == []
