import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flankwear.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string"
SP = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        got = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        got += [] if k == 0 else [(t, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        ink = text.strip(SP)
        out.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "k")
        seen.add((role, text))
    return out


def cheapest(rows, fs):
    """Least (cost, audit) by a plain DP over rows and initials, one dict of strings per row: audit and repaired rows.

    States are the initials given so far, folded by what may follow: '', 's', 'u', 'a'."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(states):
        for _ in range(3):
            for q, (c, s, out) in list(states.items()):
                for z in follow[q].replace("s", ""):
                    x = (c + 3, s + "I", [*out, ({"u": "user", "a": "assistant"}[z], "")])
                    if z not in states or x[:2] < states[z][:2]:
                        states[z] = x
        return states

    states = {"": (0, "", [])}
    for (_, role, text), f in zip(rows, fs):
        new = {}
        for q, (c, s, out) in inserts(states).items():
            options = [(c + 4, s + "D", out, q)]
            if f not in "bd":
                more = 3 * (f == "t")
                options += [(c + 3 + more, s + "R", [*out, ({"u": "user", "a": "assistant"}[z], text)], z) for z in follow[q].replace("s", "")]
                if role[:1] and role[0] in follow[q]:
                    options.append((c + more, s + "K", [*out, (role, text)], role[0]))
            for c2, s2, o2, z in options:
                if z not in new or (c2, s2) < new[z][:2]:
                    new[z] = (c2, s2, o2)
        states = new
    return min((v for q, v in inserts(states).items() if q in ("", "a")), key=lambda v: v[:2])


def brute(rows, fs, extra=2):
    """All edit sequences with up to ``extra`` inserts in each gap."""
    best = None
    for ins in itertools.product(range(extra + 1), repeat=len(rows) + 1):
        for ops in itertools.product("KRD", repeat=len(rows)):
            if any(f in "bd" and o != "D" for f, o in zip(fs, ops)):
                continue
            slots = []
            for k, o in enumerate(ops):
                slots += ["I"] * ins[k] + [o + str(k)]
            slots += ["I"] * ins[-1]
            cost = sum(3 if x == "I" else {"K": 0, "R": 3, "D": 4}[x[0]] + (3 if x[0] != "D" and fs[int(x[1:])] == "t" else 0) for x in slots)
            emit = [rows[int(x[1:])][1][:1] if x[0] == "K" else "?" for x in slots if x[0] != "D"]
            s = "".join(x[0] for x in slots)
            if best is not None and (cost, s) >= best:
                continue
            want = ("s" if emit[:1] == ["s"] else "") + "ua" * len(emit)
            if (len(emit) - (emit[:1] == ["s"])) % 2 or (emit == ["s"]):
                continue
            if all(e in ("?", z) for e, z in zip(emit, want)):
                best = (cost, s)
    return best


def expected(rows):
    out = []
    for c, r in damaged(rows).items():
        fs = faults(r)
        cost, audit, fixed = cheapest(r, fs)
        turns = [t for t, *_ in r if t is not None]
        ill = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(r, r[1:]))
        sha = hashlib.sha256("\n".join(f"{x}:{y}" for x, y in fixed).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fs.count("b"), fs.count("d"), fs.count("t"), ill, cost, audit, sha))
    return sorted(out, key=repr)


ROLES = ["user", "assistant", "user", "assistant", "system", "unknown", "", None, "tool", "Assistant"]


def made(n, longest, seed):
    rnd = random.Random(seed)
    texts = ["Fine.", "Good!", "cut off", "", " \n", None, "again.", "What?", "é\U0001F600", "tail. "]
    return [(None if c == 3 else c, None if rnd.random() < 0.05 else t + rnd.choice((0, 0, 0, 1, 5)), rnd.choice(ROLES), rnd.choice(texts) if rnd.random() < 0.4 else f"text {c} {t}.")
            for c in range(n) for t in range(rnd.randint(1, longest))]


def test_matrices_equal_all_edit_sequences():
    rnd = random.Random(5)
    g = rp.Grammar(["su", "ua", "xx", ""])
    for _ in range(60):
        rows = [(k, rnd.choice(["system", "user", "assistant", "tool"]), "x") for k in range(rnd.randint(0, 3))]
        fs = [rnd.choice("bkkt") for _ in rows]
        sym = "".join("x" if f == "b" else (r[1][0] if r[1][0] in "sua" else "o").upper() if f == "t" else (r[1][0] if r[1][0] in "sua" else "o") for r, f in zip(rows, fs))
        state, cost, audit = rp.exit_of(g.of(sym), 0, rp.END)
        got = (cost + rp.END[state], audit + "I" * rp.FINISH[state])
        assert got == brute(rows, fs) == cheapest(rows, fs)[:2]


def test_grammar_changes_no_result():
    rnd = random.Random(6)
    for _ in range(30):
        s = "".join(rnd.choice("suaxUAo") for _ in range(40))
        flat = lambda m: [[c and (c[0], rp.letters(c[1])) for c in row] for row in m]
        assert flat(rp.Grammar([]).of(s)) == flat(rp.Grammar(["ua", "", "xx", "s", "UA"]).of(s))


def test_pairs_count_what_replacing_replaces():
    for s in ("", "a", "aaaa", "aaaaa", "abab", "aabaaab", "xxsuaxx"):
        for p, n in rp.pairs(s).items():
            assert n == s.count(p)


def test_learned_rules(spark):
    df = spark.createDataFrame([("suaua", 5), ("uauaua", 3), ("xx", 1), ("", 9)], "symbols string, n long")
    rules = rp.learn(df)
    assert rules[0] == "ua" and len(rules) <= rp.RULES
    g = rp.Grammar(rules)
    assert len(g.parse("uauaua")) <= 2
    assert rp.learn(df.limit(0)) == []


@pytest.mark.parametrize("part,fan", [(256, 256), (4, 2), (4, 256)])
def test_conversations_equal_loops(spark, part, fan):
    rows = made(40, 9, 1) + [(1000, t, ROLES[t % 4], f"long {t % 50}" + ".?"[t % 2] * (t % 3 > 0)) for t in range(90)]
    rows += [(5000, 2, "user", "Same."), (5000, 2, "user", "Same."), (None, None, None, None)]
    got = rp.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(4), part, fan).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_dropped_conversations_empty_and_clashing(spark):
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame(gone, SCHEMA)
    got = rp.repair_damaged(df.withColumn("gid", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("part", F.lit("x"))).collect()
    assert len(got) == 3
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
    assert rp.repair_damaged(df.limit(0)).collect() == []


def test_query_on_the_table(spark, small):
    from flankwear.llm import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_structure_repair"](spark, small).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
