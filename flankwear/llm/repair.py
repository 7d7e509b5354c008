"""Repair of conversation structure: grammar-compressed dynamic programming over role/fault sequences.

A row is one of nine symbols: its role's initial (s, u, a or any other) with a whole or a truncated text, or a
row that has to go (blank, or role and text seen earlier).  The cheapest edits (keep, re-role, delete, insert)
that turn a conversation into ``(s?(ua)+)?`` are a path through four states, so a symbol is a 4 x 4 matrix in
the min-plus semiring whose cells hold a cost and the edits' initials; products take the least cost, ties the
ASCII-least initials.  (Letters of equal cost are never a prefix of one another: a longer one would have more
inserts; so the order survives products.)

1. Turns are numbered per conversation by a range sort (one conversation may hold any share of all rows) and
   cut into parts of ``PART`` turns.  First occurrences come from one aggregation by role and text hash.
2. Re-Pair runs over the distinct symbol sequences of parts, counted over the corpus: every round counts
   adjacent pairs in Spark, makes the most frequent ones rules, and replaces them everywhere; at most ``RULES``
   rules leave the driver.  Every rule has one matrix, the product of its two halves, whose cells hold the
   audit as a rope of the halves' ropes; a sequence is the product of the few symbols left.  The number of
   rules only changes the work, never a result.
3. Parts of long conversations meet in two scans over trees of ``FAN`` parts a task: matrices upwards and
   costs to go downwards, then state maps upwards and entry states downwards.  Every part then knows where it
   starts and what follows it, and renders its repaired rows by itself.

Defined results: null role and text count as one space; null turns come first; equal turns are ordered by role
and text; a null conv_id is a conversation like any other; a conversation without rows left has no edits;
repeated rows are turns of their own (the second one is a duplicate); extra columns are left out.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import slices, stage
from flankwear.operators.ordering import with_position

PART = 64                 # turns of a part
FAN = 256                 # parts of a block in the scans
RULES, ROUNDS, BATCH = 128, 8, 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing, system, user, assistant; what a row that is not kept as it is becomes from each of them.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: Inserts that end a conversation from each state.
FINISH = (0, 2, 1, 0)

Rope = str | tuple
Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def letters(rope: Rope) -> str:
    """The string of a rope."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += [x[1], x[0]]
    return "".join(out)


def _best(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if letters(a[1]) <= letters(b[1]) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    """Product in the min-plus semiring; audits become ropes of both factors' audits."""
    out: Matrix = []
    for q in range(4):
        row: list[Cell] = []
        for r in range(4):
            cell: Cell = None
            for k in range(4):
                x, y = a[q][k], b[k][r]
                if x is not None and y is not None and (cell is None or x[0] + y[0] <= cell[0]):
                    cell = _best(cell, (x[0] + y[0], (x[1], y[1])))
            row.append(cell)
        out.append(row)
    return out


UNIT: Matrix = [[(0, "") if q == r else None for r in range(4)] for q in range(4)]


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then the edit of one row: ``x`` has to go; capitals are truncated rows."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    more = TRUNCATED if symbol.isupper() else 0
    for q in range(4):
        at = q
        for n in range(3):                                    # a third insert only repeats a state
            edits = [(DELETE, "D", at)]
            if symbol != "x":
                edits.append((REROLE + more, "R", NEXT[at]))
                if at in KEEPS[symbol.lower()]:
                    edits.append((KEEP + more, "K", KEEPS[symbol.lower()][at]))
            for cost, letter, to in edits:
                out[q][to] = _best(out[q][to], (n * INSERT + cost, "I" * n + letter))
            at = NEXT[at]
    return out


class Grammar:
    """Re-Pair rules (a pair of symbols each, in order) with the matrix of every symbol."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = rules
        self.matrix = {s: symbol_matrix(s) for s in "xsuaoSUAO"}
        for k, pair in enumerate(rules):
            self.matrix[self.name(k)] = times(self.matrix[pair[0]], self.matrix[pair[1]])
        self.known: dict[str, Matrix] = {}

    @staticmethod
    def name(k: int) -> str:
        return chr(0xE000 + k)

    def parse(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, self.name(k))
        return symbols

    def of(self, symbols: str) -> Matrix:
        """Matrix of a sequence; sequences met before in this task are shared."""
        if symbols not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            out = UNIT
            for s in self.parse(symbols):
                out = times(out, self.matrix[s])
            self.known[symbols] = out
        return self.known[symbols]


def pairs(symbols: str) -> dict[str, int]:
    """Adjacent pairs of a sequence; a run of one symbol counts its disjoint pairs."""
    out: dict[str, int] = {}
    last = -2
    for k in range(len(symbols) - 1):
        p = symbols[k:k + 2]
        if p[0] == p[1] and last == k - 1 and symbols[k - 1] == p[0]:
            continue
        last = k
        out[p] = out.get(p, 0) + 1
    return out


def learn(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> list[str]:
    """Re-Pair over sequences (symbols, n: how often each occurs).  A round turns its most frequent pairs (up to
    ``BATCH``, each at least half as frequent as the first) into rules; ties by the pair itself."""
    out: list[str] = []
    for _ in range(rounds):
        def count(batches: Iterator[pd.DataFrame], have: tuple[str, ...] = tuple(out)) -> Iterator[pd.DataFrame]:
            g, total = Grammar(list(have)), {}
            for b in batches:
                for s, n in zip(b["symbols"], b["n"]):
                    for p, k in pairs(g.parse(s)).items():
                        total[p] = total.get(p, 0) + k * int(n)
            yield pd.DataFrame({"pair": list(total), "k": list(total.values())}).astype({"pair": str, "k": "int64"})

        best = (sequences.mapInPandas(count, "pair string, k long").groupBy("pair").agg(F.sum("k").alias("k"))
                .where("k > 1").orderBy(F.desc("k"), "pair").limit(BATCH).collect())
        new = [r["pair"] for r in best if 2 * r["k"] >= best[0]["k"]][:rules - len(out)]
        out += new
        if not new:
            break
    return out


def scan(parts: DataFrame, combine: Callable[[list], list], spread: Callable[[list, list], list], start: list[int],
         last: int, fan: int = FAN) -> DataFrame:
    """Bounds of ordered parts (gid, part, value) from an associative ``combine``: blocks of ``fan`` parts are combined
    upwards until a group has one, then ``spread`` turns a block's bound into its parts' bounds downwards.
    ``last`` is the largest part number; a group at the top has the bound ``start``."""
    block = F.floor(F.col("part") / fan).cast("long").alias("block")
    kids = parts.select("gid", "part", "value", block)

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = [list(map(int, v)) for v in rows.sort_values("part")["value"]]
        return pd.DataFrame({"gid": [key[0]], "part": [int(key[1])], "value": [combine(values)]})

    if last < fan:
        above = kids.select(F.col("gid").alias("of"), F.col("block").alias("at")).distinct().select("of", "at", F.array(*map(F.lit, start)).cast("array<long>").alias("bound"))
    else:
        over = stage(kids.groupBy("gid", "block").applyInPandas(up, "gid string, part long, value array<long>"))
        above = scan(over, combine, spread, start, last // fan, fan).select(F.col("gid").alias("of"), F.col("part").alias("at"), "bound")

    def down(rows: pd.DataFrame, bound: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        values = [list(map(int, v)) for v in rows["value"]]
        return pd.DataFrame({"gid": rows["gid"], "part": rows["part"], "bound": spread(values, list(map(int, bound["bound"].iloc[0])))})

    return stage(kids.groupBy("gid", "block").cogroup(above.groupBy("of", "at"))
                 .applyInPandas(down, "gid string, part long, bound array<long>"))


def _costs_product(values: list[list[int]]) -> list[int]:
    out = np.array(values[0]).reshape(4, 4)
    for v in values[1:]:
        out = np.minimum((out[:, :, None] + np.array(v).reshape(4, 4)[None]).min(axis=1), INF)
    return out.ravel().tolist()


def _costs_to_go(values: list[list[int]], end: list[int]) -> list[list[int]]:
    out = [list(end)]
    for v in reversed(values[1:]):
        out.append(np.minimum((np.array(v).reshape(4, 4) + np.array(out[-1])[None]).min(axis=1), INF).tolist())
    return out[::-1]


def _map_product(values: list[list[int]]) -> list[int]:
    out = [0, 1, 2, 3]
    for v in values:
        out = [v[s] for s in out]
    return out


def _entries(values: list[list[int]], first: list[int]) -> list[list[int]]:
    out = [list(first)]
    for v in values[:-1]:
        out.append([v[out[-1][0]]])
    return out


def exit_of(m: Matrix, entry: int, to_go: list[int]) -> tuple[int, int, str]:
    """State after a part entered at ``entry``, and the cost and audit of the way there, given the costs from each state on."""
    cost, audit, state = min((m[entry][r][0] + to_go[r], letters(m[entry][r][1]), r)
                             for r in range(4) if m[entry][r] is not None and to_go[r] < INF)
    return state, cost - to_go[state], audit


END = [INSERT * n for n in FINISH]


def render(rows: list[dict], audit: str, state: int) -> tuple[list[dict], int]:
    """Repaired rows of a part by its audit, and the state behind them."""
    out, at = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEPS[row["role"][0]][state]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": row["text"] if row else ""})
    return out, state


def parts_of(turns: DataFrame, part: int = PART) -> tuple[DataFrame, int]:
    """Parts (gid, conv_id, part, symbols, rows) of conversations (conv_id, turn, role, text, gone) and the largest part
    number.  Rows that are ``gone`` only say that the conversation exists."""
    base = turns.withColumn("gid", F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0")))
    rows = stage(with_position(base, ["gid"], ["turn", "role", "text"], "pos"))
    cut = F.floor(F.col("pos") / part).cast("long").alias("part")
    first = (rows.where(~F.col("gone")).groupBy("gid", "role", F.sha2("text", 256).alias("h"))
             .agg(F.min("pos").alias("pos"), F.first("conv_id").alias("conv_id")))
    row = F.struct("pos", "gone", "turn", "role", "text")
    both = rows.select("gid", "conv_id", cut, row.alias("row"), F.lit(None).cast("long").alias("first")).unionByName(
        first.select("gid", "conv_id", cut, F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("row"),
                     F.col("pos").alias("first")))
    each = both.groupBy("gid", "conv_id", "part").agg(                                                  # 2 * part at most
        F.array_sort(F.filter(F.collect_list("row"), lambda x: ~x["gone"])).alias("rows"), F.collect_list("first").alias("first"))

    def fault(x: Column) -> Column:
        ink = F.btrim(x["text"], F.lit(SPACE))
        return (F.when(ink == "", F.lit("b")).when(~F.array_contains("first", x["pos"]), F.lit("d"))
                .when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), F.lit("t")).otherwise(F.lit("k")))

    seen = each.withColumn("rows", F.transform("rows", lambda x: F.struct(x["turn"], x["role"], x["text"], fault(x).alias("fault"))))
    initial = lambda x: F.when(F.left(x["role"], F.lit(1)).isin("s", "u", "a"), F.left(x["role"], F.lit(1))).otherwise(F.lit("o"))
    symbol = lambda x: (F.when(x["fault"].isin("b", "d"), F.lit("x")).when(x["fault"] == "t", F.upper(initial(x)))
                        .otherwise(initial(x)))
    out = stage(seen.select("gid", "conv_id", "part", F.array_join(F.transform("rows", symbol), "").alias("symbols"), "rows"))
    return out, out.agg(F.max("part")).first()[0] or 0


def repair(turns: DataFrame, part: int = PART, rules: int = RULES, fan: int = FAN) -> DataFrame:
    """Repaired parts of conversations (conv_id, turn, role, text, gone): gid, conv_id, part, rows (with their first
    faults: b blank, d duplicate, t truncated, k none), cost, audit and repaired rows.  Joined in order of ``part`` they
    are the conversation; the last part holds the inserts at its end."""
    parts, last = parts_of(turns, part)
    grammar = learn(stage(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))), rules)
    long_ones = None
    if last:
        long_ones = parts.join(parts.where("part > 0").select("gid").distinct(), "gid", "left_semi")

        def valued(of: Callable[[Grammar, dict], list[int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
            def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                g = Grammar(grammar)
                for b in batches:
                    yield b[["gid", "part"]].assign(value=[of(g, r) for r in b.to_dict("records")])
            return values

        kind = "gid string, part long, value array<long>"
        flat = valued(lambda g, r: [c[0] if c else INF for row in g.of(r["symbols"]) for c in row])
        to_go = scan(long_ones.select("gid", "part", "symbols").mapInPandas(flat, kind), _costs_product, _costs_to_go, END, last, fan)
        both = long_ones.select("gid", "part", "symbols").join(to_go, ["gid", "part"])
        step = valued(lambda g, r: [exit_of(g.of(r["symbols"]), q, list(map(int, r["bound"])))[0] for q in range(4)])
        entry = scan(both.mapInPandas(step, kind), _map_product, _entries, [0], last, fan)
        bounds = to_go.select("gid", "part", F.col("bound").alias("to_go")).join(entry.select("gid", "part", F.col("bound")[0].alias("entry")), ["gid", "part"])
        parts = parts.join(bounds, ["gid", "part"], "left")
    else:
        parts = parts.select("*", F.lit(None).cast("array<long>").alias("to_go"), F.lit(None).cast("long").alias("entry"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(grammar)
        for b in (s for x in batches for s in slices([x], 50)):
            cost, audits, repaired = [], [], []
            for symbols, rows, to_go, entry, more in zip(*[b.column(c).to_pylist() for c in ("symbols", "rows", "to_go", "entry", "more")]):
                state, n, audit = exit_of(g.of(symbols), entry or 0, to_go or END)
                tail = 0 if more else FINISH[state]
                out, _ = render(rows, audit + "I" * tail, entry or 0)
                cost.append(n + tail * INSERT)
                audits.append(audit + "I" * tail)
                repaired.append(out)
            kept = b.select(["gid", "conv_id", "part", "rows"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cost, pa.int64()), pa.array(audits, pa.string()),
                 pa.array(repaired, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
                names=[*kept.schema.names, "cost", "audit", "repaired"])

    if last:
        ends = parts.groupBy("gid").agg(F.max("part").alias("end"))
        parts = parts.join(ends.where("end > 0"), "gid", "left").withColumn("more", F.col("part") < F.coalesce("end", F.lit(0)))
    else:
        parts = parts.withColumn("more", F.lit(False))
    return parts.mapInArrow(finish, _parts_schema(parts))


def _parts_schema(parts: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in parts.schema}
    return (f"gid string, conv_id {kind['conv_id']}, part long, rows {kind['rows']}, cost long, audit string, "
            "repaired array<struct<role:string,text:string>>")


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage by the CRC-32 of ``conv_id:turn``; dropped rows stay as ``gone``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
                        (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation: gaps, fault counts, illegal neighbours, cost, audit and the repaired text's SHA-256.

    A hash goes through a text from front to back, so a conversation's parts pass one task in order; what the task holds
    of it is the hash's state, the counters and the audit (which is a value of the result)."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = got = None

        def done() -> list[dict]:
            if got is None:
                return []
            turns = got["turns"]
            return [{"conv_id": got["conv_id"], "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, "blank": got["b"],
                     "duplicate": got["d"], "truncated": got["t"], "illegal": got["illegal"], "cost": got["cost"],
                     "audit": "".join(got["audit"]), "repaired_sha256": got["sha"].hexdigest()}]

        for b in (s for x in batches for s in slices([x], 50)):
            out: list[dict] = []
            for r in b.to_pylist():
                if gid != r["gid"]:
                    out += done()
                    gid = r["gid"]
                    got = {"conv_id": r["conv_id"], "turns": None, "b": 0, "d": 0, "t": 0, "k": 0, "illegal": 0, "last": None,
                           "cost": 0, "audit": [], "sha": hashlib.sha256(), "begun": False}
                for x in r["rows"]:
                    got[x["fault"]] += 1
                    t, seen = x["turn"], got["turns"]
                    if t is not None:
                        got["turns"] = (t, t, 1) if seen is None else (seen[0], t, seen[2] + (t != seen[1]))
                    if got["last"] is not None and got["last"] + x["role"][:1] not in ("su", "ua", "au"):
                        got["illegal"] += 1
                    got["last"] = x["role"][:1]
                got["cost"] += r["cost"]
                got["audit"].append(r["audit"])
                lines = "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"])
                if r["repaired"]:
                    got["sha"].update((("\n" if got["begun"] else "") + lines).encode())
                    got["begun"] = True
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(done(), schema)

    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", _arrow(kind)), *[(c, pa.int64()) for c in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ordered = parts.repartition("gid").sortWithinPartitions("gid", "part")
    return ordered.mapInArrow(stream, f"conv_id {kind}, {', '.join(f'{c} long' for c in longs)}, audit string, repaired_sha256 string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repair_damaged(turns: DataFrame, part: int = PART, fan: int = FAN) -> DataFrame:
    """Every original conversation after damage and repair."""
    return digest(repair(damage(turns), part, fan=fan))
