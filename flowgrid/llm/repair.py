"""Conversation structure repair: the cheapest edits that give every conversation an optional system turn and whole user/assistant pairs.

A conversation becomes a string of signs, one for each row: its role's initial, whether the text breaks off, and whether the
row has to go. Strings are shared from their ends: sorted by their reverse, equal suffixes follow each other, and a suffix is a
node of the automaton that is worked out once for all conversations that end in it. A node keeps, for each state of the
grammar, the cost of the cheapest edits from there on and the first of them, so the best audit is read off node by node.

Conversations of any length are cut into blocks of ``BLOCK`` rows. A block's costs between states are small tables; scanned
from a conversation's end they give the costs behind each block, and with those a block's edits follow as those of a
whole conversation do.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import materialize, pick

#: Rows of a conversation that share one string of signs.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Characters that don't count as text.
WHITE = " \t\n\x0b\x0c\r"

# States of the grammar (s?(ua)+)?: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What follows by Insert or Rerole, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(EMPTY, "s"): SYSTEM} | {(q, "u"): USER for q in (EMPTY, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
#: Inserts that are left at the end, and their cost.
TAIL = (0, 2, 1, 0)
END = tuple(INSERT * n for n in TAIL)
FAR = 1 << 50

_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` picks; nulls read as one space.

    Remainders of 20: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it (copy 1), 4 makes it a user's.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = pick(turns, "conv_id", "turn", "role", "text").withColumn("kind", kind).filter(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _signs(rows: DataFrame) -> DataFrame:
    """``rows`` with a sign: b blank, d seen at an earlier turn, else the role's initial (o for others), upper case if the text breaks off."""
    text = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    closed = F.substring(text, -1, 1).isin(".", "!", "?")
    keyed = rows.withColumns({"k0": F.xxhash64("text"), "k1": F.xxhash64(F.lit(1), "text"), "at": F.struct("turn")})
    # Blank texts need no search for earlier ones; a struct puts a null turn first.
    firsts = keyed.filter(text != "").groupBy("conv_id", "role", "k0", "k1").agg(F.min("at").alias("first"))
    f = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("k0").alias("i"), F.col("k1").alias("j"), "first")
    both = keyed.join(f, keyed["conv_id"].eqNullSafe(f["c"]) & (keyed["role"] == f["r"]) & (keyed["k0"] == f["i"]) & (keyed["k1"] == f["j"]), "left")
    sign = F.when(text == "", "b").when(F.col("at") > F.col("first"), "d").when(closed, plain).otherwise(F.upper(plain))
    return both.select("conv_id", "turn", "role", "text", "copy", sign.alias("sign"))


def _numbered(batches):
    """Rows in order with their place (``part``, ``nth`` in the part and conversation); an equal neighbour in front makes a duplicate."""
    from pyspark import TaskContext

    part, before, conv, nth = TaskContext.get().partitionId(), None, (), 0
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "sign"))))
        signs, places = [], []
        for row in rows:
            nth = nth + 1 if conv == row[:1] else 0
            conv = row[:1]
            signs.append("d" if row[4] != "b" and row[:4] == before else row[4])
            before = row[:4]
            places.append(nth)
        kept = [b.column(c) for c in ("conv_id", "turn", "role", "text")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(signs, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(places, pa.int64())], ["conv_id", "turn", "role", "text", "sign", "part", "nth"])


@lru_cache(maxsize=1 << 16)
def _step(sign: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple]:
    """The node in front of one with costs ``after``: its least cost, the costs above that, and each state's edit and next state."""
    cost, edits = [], []
    broken, initial = sign.isupper(), sign.lower()
    for q in range(4):
        found = [(DELETE + after[q], "D", q)]
        if initial != "x":
            extra = TRUNCATED * broken
            if (q, initial) in KEPT:
                found.append((KEEP + extra + after[KEPT[q, initial]], "K", KEPT[q, initial]))
            found.append((REROLE + extra + after[NEXT[q]], "R", NEXT[q]))
        edits.append(found)
        cost.append(min(found)[0])
    for _ in range(3):  # no state is worth more than three inserts
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    for q, found in enumerate(edits):
        found.append((INSERT + cost[NEXT[q]], "I", NEXT[q]))
    least = min(cost)
    best = tuple(min(e[1:] for e in found if e[0] == cost[q]) for q, found in enumerate(edits))
    return least, tuple(min(c - least, FAR) for c in cost), best


class _Path:
    """The nodes of one string of signs, from its end; the next string reuses those of the suffix that both have."""

    def __init__(self, ends: tuple[int, ...]):
        self.signs, self.nodes = "", [(0, ends, None)]

    def follow(self, reverse: str) -> None:
        same = next((k for k, (x, y) in enumerate(zip(self.signs, reverse)) if x != y), min(len(self.signs), len(reverse)))
        del self.nodes[same + 1 :]
        for sign in reverse[same:]:
            base, after, _ = self.nodes[-1]
            least, costs, edits = _step(sign, after)
            self.nodes.append((base + least, costs, edits))
        self.signs = reverse

    def costs(self) -> list[int]:
        base, costs, _ = self.nodes[-1]
        return [base + c if c < FAR // 2 else FAR for c in costs]

    def audit(self, state: int) -> tuple[str, int]:
        """The edits from ``state`` on and the state they end in."""
        done, k = [], len(self.nodes) - 1
        while k:
            edit, state = self.nodes[k][2][state]
            done.append(edit)
            k -= edit != "I"
        return "".join(done), state


def _tables(batches):
    """For each string of signs its least costs from each state to each state."""
    paths = [_Path(tuple(0 if q == e else FAR for q in range(4))) for e in range(4)]
    for b in batches:
        out = []
        for reverse in b.column("reverse").to_pylist():
            for p in paths:
                p.follow(reverse)
            out.append([c for p in paths for c in p.costs()])
        yield pa.RecordBatch.from_arrays([b.column("reverse"), pa.array(out, pa.list_(pa.int64()))], ["reverse", "costs"])


def _ends(batches):
    """Blocks from the last of a conversation to its first: the costs behind each, over their least, and the cost from its start."""
    conv, behind = (), END
    for b in batches:
        ends, cost = [], []
        for c, table in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist()):
            if conv != (c,):
                conv, behind = (c,), END
            least = min(behind)
            ends.append([x - least for x in behind])
            behind = tuple(min(FAR, *(table[4 * e + q] + behind[e] for e in range(4))) for q in range(4))
            cost.append(behind[EMPTY])
        kept = [b.column(c) for c in ("conv_id", "part", "block", "reverse")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ends, pa.list_(pa.int64())), pa.array(cost, pa.int64())], ["conv_id", "part", "block", "reverse", "ends", "cost"])


def _audits(batches):
    """For each string of signs and costs behind it: the edits from each state and the state they end in."""
    path, last = None, None
    for b in batches:
        audits, states = [], []
        for ends, reverse in zip(b.column("ends").to_pylist(), b.column("reverse").to_pylist()):
            if ends != last:
                path, last = _Path(tuple(ends)), ends
            path.follow(reverse)
            found = [path.audit(q) for q in range(4)]
            audits.append([a for a, _ in found])
            states.append([q for _, q in found])
        yield pa.RecordBatch.from_arrays([b.column("ends"), b.column("reverse"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["ends", "reverse", "audits", "states"])


class _Conversation:
    """What a conversation's rows add up to, one row after another."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.digest, self.lines = conv_id, EMPTY, hashlib.sha256(), 0
        self.audit, self.cost, self.edits, self.then = [], None, iter(""), EMPTY
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.turns, self.initial = 0, None

    def block(self, audits: list[str], states: list[int], cost: int) -> None:
        self.cost = cost if self.cost is None else self.cost
        self.audit.append(audits[self.state])
        self.edits, self.then = iter(audits[self.state]), states[self.state]

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.line(ROLE[self.state], "")

    def row(self, turn, role: str, text: str, sign: str) -> None:
        self.blank += sign == "b"
        self.duplicate += sign == "d"
        self.truncated += sign.isupper()
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        for edit in self.edits:
            if edit == "I":
                self.insert()
                continue
            if edit == "R":
                self.state = NEXT[self.state]
                self.line(ROLE[self.state], text)
            elif edit == "K":
                self.state = KEPT[self.state, initial]
                self.line(role, text)
            break

    def result(self) -> tuple:
        self.audit.append("I" * TAIL[self.state])
        for _ in range(TAIL[self.state]):
            self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


def _repaired(batches):
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def rows(done, conv_type):
        ids, values = [c.conv_id for c in done], list(zip(*(c.result() for c in done))) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(ids, conv_type), *(pa.array(v, k) for v, k in zip(values, kinds))], ["conv_id", *names])

    now, conv_type = None, pa.int64()
    for b in batches:
        conv_type, done = b.schema.field("conv_id").type, []
        for kind, conv_id, turn, role, text, sign, audits, states, cost in zip(*(b.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "sign", "audits", "states", "cost"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now)
                now = _Conversation(conv_id)
            if kind == 1:
                now.block(audits, states, cost)
            elif kind == 2:
                now.row(turn, role, text, sign)
        if done:
            yield rows(done, conv_type)
    if now is not None:
        yield rows([now], conv_type)


def _in_order(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*order)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text), with what was wrong after ``damaged`` and how it is mended.

    gaps: turns missing between the first and the last; blank, duplicate, truncated: rows by their first fault; illegal: neighbours
    whose roles can't follow each other; cost and audit: the cheapest edits (Keep, Rerole, Delete, Insert by their initials, the
    least in ASCII order among equals); repaired_sha256: the digest of what they leave, as ``role:text`` lines.

    Rows come by turn, nulls first, then role and text; repeated rows are rows of their own. Null texts, roles and turns count as
    said at ``damaged``; a role without a known initial can't be kept; a null conv_id is a conversation. Conversations without
    rows after the damage have zeros and empty strings (and the digest of nothing). Other columns are ignored; an empty table gives
    no rows.

    Rows are sorted by ranges of (conv_id, turn, role), so a large conversation spreads over tasks. Only the last step sends a whole
    conversation through one task, a row at a time, because a digest is a chain.
    """
    order = ("conv_id", "turn", "role")
    kinds = dict(pick(turns, "conv_id", "turn").dtypes)
    columns = f"conv_id {kinds['conv_id']}"
    signed = _signs(damaged(turns)).repartitionByRange(*order).sortWithinPartitions(*order, "text", "copy")
    rows = materialize(signed.mapInArrow(_numbered, f"{columns}, turn {kinds['turn']}, role string, text string, sign string, part int, nth long"), "turns")

    block = F.floor(F.col("nth") / BLOCK)
    seen = F.struct("nth", F.when(F.col("sign").isin("b", "d"), "x").otherwise(F.col("sign")).alias("sign"))
    strings = rows.groupBy("conv_id", "part", block.alias("block")).agg(F.reverse(F.array_join(F.array_sort(F.collect_list(seen))["sign"], "")).alias("reverse"))
    blocks = materialize(strings, "blocks")
    tables = blocks.select("reverse").distinct().repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(_tables, "reverse string, costs array<long>")
    backwards = _in_order(blocks.join(tables, "reverse"), ["conv_id"], "conv_id", F.desc("part"), F.desc("block"))
    ended = materialize(backwards.mapInArrow(_ends, f"{columns}, part int, block long, reverse string, ends array<long>, cost long"), "ends")
    shared = ended.select("ends", "reverse").distinct().repartitionByRange("ends", "reverse").sortWithinPartitions("ends", "reverse")
    edits = shared.mapInArrow(_audits, "ends array<long>, reverse string, audits array<string>, states array<int>")

    none = {"part": "int", "nth": "long", "turn": kinds["turn"], "role": "string", "text": "string", "sign": "string", "audits": "array<string>", "states": "array<int>", "cost": "long"}

    def as_rows(df: DataFrame, kind: int, **have) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("kind"), *[have.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])

    heads = as_rows(pick(turns, "conv_id").distinct(), 0)
    found = as_rows(ended.join(edits, ["ends", "reverse"]), 1, nth=F.col("block") * BLOCK, **{k: F.col(k) for k in ("part", "audits", "states", "cost")})
    texts = as_rows(rows, 2, **{k: F.col(k) for k in ("part", "nth", "turn", "role", "text", "sign")})
    every = _in_order(reduce(DataFrame.unionByName, (heads, found, texts)), ["conv_id"], "conv_id", "part", "nth", "kind")
    return every.mapInArrow(_repaired, f"{columns}, {_OUT}")
