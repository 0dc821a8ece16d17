"""Conversations brought into order by the cheapest edits of their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

#: Turns that one block of a conversation holds (2 to this power), and characters of one piece of its repaired text.
BLOCK, PIECE = 10, 1 << 20
WHITE = "\t\n\x0b\x0c\r "
#: What has been said so far: nothing, a system turn, a user turn last, an assistant turn last. Repaired conversations end in the first or the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: What is told of a conversation besides its edits.
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DELETE, KEEP, REROLE, INSERT, CUT = 4, 0, 3, 3, 3
MOD, BASE = (1 << 61) - 1, 911_382_323


class Audits:
    """Edit strings that share their prefixes: each is a node with its last piece, linked to the node of what precedes it.

    A node has its ancestors at distances 1, 2, 4 …, and a rolling hash by which an equal string finds it; parent and piece then verify it, so different strings that
    share a hash stay apart, and equal ones are one node. Hence two strings' longest common prefix is their last common ancestor, found by halving."""

    def __init__(self):
        self.piece, self.depth, self.hash, self.up = [""], [0], [1], [[]]
        self.found: dict[int, list[int]] = {}

    def extended(self, node: int, piece: str) -> int:
        h = (self.hash[node] * BASE + (ord(piece) if len(piece) == 1 else hash(piece))) % MOD
        same = self.found.setdefault(h, [])
        for other in same:
            if self.piece[other] == piece and self.up[other][0] == node:
                return other
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        same.append(len(self.piece))
        self.piece.append(piece)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        self.up.append(up)
        return len(self.piece) - 1

    def at(self, node: int, depth: int) -> int:
        """The ancestor of some depth."""
        away, k = self.depth[node] - depth, 0
        while away:
            if away & 1:
                node = self.up[node][k]
            away >>= 1
            k += 1
        return node

    def shared(self, a: int, b: int) -> int:
        """The node of the longest common prefix."""
        a, b = self.at(a, min(self.depth[a], self.depth[b])), self.at(b, min(self.depth[a], self.depth[b]))
        if a == b:
            return a
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.up[a][0]

    def less(self, a: int, b: int) -> bool:
        """Whether string a is before string b, by code points."""
        if a == b:
            return False
        i = j = self.depth[self.shared(a, b)]
        x = y = ""
        while True:
            while len(x) == 0 and i < self.depth[a]:
                i += 1
                x = self.piece[self.at(a, i)]
            while len(y) == 0 and j < self.depth[b]:
                j += 1
                y = self.piece[self.at(b, j)]
            n = min(len(x), len(y))
            if not n or x[:n] != y[:n]:
                return x[:n] < y[:n] if n else len(y) > 0
            x, y = x[n:], y[n:]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.piece[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Best = list[tuple[int, int] | None]


def _offer(audits: Audits, best: Best, state: int, cost: int, node: int, piece: str) -> None:
    """(cost, node + piece) where it is cheaper than what a state has, or as cheap and before it."""
    own = best[state]
    if own is None or cost < own[0]:
        best[state] = (cost, audits.extended(node, piece))
    elif cost == own[0]:
        node = audits.extended(node, piece)
        if audits.less(node, own[1]):
            best[state] = (cost, node)


def _inserted(audits: Audits, best: Best) -> Best:
    """best, with user and assistant turns put in where that makes a state cheaper."""
    for to, starts in ((USER, (NONE, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        for s in starts:
            if (was := best[s]) is not None:
                _offer(audits, best, to, was[0] + INSERT, was[1], "I")
    return best


def _after(audits: Audits, best: Best, initial: str, gone: bool, short: bool) -> Best:
    """States after one more turn. gone: it must be deleted; short: keeping it costs CUT more."""
    new: Best = [b and (b[0] + DELETE, audits.extended(b[1], "D")) for b in best]
    if not gone:
        more = CUT if short else 0
        if initial == "s" and (was := best[NONE]) is not None:
            _offer(audits, new, SYSTEM, was[0] + KEEP + more, was[1], "K")
        for to, letter, starts in ((USER, "u", (NONE, SYSTEM, ASSISTANT)), (ASSISTANT, "a", (USER,))):
            for s in starts:
                if (was := best[s]) is not None:
                    _offer(audits, new, to, was[0] + (KEEP if initial == letter else REROLE) + more, was[1], "K" if initial == letter else "R")
    return _inserted(audits, new)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first columns, each group as a stream of its other columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return ((key, (r[keys:] for r in own)) for key, own in groupby(rows, key=lambda r: r[:keys]))


def _shares(rows: Iterable[tuple], fields: list[tuple], size: int = 512) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while share := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*share, strict=True), fields, strict=True)], [n for n, _ in fields])


def turn_facts(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without . ! or ?"""
    end = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    blank = F.coalesce(end == "", F.lit(True))
    return blank, ~blank & ~end.isin(".", "!", "?")


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in order, over all conversations, with their place `pos` and block; a table. Repeats of a whole row are told apart, and hold no text but once."""
    blank, short = turn_facts(F.col("text"))
    own = F.concat(F.coalesce(F.length("role").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.select("conv_id", "turn", "role", "text", blank.alias("blank"), short.alias("short"), F.unhex(F.sha2(own, 256)).alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    rows = rows.withColumn("text", F.when((F.col("copy") == 1) & ~F.col("blank"), F.col("text")))
    order = ["conv_id", "turn", "role", "own", "copy"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return cut(placed.withColumn("block", F.shiftright("pos", BLOCK)), "repair")


def _blocks(ordered: DataFrame) -> DataFrame:
    """(conv_id, block, n, blank, duplicate, truncated, illegal, first, last, turns, least, most, cells): a block's counts, the roles and turns at its ends, and for each pair of states
    before and after it the cheapest edits: cells are `before after cost audit`."""
    kind = ordered.schema["conv_id"].dataType
    narrow = ordered.select("conv_id", "block", "pos", "turn", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), "blank", "short", "own")
    seen = narrow.where(~F.col("blank")).groupBy("conv_id", "own").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("own").alias("o"), "first")
    repeats = cut(seen, "repair")  # a plain table, so that a join can split a key that many rows share
    flagged = narrow.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("own") == F.col("o")) & ~F.col("blank"), "left")
    rows = flagged.select("conv_id", "block", "pos", "turn", "initial", "blank", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("again"), "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shares(((*key, *_block(list(turns))) for key, turns in _groups(batches, 2)), fields)

    fields = [("conv_id", to_arrow_type(kind)), *((k, pa.int64()) for k in ("block", "n", "blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((k, pa.int64()) for k in ("turns", "least", "most")), ("cells", pa.string())]
    schema = f"conv_id {kind.simpleString()}, block long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, least long, most long, cells string"
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(run, schema)


def _legal(a: str, b: str) -> bool:
    return (a, b) in (("s", "u"), ("u", "a"), ("a", "u"))


def _block(turns: list[tuple]) -> tuple:
    """Of turns (pos, turn, initial, blank, again, short): what _blocks() returns for them."""
    initials = [t[2] for t in turns]
    known = [t[1] for t in turns if t[1] is not None]
    faults = [0, 0, 0]
    for _, _, _, blank, again, short in turns:
        if blank or again or short:
            faults[0 if blank else 1 if again else 2] += 1
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    cells, audits = [], Audits()
    for before in range(4):
        best: Best = [None] * 4
        best[before] = (0, 0)
        for _, _, initial, blank, again, short in turns:
            best = _after(audits, best, initial, blank or again, short)
        cells += [f"{before} {after} {b[0]} {audits.text(b[1])}" for after, b in enumerate(best) if b is not None]
    return len(turns), *faults, illegal, initials[0], initials[-1], len(set(known)), known[0] if known else None, known[-1] if known else None, "\n".join(cells)


def _joined(key: tuple, blocks: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each block of one conversation, with the state before it and its edits, and one for the conversation."""
    audits, counts, last, turn, gaps, numbers = Audits(), [0, 0, 0, 0], None, None, 0, []
    best: Best = [(0, 0), None, None, None]
    best, least = _inserted(audits, best), None
    came: list[list[int]] = []  # for each block and state after it, the state before it
    for block, _, blank, duplicate, truncated, illegal, first, end, turns, low, high, cells in blocks:
        numbers.append(block)
        counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal + (last is not None and not _legal(last, first))), strict=True)]
        last = end
        if low is not None:
            gaps -= turns - (turn is not None and turn == low)
            least, turn = low if least is None else least, high
        new: Best = [None] * 4
        origin = [0] * 4
        for c in cells.split("\n"):
            before, after, cost, piece = c.split(" ")
            if (was := best[int(before)]) is not None:
                had = new[int(after)]
                _offer(audits, new, int(after), was[0] + int(cost), was[1], piece)
                if new[int(after)] != had:
                    origin[int(after)] = int(before)
        best = new
        came.append(origin)
    if least is not None:
        gaps += turn - least + 1
    state = min((s for s in ENDS if best[s] is not None), key=lambda s: best[s][0])
    for s in ENDS:
        if best[s] is not None and best[s][0] == best[state][0] and audits.less(best[s][1], best[state][1]):
            state = s
    cost, node = best[state]
    states = [state]
    for origin in reversed(came):
        states.append(origin[states[-1]])
    states.reverse()
    opening = audits.text(audits.at(node, audits.depth[node] - len(came)))
    for i, block in enumerate(numbers):
        piece = audits.piece[audits.at(node, audits.depth[node] - len(came) + i + 1)]
        yield (*key, block, NONE if not i else states[i], (opening if not i else "") + piece, len(came) == 1, None, None, None, None, None, None)
    yield (*key, None, None, audits.text(node), None, gaps, *counts, cost)


def _edited(rows: Iterator[tuple], state: int, edits: str) -> Iterator[tuple[bool, str, str]]:
    """(whether nothing was said before, role, text) of turns (pos, role, text, …) after their edits."""
    at = 0
    while True:
        while at < len(edits) and edits[at] == "I":
            yield state == NONE, "assistant" if state == USER else "user", ""
            state, at = ASSISTANT if state == USER else USER, at + 1
        row = next(rows, None)
        if row is None:
            return
        if edits[at] == "K":
            yield state == NONE, row[1], row[2]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row[1][0]]
        elif edits[at] == "R":
            yield state == NONE, "assistant" if state == USER else "user", row[2]
            state = ASSISTANT if state == USER else USER
        at += 1


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for key, rows in _groups(batches, 2):
        _, _, _, state, edits, _ = next(rows)
        yield from ((*key, k, role, text) for k, (_, role, text) in enumerate(_edited(rows, state, edits)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired text of blocks: its digest where a block is a whole conversation, else the text in pieces."""
    for key, rows in _groups(batches, 2):
        _, _, _, state, edits, whole = next(rows)
        digest, held, size, k = hashlib.sha256(), [], 0, 0
        for opens, role, text in _edited(rows, state, edits):
            line = f"{'' if opens else chr(10)}{role}:{text}"
            if whole:
                digest.update(line.encode())
                continue
            held.append(line)
            size += len(line)
            if size >= PIECE:
                yield (*key, k, "".join(held), None)
                held, size, k = [], 0, k + 1
        if whole or held:
            yield (*key, k, None if whole else "".join(held), digest.hexdigest() if whole else None)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One row for each conversation of its facts, and of its digest or the pieces of its text, in order."""
    for key, rows in _groups(batches, 1):
        facts, audit, digest, known = [0] * len(FACTS), "", hashlib.sha256(), None
        for _, _, piece, sha, summary, told in rows:
            if told is not None:
                facts, audit = [told[n] for n in FACTS], summary
            if piece is not None:
                digest.update(piece.encode())
            known = sha or known
        yield (*key, *facts, audit, known or digest.hexdigest())


class _Plan:
    """Turns in order and what becomes of them: tables that both forms of the result come from."""

    def __init__(self, turns: DataFrame):
        own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        self.name, kind = own.schema["conv_id"].dataType.simpleString(), to_arrow_type(own.schema["conv_id"].dataType)
        self.key = ("conv_id", kind)
        self.ordered = _ordered(own)
        fields = [self.key, ("block", pa.int64()), ("state", pa.int64()), ("audit", pa.string()), ("whole", pa.bool_()), *((n, pa.int64()) for n in FACTS)]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _shares((r for key, blocks in _groups(batches, 1) for r in _joined(key, blocks)), fields)

        blocks = _blocks(self.ordered).repartition("conv_id").sortWithinPartitions("conv_id", "block")
        self.done = cut(blocks.mapInArrow(join, f"conv_id {self.name}, block long, state long, audit string, whole boolean, {', '.join(f'{n} long' for n in FACTS)}"), "repair")

    def edits(self, made, fields: list[tuple], schema: str) -> DataFrame:
        """made(batches) of each block's orders, first, and turns."""
        orders = self.done.where("block is not null").select("conv_id", "block", _nothing("long", "pos"), _nothing("string", "role"), _nothing("string", "text"), "state", "audit", "whole")
        both = self.ordered.select("conv_id", "block", "pos", "role", "text", _nothing("long", "state"), _nothing("string", "audit"), _nothing("boolean", "whole")).unionByName(orders)
        fields = [self.key, ("block", pa.int64()), ("k", pa.int64()), *fields]
        return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(lambda batches: _shares(made(batches), fields), f"conv_id {self.name}, block long, k long, {schema}")


def _nothing(kind, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, block, k, role, text): the turns of repaired conversations, in order of conv_id, block and k, as repaired() edits them. Conversations that lose all turns have none."""
    return _Plan(turns).edits(_turns, [("role", pa.string()), ("text", pa.string())], "role string, text string")


def repaired(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation, with its faults and the cheapest edits that make its roles
    an optional system turn and then pairs of user and assistant, or nothing; among equally cheap ones those whose letters come first.

    turns: conv_id, turn, role, text, ordered by turn, nulls first, then by role and content. Other columns are ignored. A turn is blank (null or white), else a
    duplicate (role and text were said before), else truncated (ends without . ! or ?), and counts once. Edits: K keep 0, R another role 3, D delete 4 (a
    must for blank and duplicate), I insert an empty user or assistant turn 3; a truncated turn that stays costs 3 more. gaps: numbers missing between the least and the
    greatest turn. illegal: neighbours whose roles' initials aren't su, ua or au; a null role has none. The digest is SHA-256 of `role:text` lines.

    conversations: conv_ids that have a row, if with zeros, even without any turn. A null conv_id is a conversation of its own. Empty table: no rows. Repeated rows
    are duplicates; very long texts stay whole, one value at a time.

    No conversation is in one task as a whole: ranges of (conv_id, turn) order all turns, blocks of 1024 give the cheapest edits between any two states, and a block's
    edits are joined to its neighbours'. What meets in one task for each conversation are its blocks, its audit, which the result holds as one string, and pieces of its text
    for the digest, read one after another."""
    plan = _Plan(turns)
    parts = plan.edits(_pieces, [("piece", pa.string()), ("digest", pa.string())], "piece string, digest string")
    facts = plan.done.where("block is null").select("conv_id", "block", _nothing("long", "k"), _nothing("string", "piece"), _nothing("string", "digest"), "audit", F.struct(*FACTS).alias("told"))
    told = facts.schema["told"].dataType
    everything = parts.select("*", _nothing("string", "audit"), _nothing(told, "told")).unionByName(facts)
    if conversations is not None:
        everything = everything.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    fields = [plan.key, *((n, pa.int64()) for n in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    sums = everything.repartition("conv_id").sortWithinPartitions("conv_id", "block", "k")
    return sums.mapInArrow(lambda batches: _shares(_sums(batches), fields), f"conv_id {plan.name}, {', '.join(f'{n} long' for n in FACTS)}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults at places that a checksum of conversation and turn names: of 20 turns one is dropped, one emptied, one without its . ! and ?, one repeated, and one said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def sql() -> str:
    """DuckDB SQL of repaired(damaged(conversations), conversations): a table of strings `cost audit` for the four states, row after row."""
    add = lambda s, cost, letter: f"printf('%09d', left({s}, 9)::BIGINT + {cost}) || substr({s}, 10) || '{letter}'"
    kept = lambda letter: f"CASE WHEN c = '{letter}' THEN 0 ELSE 3 END + more"
    either = lambda s, letter: f"CASE WHEN c = '{letter}' THEN {add(s, kept(letter), 'K')} ELSE {add(s, kept(letter), 'R')} END"
    before_user = "least(n, s, a)"
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
f AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM d),
j AS (SELECT *, coalesce(bare, '') = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lead(i) OVER w IS NOT NULL AND coalesce(left(role, 1) || left(lead(role) OVER w, 1), '') NOT IN ('su', 'ua', 'au') AS illegal FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
r AS (SELECT *, coalesce(left(role, 1), '') AS c, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS short, CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM j),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS n, NULL::VARCHAR AS s, '000000003I' AS u, '000000006II' AS a FROM r
UNION ALL SELECT conv_id, i, n, s, u, least(a, {add("u", 3, "I")}) FROM (SELECT conv_id, i, n, s, least(u, {add(before_user, 3, "I")}) AS u, a FROM (
    SELECT r.conv_id, r.i, {add("n", 4, "D")} AS n, least({add("s", 4, "D")}, CASE WHEN NOT gone AND c = 's' THEN {add("n", "more", "K")} END) AS s,
           least({add("u", 4, "D")}, CASE WHEN NOT gone THEN {either(before_user, "u")} END) AS u, least({add("a", 4, "D")}, CASE WHEN NOT gone THEN {either("u", "a")} END) AS a
    FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
best AS (SELECT conv_id, arg_max(least(n, a), i) AS b FROM w GROUP BY conv_id),
audits AS (SELECT conv_id, left(b, 9)::BIGINT AS cost, substr(b, 10) AS audit FROM best),
letters AS (SELECT conv_id, k, audit[k] AS e, length(audit) - length(replace(audit, 'D', '')) AS dropped, length(audit) AS size FROM audits, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)),
places AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
lines AS (SELECT p.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + size - dropped) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said
          FROM places p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE e <> 'D' GROUP BY p.conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id"""
