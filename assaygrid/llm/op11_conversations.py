"""Repair of the turn structure of conversations by iterative-deepening A* (operator 11).

A conversation's role initials must read ``(s?(ua)+)?``.  Edits, in the order of their initials: Delete (3), Insert an
empty user or assistant turn (2), Keep (0), Rerole to user or assistant (2); blank and repeated rows must be deleted,
a truncated row that stays costs 1 more.  After the first turn the grammar leaves one role for every place, so the
initials of the edits name one repair.  The search goes depth first through the edits in ASCII order under a rising
cost bound; a table holds, for every (row, state of the grammar) that failed, the cost it is now known to need, which
prunes later visits and gives the next bound.  The first accepting path is the cheapest repair with the least initials.

Rows are range-partitioned by (conv_id, turn, role, text) and read in that order, in pieces of at most ``PIECE``
rows or one slice of text.  A conversation of one piece is repaired where it is read.  A longer one, or one that a range
boundary may cut, is searched piece by piece, from each state to each state, so that no task holds a whole conversation's
rows; equally cheap repairs of one piece between the same two states are never beginnings of each other, so the least
ones joined are the least of the whole.  The pieces' tables are joined in order and the chosen edits go back to the
pieces.  Only the digest of a conversation reads its rows in one task, as a stream.

Null roles and texts count as one space; null turns come first; rows of one turn are ordered by role and text.  A null
conv_id is one more conversation.  An empty role's initial counts as a space.  Repeated rows are what the duplicate rule
is about.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import SLICE_BYTES, table
from assaygrid.llm.op12_merkle import crc_sql
from assaygrid.operators.base import join_same
from assaygrid.session import cut_lineage

PIECE = 256  # rows searched at once
FEW = 100_000  # repeated (role, text) keys up to this number are broadcast, more are joined by a shuffle
NONE = 1 << 60
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]")
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1  # costs
# states of the grammar: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
AFTER = (2, 2, 3, 2)
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ROLE = {2: "user", 3: "assistant"}


def _moves(code: str) -> list:
    """For each state the edits (initial, rows read, next state, cost) in ASCII order.

    ``code``: the initial (x for any other) of a row that may stay, upper case when truncated; d for a row that must
    go; empty behind the last row.
    """
    extra = CUT_OFF if code.isupper() else 0
    out = []
    for q in range(4):
        edits = [("I", 0, AFTER[q], INSERT)]
        if code:
            edits.insert(0, ("D", 1, q, DELETE))
        if code and code != "d":
            if (code.lower(), q) in KEEPS:
                edits.append(("K", 1, KEEPS[code.lower(), q], extra))
            edits.append(("R", 1, AFTER[q], REROLE + extra))
        out.append(edits)
    return out


MOVES = {c: _moves(c) for c in ("s", "u", "a", "x", "S", "U", "A", "X", "d", "")}


def lower_bounds(codes: str, goals: frozenset) -> list[list[int]]:
    """need[state][row]: what the rest costs at least, NONE where no goal can be reached."""
    n = len(codes)
    last_system = max(codes.rfind("s"), codes.rfind("S"))
    need = []
    for q in range(4):
        least = {c: min(cost for e in MOVES[c][min(q, 1) :] for _, read, _, cost in e if read) for c in set(codes)}
        row = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            row[i] = row[i + 1] + least[codes[i]]
        if goals <= {0, 1} and q not in goals:
            ok = range(last_system + 1) if q == 0 and goals == {1} else range(0)
            row = [row[i] if i in ok else NONE for i in range(n + 1)]
        need.append(row)
    return need


def search(codes: str, start: int, goals: frozenset, need: list[list[int]]) -> tuple[int, str] | None:
    """Cheapest cost and least edits from ``start`` to one of ``goals``; ``need`` is the table and is raised."""
    n = len(codes)
    moves = [MOVES[c] for c in codes] + [MOVES[""]]
    while need[start][0] < NONE:
        bound = need[start][0]
        frames, path = [[0, start, bound, 0, NONE]], []  # row, state, cost left, next edit, what is needed at least
        while frames:
            frame = frames[-1]
            i, q, left, k, low = frame
            if i == n and q in goals:
                return bound, "".join(path)
            options = moves[i][q]
            while k < len(options):
                letter, read, to, cost = options[k]
                k += 1
                wants = cost + need[to][i + read]
                if wants <= left:
                    frame[3], frame[4] = k, low
                    frames.append([i + read, to, left - cost, 0, NONE])
                    path.append(letter)
                    break
                low = min(low, wants)
            else:
                need[q][i] = low
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], frames[-1][2] - left + low)
    return None


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    goals = frozenset((0, 3))
    return search(codes, 0, goals, lower_bounds(codes, goals))


class Known(dict):
    """Repairs found by a task, by codes; short conversations are often alike."""

    def __missing__(self, codes: str) -> tuple[int, str]:
        found = cheapest(codes)
        if len(codes) <= 16 and len(self) < 100_000:
            self[codes] = found
        return found


def piece_table(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) for all states that a piece can lead from and to."""
    out = []
    for to in range(4):
        goals = frozenset((to,))
        need = lower_bounds(codes, goals)
        for start in range(4):
            found = search(codes, start, goals, need)
            if found:
                out.append((start, to, *found))
    return out


def replay(rows, edits: str, state: int):
    """The repaired (role, text) turns."""
    at = 0
    for e in edits:
        if e == "I":
            state = AFTER[state]
            yield ROLE[state], ""
            continue
        role, text = rows[at]
        at += 1
        if e == "K":
            state = KEEPS[role[:1], state]
            yield role, text
        elif e == "R":
            state = AFTER[state]
            yield ROLE[state], text


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("whole", pa.bool_()), ("codes", pa.string()), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in (*COUNTS, "low", "high", "cost")]
    + [("audit", pa.string()), ("turns_now", TURNS)]
)
PIECES_SQL = "conv_id bigint, part bigint, no bigint, whole boolean, codes string, first string, last string, " + (
    ", ".join(f"{c} bigint" for c in (*COUNTS, "low", "high", "cost")) + ", audit string, turns_now array<struct<role:string,text:string>>"
)


class Piece:
    """Consecutive rows of one conversation, as they are read."""

    def __init__(self, conv):
        self.conv, self.codes, self.rows, self.bytes = conv, [], [], 0
        self.first = self.last = self.low = self.high = None
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        c = self.counts
        initial = role[:1] or " "
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        self.last = initial
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        code = initial if initial in "sua" else "x"
        if not WORD.search(text):
            c["blank"] += 1
            code = "d"
        elif repeated:
            c["duplicate"] += 1
            code = "d"
        elif text.rstrip(SPACE)[-1] not in ".!?":
            c["truncated"] += 1
            code = code.upper()
        self.codes.append(code)
        self.rows.append((role, text))
        self.bytes += len(text)

    def record(self, part: int, no: int, whole: bool, known: Known) -> dict:
        codes = "".join(self.codes)
        cost, audit = known[codes] if whole else (None, None)
        rows = list(replay(self.rows, audit, 0)) if whole else self.rows
        return {
            "conv_id": self.conv, "part": part, "no": no, "whole": whole, "codes": codes, "first": self.first, "last": self.last, **self.counts,
            "low": self.low, "high": self.high, "cost": cost, "audit": audit, "turns_now": [{"role": r, "text": t} for r, t in rows],
        }


def in_batches(records, schema: pa.Schema, size: int = lambda r: 1, most: int = 2000):
    """Record batches of at most about ``most`` units of size."""
    held, units = [], 0
    for r in records:
        held.append(r)
        units += size(r)
        if units >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, units = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_pieces(ordered: DataFrame, piece: int) -> DataFrame:
    """Pieces of the ordered rows; ``turns_now`` holds the repaired turns of a whole conversation, else the rows."""

    def records(batches):
        part = TaskContext.get().partitionId()
        now, no, whole = None, 0, False  # the first conversation of a range may have begun before
        before, known = None, Known()
        for batch in batches:
            for conv, turn, role, text, key, again, absent in zip(*(batch.column(i).to_pylist() for i in range(7))):
                other = now is None or conv != now.conv
                if other or len(now.codes) >= piece or now.bytes >= SLICE_BYTES:
                    if now is not None:
                        yield now.record(part, no, whole and other, known)
                        no += 1
                        whole = other
                    now = Piece(conv)
                if not absent:
                    now.add(turn, role, text, again or before == (conv, turn, key))
                    before = conv, turn, key
        if now is not None:
            yield now.record(part, no, False, known)

    weigh = lambda r: 200 + sum(len(t["text"]) for t in r["turns_now"])
    return ordered.mapInArrow(lambda batches: in_batches(records(batches), PIECES, weigh, SLICE_BYTES), PIECES_SQL)


def pieces_of(rows: DataFrame, piece: int) -> DataFrame:
    """``read_pieces`` of (conv_id, turn, role, text, absent), a row later than another one with its role and text marked."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), space("role").alias("role"), space("text").alias("text"), "absent")
    rows = rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    keys = rows.filter("not absent").groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(when).alias("since"))
    keys = cut_lineage(keys.filter("n > 1").drop("n"))
    few = keys.count() <= FEW
    rows = join_same(rows, F.broadcast(keys) if few else keys, ["conv_id", "key"], "left")
    rows = rows.select("conv_id", "turn", "role", "text", "key", F.coalesce(when > F.col("since"), F.lit(False)).alias("again"), "absent")
    order = ["conv_id", "turn", "role", "text"]
    return cut_lineage(read_pieces(rows.repartitionByRange(*order).sortWithinPartitions(*order), piece))


def _runs(batches, columns: list[str]):
    """Lists of records are never built for a conversation: (conv_id, is first, record) for rows in order."""
    last = object()
    for batch in batches:
        for r in batch.select(columns).to_pylist():
            yield r["conv_id"] != last, r
            last = r["conv_id"]


def _before(a, b) -> bool:
    """Whether candidate a (cost, chain of edits) goes before b; chains are linked from their last piece."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y, u, v = a[1], b[1], [], []
    while x is not y:
        u.append(x[1])
        v.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(u)) < "".join(reversed(v))


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLAN = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("closes", pa.bool_())] + [(c, pa.int64()) for c in REPORT] + [("audit", pa.string())])
PLAN_SQL = "part bigint, no bigint, state int, edits string, closes boolean, " + ", ".join(f"{c} bigint" for c in REPORT) + ", audit string"


def plan_of(cut: DataFrame) -> DataFrame:
    """For every piece of the cut conversations its state before and its edits; the last piece holds the report."""
    stats = ["conv_id", "part", "no", "first", "last", *COUNTS, "low", "high"]

    def tables(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        for batch in batches:
            names = ("start", "to", "cost", "edits")
            found = [[dict(zip(names, x)) for x in piece_table(c)] for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in stats], pa.array(found, kind)], [*stats, "found"])

    schema = "conv_id bigint, part bigint, no bigint, first string, last string, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "low", "high"))
    searched = cut.select(*stats, "codes").mapInArrow(tables, schema + ", found array<struct<start:int,to:int,cost:bigint,edits:string>>")

    def finish(seen, best, sums):
        cost, chain = best[0] if 0 in best and _before(best[0], best[3]) else best[3]
        edits = []
        while chain is not None:
            edits.append((chain[1], chain[2]))
            chain = chain[0]
        edits.reverse()
        gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        report = {**{c: sums[c] for c in REPORT if c in sums}, "gaps": gaps, "cost": cost, "audit": "".join(e for e, _ in edits)}
        for i, ((part, no), (e, start)) in enumerate(zip(seen, edits)):
            closes = i == len(edits) - 1
            yield {"part": part, "no": no, "state": start, "edits": e, "closes": closes, **(report if closes else {})}

    def records(batches):
        seen, best, sums = [], {}, {}
        for new, r in _runs(batches, [*stats, "found"]):
            if new:
                if seen:
                    yield from finish(seen, best, sums)
                seen, best = [], {0: (0, None)}
                sums = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "last": None}
            seen.append((r["part"], r["no"]))
            for c in COUNTS:
                sums[c] += r[c]
            if r["first"] is not None:
                sums["illegal"] += sums["last"] is not None and sums["last"] + r["first"] not in ("su", "ua", "au")
                sums["last"] = r["last"]
            if r["low"] is not None:
                sums["turns"] -= sums["high"] == r["low"]
                sums["low"], sums["high"] = r["low"] if sums["low"] is None else sums["low"], r["high"]
            after = {}
            for x in r["found"]:
                if x["start"] in best:
                    cost, chain = best[x["start"]]
                    one = cost + x["cost"], (chain, x["edits"], x["start"])
                    if x["to"] not in after or _before(one, after[x["to"]]):
                        after[x["to"]] = one
            best = after
        if seen:
            yield from finish(seen, best, sums)

    together = searched.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return together.mapInArrow(lambda batches: in_batches(records(batches), PLAN), PLAN_SQL)


def repaired_pieces(rows: DataFrame, absent: str | None = None, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, no, closes, gaps .. cost, audit, repaired): repaired turns in the order of (part, no).

    The report columns stand in a conversation's last piece.  ``absent`` names a boolean column of rows that only
    name their conversation.
    """
    gone = F.lit(False) if absent is None else F.coalesce(F.col(absent), F.lit(False))
    pieces = pieces_of(rows.withColumn("absent", gone), piece)
    shown = ["conv_id", "part", "no", "closes", *REPORT, "audit", "repaired"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.filter("whole").withColumn("gaps", gaps).withColumn("closes", F.lit(True)).withColumnRenamed("turns_now", "repaired").select(shown)
    cut = pieces.filter("not whole")
    joined = cut.select("conv_id", "part", "no", "turns_now").join(plan_of(cut), ["part", "no"])
    rest = [c for c in shown if c != "repaired"]

    def edited(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                turns = [(t["role"], t["text"]) for t in row.column("turns_now")[0].as_py()]
                now = replay(turns, row.column("edits")[0].as_py(), row.column("state")[0].as_py())
                done = pa.array([[{"role": r, "text": t} for r, t in now]], TURNS)
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in rest], done], shown)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields)
    return whole.unionByName(joined.mapInArrow(edited, kinds))


def repaired_turns(rows: DataFrame, absent: str | None = None) -> DataFrame:
    """(conv_id, part, no, place, role, text): the repaired turns; a conversation's order is (part, no, place)."""
    pieces = repaired_pieces(rows, absent)
    return pieces.select("conv_id", "part", "no", F.posexplode("repaired").alias("place", "t")).select("conv_id", "part", "no", "place", "t.role", "t.text")


def conversation_report(rows: DataFrame, absent: str | None = None, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation."""
    names = ["conv_id", *REPORT, "audit"]
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in names] + [("repaired_sha256", pa.string())])

    def records(batches):
        digest, some = None, False
        for new, r in _runs(batches, [*names, "closes", "repaired"]):
            if new:
                digest, some = hashlib.sha256(), False
            for t in r["repaired"]:
                digest.update(("\n" if some else "").encode() + f"{t['role']}:{t['text']}".encode())
                some = True
            if r["closes"]:
                yield {**{c: r[c] for c in names}, "repaired_sha256": digest.hexdigest()}

    sql = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in names) + ", repaired_sha256 string"
    pieces = repaired_pieces(rows, absent, piece)
    together = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return together.mapInArrow(lambda batches: in_batches(records(batches), schema), sql)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``; a dropped row stays as one that only names its conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), case.alias("case"))
    d = d.select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") <= 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "case", (F.col("case") == 0).alias("gone"),
    )
    times = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.withColumn("copy", times).drop("case", "copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return conversation_report(damaged(table(spark, sf_dir, "conversations")), "gone")


def op11_sql() -> str:
    """The same by dynamic programming over rows: for each state the least (cost, edits, repaired text)."""
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    ended = r"regexp_matches(text, '[.!?][\x20\x09-\x0D]*$')"
    add = lambda s, cost, edit, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': {s}.r || {line}}} END"
    insert = lambda s, role: add(s, 2, "I", f"'{role}:' || chr(10)")
    # s0 .. s3 with inserted turns are s0, s1, e2, e3
    closed = f"least(s2, {insert('s0', 'user')}, {insert('s1', 'user')}, {insert('s3', 'user')})"
    start = "least(s0, s1, s3)"
    keep = lambda s, cond: f"CASE WHEN ok AND {cond} THEN {add(s, 'cut', 'K', 'role || chr(58) || text || chr(10)')} END"
    rerole = lambda s, role: f"CASE WHEN ok THEN {add(s, '2 + cut', 'R', f"'{role}:' || text || chr(10)")} END"
    drop = lambda s: add(s, 3, "D", "''")
    users = [f(s) for s in ("s0", "s1", "e3") for f in (lambda s: keep(s, "ini = 'u'"), lambda s: rerole(s, "user"))]
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit FROM conversations),
    e AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT * FROM d WHERE hit <> 0 UNION ALL SELECT * FROM d WHERE hit = 3)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
        CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS ini FROM e),
    p AS (SELECT *, {blank} AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) || ini AS pair FROM o),
    c AS (SELECT *, NOT blank AND NOT again AS ok, CASE WHEN NOT blank AND NOT again AND NOT {ended} THEN 1 ELSE 0 END AS cut FROM p),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
        count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut = 1) AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id),
    run AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s1,
        NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM d)
        UNION ALL SELECT conv_id, i + 1, {drop('s0')}, least({drop('s1')}, {keep('s0', "ini = 's'")}),
        least({drop('e2')}, {', '.join(users)}), least({drop('e3')}, {keep('e2', "ini = 'a'")}, {rerole('e2', 'assistant')})
        FROM (SELECT *, least(s3, {insert('e2', 'assistant')}) AS e3 FROM (SELECT run.*, c.role, c.text, c.ini, c.ok, c.cut, {closed} AS e2
            FROM run JOIN c ON run.conv_id IS NOT DISTINCT FROM c.conv_id AND c.rn = run.i + 1))),
    ends AS (SELECT conv_id, least(s0, s3, {insert('e2', 'assistant')}) AS best FROM (SELECT *, {closed} AS e2 FROM run
        QUALIFY i = max(i) OVER (PARTITION BY conv_id)))
    SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(left(best.r, greatest(length(best.r) - 1, 0))) AS repaired_sha256
    FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id"""
