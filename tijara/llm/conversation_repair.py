"""Repair of conversation structure by the cheapest edits, with an audit of them.

A repaired conversation reads ``(s?(ua)+)?`` in role initials: a system row if
any, then user and assistant in turn.  Per row an edit keeps it (K, free),
changes its role to user or assistant (R, 3) or deletes it (D, 4); empty user
and assistant rows are inserted anywhere (I, 3).  Blank rows and repeats of an
earlier row must be deleted; a truncated row that stays adds 3.  Of the cheapest
edit sequences the one whose initials are least in ASCII order is the audit.

The dynamic program runs over rows and four states (nothing yet, after system,
after user, after assistant).  A cell holds its cost and the *prefix* of edits
that leads there.  Prefixes share their beginnings: one is a node with its last
edit, its predecessor, its binary-lifting ancestors and the rolling hash of all
edits up to it (:class:`Prefixes`).  Two prefixes of equal cost in one cell are
compared in a logarithmic search for their longest common prefix, and what the
hashes call equal is verified edit by edit back to the node both share.  (Two
such prefixes have used the same rows at the same cost, so neither begins the
other: insertions are not free.  Comparing prefixes therefore decides between
whole audits.)

Short conversations (``LONG_ROWS`` rows and ``LONG_CHARS`` characters at most)
are hashed to tasks by id, sorted there and repaired one at a time, so memory is
that of one short conversation.  Longer ones, of which one may hold a third of
all rows, never meet in one task: their rows are range-sorted by id and place,
each task solves stretches of ``STRETCH`` rows for every state they can begin
and end in, and stretches are joined state by state in a stream (min-plus
products).  Repeats are found by an aggregation on (id, row digest), texts meet
their edits by row number.  Only the audit, which is one cell of the result, and
the alternatives to it that are still open are together in one place.

Cases: null roles and texts count as one space (so blank); null turns come
first; rows with one turn are ordered by role and text digest; a null id is a
conversation of its own; rows marked ``present = false`` only name their
conversation, and one without any row has zeros and an empty audit; texts of any
length pass through (a long one makes its conversation a long one); an empty
table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at, positional, write_shared

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3  # what a truncated row that stays costs
LONG_ROWS = 2_000
LONG_CHARS = 8_000_000
STRETCH = 4_096
BROADCAST_IDS = 10_000
SPACES = " \t\n\x0b\x0c\r"
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A6C4E283 % ((1 << 61) - 1)

START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The state that a user or assistant row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}


class Prefixes:
    """Sequences of edits that share their beginnings; node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # up[n][j]: n without its last 2 ** j edits

    def add(self, node: int, edit: str) -> int:
        up, j = [node], 0
        while j < len(self.up[up[j]]):
            up.append(self.up[up[j]][j])
            j += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _MOD)
        self.up.append(up)
        return len(self.edit) - 1

    def first(self, node: int, n: int) -> int:
        """The first ``n`` edits of a prefix."""
        left = self.depth[node] - n
        j = 0
        while left:
            if left & 1:
                node = self.up[node][j]
            left >>= 1
            j += 1
        return node

    def less(self, a: int, b: int) -> bool:
        n = min(self.depth[a], self.depth[b])
        x, y = self.first(a, n), self.first(b, n)
        if self.hash[x] != self.hash[y]:
            # Back to the first edit at which the hashes part.
            for j in range(len(self.up[x]) - 1, -1, -1):
                if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                    x, y = self.up[x][j], self.up[y][j]
            differ, p, q = (x, y), self.up[x][0], self.up[y][0]
        else:
            differ, p, q = None, x, y
        while p != q:  # equal hashes: verified, back to the shared node
            if self.edit[p] != self.edit[q]:
                differ = p, q
            p, q = self.up[p][0], self.up[q][0]
        if differ is None:
            return self.depth[a] < self.depth[b]
        return self.edit[differ[0]] < self.edit[differ[1]]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _put(cells, state: int, cost: int, node: int, edit: str, prefixes: Prefixes) -> bool:
    """Offer an edit to a cell; whether it is taken."""
    now = cells[state]
    if now is not None and now[0] < cost:
        return False
    new = prefixes.add(node, edit)
    if now is not None and now[0] == cost and not prefixes.less(new, now[1]):
        return False
    cells[state] = (cost, new)
    return True


def _insertions(cells, prefixes: Prefixes) -> None:
    todo = [s for s in range(4) if cells[s] is not None]
    while todo:
        s = todo.pop(0)
        cost, node = cells[s]
        if cells[NEXT[s]] is not None and cells[NEXT[s]][0] < cost + INSERT:
            continue
        if _put(cells, NEXT[s], cost + INSERT, node, "I", prefixes):
            todo.append(NEXT[s])


def _step(cells, initial: str, must_go: bool, truncated: bool, prefixes: Prefixes):
    out: list = [None] * 4
    extra = TRUNCATED if truncated else 0
    for s in range(4):
        if cells[s] is None:
            continue
        cost, node = cells[s]
        _put(out, s, cost + DELETE, node, "D", prefixes)
        if must_go:
            continue
        kept = _KEPT.get((initial, s))
        if kept is not None:
            _put(out, kept, cost + KEEP + extra, node, "K", prefixes)
        _put(out, NEXT[s], cost + REROLE + extra, node, "R", prefixes)
    _insertions(out, prefixes)
    return out


def solve(rows, start: int | None = START):
    """Rows (initial, must go, truncated) -> (cost, audit) of a whole conversation;
    with ``start`` None the cells of a stretch for every state it can begin in:
    [begin][end] = (cost, edits) or None."""
    def run(s: int, whole: bool):
        prefixes = Prefixes()
        cells: list = [None] * 4
        cells[s] = (0, 0)
        if whole:
            _insertions(cells, prefixes)
        for r in rows:
            cells = _step(cells, *r, prefixes)
        return cells, prefixes

    if start is None:
        tables = []
        for s in range(4):
            cells, prefixes = run(s, False)
            tables.append([None if c is None else (c[0], prefixes.text(c[1])) for c in cells])
        return tables
    cells, prefixes = run(start, True)
    best = None
    for s in FINAL:
        c = cells[s]
        if c is not None and (best is None or c[0] < best[0] or (c[0] == best[0] and prefixes.less(c[1], best[1]))):
            best = c
    return best[0], prefixes.text(best[1])


class Chain:
    """Joins stretches of one conversation, beginning to end."""

    def __init__(self):
        # (cost, (pieces before, edits)); insertions before the first row.
        self.cells: list = [(0, (None, "")), None, (INSERT, (None, "I")), (2 * INSERT, (None, "II"))]

    @staticmethod
    def _less(a, b) -> bool:
        """Order of two chains of one length: their edits after the piece they share."""
        x, y = [], []
        while a is not b and (a or b):
            x.append(a[1])
            y.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(x)) < "".join(reversed(y))

    def add(self, table) -> None:
        out: list = [None] * 4
        for s in range(4):
            if self.cells[s] is None:
                continue
            cost, node = self.cells[s]
            for e in range(4):
                t = table[s][e]
                if t is None or (out[e] is not None and out[e][0] < cost + t[0]):
                    continue
                new = (node, t[1])
                if out[e] is None or cost + t[0] < out[e][0] or self._less(new, out[e][1]):
                    out[e] = (cost + t[0], new)
        self.cells = out

    def best(self) -> tuple[int, list[str]]:
        """Cost, and the edits of every stretch; the first is of the beginning."""
        choice = None
        for s in FINAL:
            c = self.cells[s]
            if c is not None and (choice is None or c[0] < choice[0] or (c[0] == choice[0] and self._less(c[1], choice[1]))):
                choice = c
        pieces, node = [], choice[1]
        while node:
            pieces.append(node[1])
            node = node[0]
        return choice[0], pieces[::-1]


def follow(edits: str, state: int, initials):
    """(row number or None, role or None for its own) of every row that stays or
    comes in, and the state after."""
    out, k = [], 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append((None, ROLE[state]))
            continue
        if e == "K":
            state = _KEPT[(initials[k], state)]
            out.append((k, None))
        elif e == "R":
            state = NEXT[state]
            out.append((k, ROLE[state]))
        k += 1
    return out, state


LEGAL = ("su", "ua", "au")


def _flagged(rows: DataFrame) -> DataFrame:
    """Positional input -> conv, turn, role, text, present, digest, blank, cut."""
    p, names = positional(rows)
    present = F.coalesce(at(names, "present"), F.lit(True)) if "present" in names else F.lit(True)
    p = p.select(at(names, "conv_id").cast("long").alias("conv"), at(names, "turn").cast("long").alias("turn"),
                 F.coalesce(at(names, "role"), F.lit(" ")).alias("role"), F.coalesce(at(names, "text"), F.lit(" ")).alias("text"),
                 present.alias("present"))
    body = F.rtrim("text", F.lit(SPACES))
    return p.select("*", F.sha2("text", 256).alias("digest"), (body == "").alias("blank"),
                    (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SHORT = f"conv long, {_STATS}, lines array<struct<role: string, text: string>>"


def _repair_short(batches):
    """Rows sorted by conversation and place -> one row a conversation."""
    import pyarrow as pa
    schema = pa.schema([("conv", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                       + [("audit", pa.string()), ("lines", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def done(conv, rows):
        seen, flags, turns = set(), [], []
        n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        for turn, role, text, blank, cut in rows:
            again = (role, text) in seen
            seen.add((role, text))
            fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
            if fault:
                n[fault] += 1
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            if turn is not None:
                turns.append(turn)
        n["illegal"] = sum(a[0] + b[0] not in LEGAL for a, b in zip(flags, flags[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = solve(flags)
        kept, _ = follow(audit, START, [f[0] for f in flags])
        lines = [{"role": role or rows[k][1], "text": "" if k is None else rows[k][2]} for k, role in kept]
        return {"conv": conv, "gaps": gaps, **n, "cost": cost, "audit": audit, "lines": lines}

    out, size, now, rows = [], 0, (), []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for conv, turn, role, text, present, blank, cut in zip(*cols):
            if now != (conv,):
                if now:
                    out.append(done(now[0], rows))
                now, rows = (conv,), []
                if len(out) >= 500 or size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            if present:
                rows.append((turn, role, text, blank, cut))
                size += len(text)
    if now:
        out.append(done(now[0], rows))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_PART = ("conv long, task int, no int, uids array<long>, initials string, inner long, blank long, duplicate long, truncated long, "
         "turn0 long, turn1 long, turns long, costs array<long>, edits array<string>")


def _stretches(limit: int):
    def run(batches):
        """Sorted rows of long conversations -> solved stretches of at most ``limit`` rows."""
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
                "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(f.split()[0], kind[f.split()[1]]) for f in _PART.split(", ")])

        def done(conv, no, rows):
            flags, n, turns = [], {"blank": 0, "duplicate": 0, "truncated": 0}, [r[0] for r in rows if r[0] is not None]
            for _turn, initial, _uid, blank, again, cut in rows:
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                if fault:
                    n[fault] += 1
                flags.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
            cells = [c for line in solve(flags, None) for c in line]
            # One character for each row; a role without one stands as a NUL.
            return {"conv": conv, "task": task, "no": no, "uids": [r[2] for r in rows], "initials": "".join(f[0] or "\0" for f in flags),
                    "inner": sum(a[0] + b[0] not in LEGAL for a, b in zip(flags, flags[1:])), **n,
                    "turn0": turns[0] if turns else None, "turn1": turns[-1] if turns else None, "turns": len(set(turns)),
                    "costs": [c and c[0] for c in cells], "edits": [c and c[1] for c in cells]}

        now, rows, no = (), [], 0
        for b in batches:
            for conv, turn, initial, uid, blank, again, cut in zip(*[c.to_pylist() for c in b.columns]):
                if rows and (now != (conv,) or len(rows) >= limit):
                    yield pa.RecordBatch.from_pylist([done(now[0], no, rows)], schema=schema)
                    rows, no = [], no + 1
                now = (conv,)
                rows.append((turn, initial, uid, blank, again, cut))
        if rows:
            yield pa.RecordBatch.from_pylist([done(now[0], no, rows)], schema=schema)
    return run


_CHAINED = f"conv long, total boolean, task int, no int, state int, {_STATS}"


def _chain(batches):
    """Stretches sorted by conversation and place -> a row for each conversation
    (total) and one for each stretch with its state before and its edits."""
    import pyarrow as pa
    schema = pa.schema([("conv", pa.int64()), ("total", pa.bool_()), ("task", pa.int32()), ("no", pa.int32()), ("state", pa.int32())]
                       + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])

    def done(conv, c, parts, n, turn):
        cost, pieces = c.best()
        state = START
        lead = pieces[0]  # insertions before the first row go with the first stretch
        rows = []
        for i, ((task, no, initials), edits) in enumerate(zip(parts, pieces[1:])):
            edits = lead + edits if i == 0 else edits
            rows.append({"conv": conv, "total": False, "task": task, "no": no, "state": state, "audit": edits})
            _, state = follow(edits, state, initials)
        gaps = turn[1] - turn[0] + 1 - turn[2] if turn[2] else 0
        return rows + [{"conv": conv, "total": True, "gaps": gaps, **n, "cost": cost, "audit": "".join(pieces)}]

    now, c, parts, n, turn, last = (), None, [], {}, [], ""
    for b in batches:
        for r in b.to_pylist():
            if now != (r["conv"],):
                if now:
                    yield pa.RecordBatch.from_pylist(done(now[0], c, parts, n, turn), schema=schema)
                now, c, parts, last = (r["conv"],), Chain(), [], None
                n, turn = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [None, None, 0]
            table = [[None if r["costs"][4 * s + e] is None else (r["costs"][4 * s + e], r["edits"][4 * s + e]) for e in range(4)]
                     for s in range(4)]
            c.add(table)
            parts.append((r["task"], r["no"], r["initials"]))
            for k in ("blank", "duplicate", "truncated"):
                n[k] += r[k]
            n["illegal"] += r["inner"] + (last is not None and (last + r["initials"][0]) not in LEGAL)
            last = r["initials"][-1]
            if r["turns"]:
                turn[2] += r["turns"] - (turn[1] is not None and turn[1] == r["turn0"])
                turn[0] = r["turn0"] if turn[0] is None else turn[0]
                turn[1] = r["turn1"]
    if now:
        yield pa.RecordBatch.from_pylist(done(now[0], c, parts, n, turn), schema=schema)


def _placed(batches):
    """Stretches with state and edits -> a row for every repaired row: uid or null, new role or null."""
    import pyarrow as pa
    schema = pa.schema([("conv", pa.int64()), ("task", pa.int32()), ("no", pa.int32()), ("k", pa.int32()), ("uid", pa.int64()), ("new", pa.string())])
    for b in batches:
        for r in b.to_pylist():
            rows, _ = follow(r["audit"], r["state"], r["initials"])
            yield pa.RecordBatch.from_pylist(
                [{"conv": r["conv"], "task": r["task"], "no": r["no"], "k": k, "uid": None if i is None else r["uids"][i], "new": new}
                 for k, (i, new) in enumerate(rows)], schema=schema)


def _digest(batches):
    """Sorted (conv, line) -> sha256 of each conversation's lines, as a stream."""
    import pyarrow as pa
    schema = pa.schema([("conv", pa.int64()), ("sha", pa.string())])
    now, h = (), None
    for b in batches:
        for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if now != (conv,):
                if now:
                    yield pa.RecordBatch.from_pylist([{"conv": now[0], "sha": h.hexdigest()}], schema=schema)
                now, h = (conv,), hashlib.sha256(line.encode())
            else:
                h.update(b"\n" + line.encode())
    if now:
        yield pa.RecordBatch.from_pylist([{"conv": now[0], "sha": h.hexdigest()}], schema=schema)


_COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass
class Repaired:
    """``short``: one row a short conversation with its lines; of long ones:
    ``totals`` (one row each) and ``placed`` (repaired rows in order); both None
    where there is no long conversation."""

    short: DataFrame
    totals: DataFrame | None
    placed: DataFrame | None

    def audits(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        line = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
        out = self.short.select(F.col("conv").alias("conv_id"), *_COLS, F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
        if self.totals is None:
            return out
        lines = self.placed.select("conv", F.concat("role", F.lit(":"), "text").alias("line"), "task", "no", "k")
        sha = (lines.repartition("conv").sortWithinPartitions("conv", "task", "no", "k").select("conv", "line")
               .mapInArrow(_digest, "conv long, sha string").withColumnRenamed("conv", "of"))
        long = self.totals.join(sha, F.col("conv").eqNullSafe(F.col("of")), "left")
        return out.unionByName(long.select(F.col("conv").alias("conv_id"), *_COLS,
                                           F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256")))

    def rows(self) -> DataFrame:
        """conv_id, place (ordered within a conversation), role, text of the repaired rows."""
        out = self.short.select(F.col("conv").alias("conv_id"), F.posexplode("lines").alias("k", "line")).select(
            "conv_id", F.struct(F.lit(0).alias("task"), F.lit(0).alias("no"), "k").alias("place"), "line.role", "line.text")
        if self.placed is None:
            return out
        return out.unionByName(self.placed.select(F.col("conv").alias("conv_id"), F.struct("task", "no", "k").alias("place"), "role", "text"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, stretch: int = STRETCH) -> Repaired:
    """Conversation rows (conv_id, turn, role, text and, if there, present) -> :class:`Repaired`."""
    f = _flagged(rows)
    size = f.groupBy("conv").agg(F.count_if("present").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = write_shared(size.filter((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv").alias("of")), "long-conversations")
    some = long.count()
    ids = F.broadcast(long) if some <= BROADCAST_IDS else long
    is_long = F.col("conv").eqNullSafe(F.col("of"))
    order = ["conv", "turn", "role", "digest"]
    short = f if not some else f.join(ids, is_long, "left_anti")
    short = (short.repartition("conv").sortWithinPartitions(*order).select("conv", "turn", "role", "text", "present", "blank", "cut")
             .mapInArrow(_repair_short, _SHORT))
    short = write_shared(short, "repaired-short")
    if not some:
        return Repaired(short, None, None)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = write_shared(f.join(ids, is_long, "left_semi").filter("present").withColumn("uid", F.monotonically_increasing_id()), "long-rows")
    first = (texts.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "uid")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select(F.col("conv").alias("of"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.uid").alias("stays")))
    slim = texts.select("conv", "turn", "role", "digest", "uid", "blank", "cut").join(
        first, is_long & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    slim = slim.select("conv", "turn", "role", "digest", "uid", "blank", F.coalesce(F.col("uid") != F.col("stays"), F.lit(False)).alias("again"), "cut")
    slim = slim.repartitionByRange(tasks, *order, "uid").sortWithinPartitions(*order, "uid")
    parts = write_shared(slim.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "uid", "blank", "again", "cut")
                         .mapInArrow(_stretches(stretch), _PART), "stretches")
    chained = write_shared(parts.drop("uids").repartition("conv").sortWithinPartitions("conv", "task", "no").mapInArrow(_chain, _CHAINED), "chained")
    total = chained.filter("total").select("conv", *_COLS)
    lost = long.join(total.select("conv"), is_long, "left_anti")  # every row of them is gone
    totals = total.unionByName(lost.select(F.col("of").alias("conv"), *[F.lit(0).cast("long").alias(c) for c in _COLS[:-1]], F.lit("").alias("audit")))
    edits = chained.filter("not total").select("task", "no", "state", "audit")
    placed = (parts.select("conv", "task", "no", "uids", "initials").join(edits, ["task", "no"])
              .mapInArrow(_placed, "conv long, task int, no int, k int, uid long, new string"))
    placed = (placed.join(texts.select(F.col("uid").alias("u"), "role", "text"), F.col("uid") == F.col("u"), "left")
              .select("conv", "task", "no", "k", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return Repaired(short, totals, write_shared(placed, "repaired-long"))


def damage(rows: DataFrame) -> DataFrame:
    """Damaged rows of the table, for trials: by crc32(``conv_id:turn``) % 20, 0 drops a row, 1 empties its text, 2 takes
    ``[.!?]`` out of it, 3 repeats it, 4 makes it the user's.  Nulls count as one space.  A dropped row stays with
    ``present`` false, so that its conversation is not forgotten."""
    p, names = positional(rows)
    conv, turn = at(names, "conv_id"), at(names, "turn")
    space = F.lit(" ")
    text = F.coalesce(at(names, "text"), space)
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))) % 20
    p = p.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(at(names, "role"), space).alias("role"), text.alias("text"), kind.alias("kind"))
    k = F.col("kind")
    p = p.withColumn("copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return p.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (k != 0).alias("present"))
