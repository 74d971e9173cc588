"""Repair of the turn structure of conversations, by least cost and with block tables.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept (cost 0),
given the role user or assistant (Rerole, 3), deleted (4) or put in with an empty text
(Insert, 3); a truncated row that stays costs 3 more; blank and duplicate rows must go.

**Block tables.** Four states say what may follow: nothing yet, after the system turn,
after a user turn, after an assistant turn. Read backwards, the costs to finish from
each state form a vector; less its minimum only a few vectors occur, as each state is a
bounded number of edits from the others. A row is one of nine symbols (must go; or one
of four roles, whole or truncated). For each vector and each block of four symbols a
table holds the vector before the block and the cost to add, so a conversation is read
four rows a lookup. To trace, each block is expanded backwards into the vectors between
its rows; then the rows are walked forward, each time by the least letter (D, I, K, R)
whose cost and remaining cost are those of the best way. As a letter leaves one choice
of role, that gives the ASCII-least of the cheapest edits.

**Scale.** Rows are dealt by ranges of (conversation, turn, role, start of the text) and
cut into segments of ``rows`` symbols, so a conversation of any length spreads over
tasks. A conversation that lies in one segment is repaired there. For the others each
segment yields its map of vectors and states; two scans over these small maps (one
backwards for costs, one forward for states) give each segment what it starts with, and
all segments are then repaired at once. Only the digest of the whole text reads a long
conversation in order, as a stream. Equal rows are counted before they are dealt.
Earlier copies are found by a grouped minimum over (conversation, digest).

Edge cases: a null in turn, role or text counts as one space, but a null turn sorts
first and is left out of ``gaps``; null conversation ids are one conversation. Rows of
one turn are ordered by role, then text. An empty role is none of the legal ones. Other
columns are ignored. A conversation without rows gives an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.session import materialize

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RANGE_CHARS = 64

#: States: start, after s, after u, after a. What an inserted or reroled row leads to.
STATES = 4
ADDED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: State after keeping a row of the class (s, u, a, other), or none.
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
FINISH = (0, 6, 3, 0)
FINISH_EDITS = ("", "II", "I", "")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SYMBOLS = 9
BLOCK = 4


def symbol_of(role: str, truncated: bool) -> int:
    """Symbol of a row that may stay; 0 is a row that must go."""
    kind = "sua".find(role[0]) if role else -1
    return 1 + 2 * (kind if kind >= 0 else 3) + truncated


def _ways(after: tuple, symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost with what remains, next state) of the edits that use up the row."""
    ways = [("D", DELETE + after[state], state)]
    if symbol:
        role, more = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        kept = KEPT[state][role]
        if kept is not None:
            ways.append(("K", more + after[kept], kept))
        ways.append(("R", REROLE + more + after[ADDED[state]], ADDED[state]))
    return ways


def _before(after: tuple, symbol: int) -> tuple:
    """Costs to finish before a row, from those after it; inserts come before the row."""
    least = [min(cost for _, cost, _ in _ways(after, symbol, s)) for s in range(STATES)]
    once = [min(least[s], INSERT + least[ADDED[s]]) for s in range(STATES)]
    return tuple(min(least[s], INSERT + once[ADDED[s]]) for s in range(STATES))


class Tables:
    """Vectors that occur, steps over one symbol and over a block, and traces."""

    def __init__(self) -> None:
        vectors, place = [FINISH], {FINISH: 0}
        step, add = [], []
        for vector in vectors:  # grows while it is read
            row, costs = [], []
            for symbol in range(SYMBOLS):
                found = _before(vector, symbol)
                low = min(found)
                normal = tuple(v - low for v in found)
                if normal not in place:
                    place[normal] = len(vectors)
                    vectors.append(normal)
                row.append(place[normal])
                costs.append(low)
            step.append(row)
            add.append(costs)
        self.vectors, self.step = vectors, step
        self.trace = [
            [[self._letters(vector, _before(vector, symbol), symbol, s) for s in range(STATES)] for symbol in range(SYMBOLS)]
            for vector in vectors
        ]
        self.block, self.block_add = np.array(step), np.array(add)
        size = 1
        while size < BLOCK:  # the block's last symbols are read first
            to, cost = self.block, self.block_add
            self.block = to[to].transpose(0, 2, 1).reshape(len(to), -1)
            self.block_add = (cost[:, :, None] + cost[to]).transpose(0, 2, 1).reshape(len(to), -1)
            size *= 2
        self.add = add
        self.block_rows, self.block_costs = self.block.tolist(), self.block_add.tolist()

    @staticmethod
    def _letters(after: tuple, before: tuple, symbol: int, state: int) -> tuple[str, int]:
        letters = ""
        while True:
            ways = _ways(after, symbol, state)
            if INSERT + before[ADDED[state]] == before[state]:
                ways.append(("I", before[state], None))
            letter, _, to = min(way for way in ways if way[1] == before[state])
            letters += letter
            if letter != "I":
                return letters, to
            state = ADDED[state]

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """The first symbols that fill no block, and the codes of the blocks."""
        loose = len(symbols) % BLOCK
        weights = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        return symbols[:loose].tolist(), (symbols[loose:].reshape(-1, BLOCK) @ weights).tolist()

    def map_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after the symbols: the vector before them and the cost added."""
        loose, codes = self.blocks(symbols)
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in reversed(codes):
            cost += self.block_add[at, code]
            at = self.block[at, code]
        step, add = np.array(self.step), np.array(self.add)
        for symbol in reversed(loose):
            cost += add[at, symbol]
            at = step[at, symbol]
        return at, cost

    def between(self, symbols: np.ndarray, after: int) -> tuple[list[int], int]:
        """The vector after each symbol, and the cost from the first state."""
        loose, codes = self.blocks(symbols)
        cost, ends = 0, []
        for code in reversed(codes):
            ends.append(after)
            cost += self.block_costs[after][code]
            after = self.block_rows[after][code]
        rows = symbols.tolist()
        vectors = [0] * len(rows)
        for k, end in enumerate(ends):  # expand each block backwards
            last = len(rows) - 1 - BLOCK * k
            for i in range(last, last - BLOCK, -1):
                vectors[i] = end
                end = self.step[end][rows[i]]
        for i in range(len(loose) - 1, -1, -1):
            vectors[i] = after
            cost += self.add[after][rows[i]]
            after = self.step[after][rows[i]]
        return vectors, cost + self.vectors[after][0]

    def edits(self, symbols: np.ndarray, vectors: list[int], state: int) -> tuple[list[str], int]:
        """The letters of each row, and the state after the last."""
        found = []
        for symbol, after in zip(symbols.tolist(), vectors, strict=True):
            letters, state = self.trace[after][symbol][state]
            found.append(letters)
        return found, state


@cache
def tables() -> Tables:
    return Tables()


def repaired_rows(edits: list[str], state: int, rows: list[tuple[str, str]], finish: bool) -> tuple[str, list[str], int]:
    """Audit, the repaired ``role:text`` lines and the state after them. ``rows`` holds
    (role, text) of the rows that may stay, by which the edits are applied."""
    audit, out = [], []
    for letters, (role, text) in zip(edits, rows, strict=True):
        for letter in letters:
            if letter in "IR":
                state = ADDED[state]
                out.append(f"{ROLE[state]}:{text if letter == 'R' else ''}")
            elif letter == "K":
                state = KEPT[state]["sua".find(role[0])]
                out.append(f"{role}:{text}")
        audit.append(letters)
    if finish:
        audit.append(FINISH_EDITS[state])
        for _ in FINISH_EDITS[state]:
            state = ADDED[state]
            out.append(f"{ROLE[state]}:")
    return "".join(audit), out, state


def damage_kind() -> Column:
    """What crc32 of ``conv_id:turn`` does to a row: 0 drops it."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.concat_ws(":", *names).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage; ``n`` is 2 where a row is repeated."""
    blank, text, kind = F.lit(" "), F.coalesce("text", F.lit(" ")), F.col("kind")
    return (
        conversations.select("conv_id", "turn", "role", "text", damage_kind().alias("kind"))
        .where("kind != 0")
        .select(
            "conv_id", "turn",
            F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.when(kind == 3, 2).otherwise(1).alias("n"),
        )
    )


def _faults(conversations: DataFrame) -> DataFrame:
    """Distinct rows with how often they come and whether role and text came in an earlier turn."""
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    turn = F.col("turn").cast("long")
    rows = (
        conversations.select(
            "conv_id", turn.alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"), F.col("n").cast("long").alias("n"),
        )
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
        .withColumn("digest", digest)
        .withColumn("named", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
        .withColumn("none", F.col("conv_id").isNull())
    )
    rows = materialize(rows, "turns")
    # a null turn is the first: one below the least value that a turn can take as decimal
    order = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.expr("CAST('-9223372036854775809' AS DECIMAL(20,0))"))
    first = rows.groupBy("none", "named", "digest").agg(F.min(order).alias("first"))
    return rows.join(first, ["none", "named", "digest"]).withColumn("later", order > F.col("first"))


SEGMENT = (
    "part int, seg int, done boolean, symbols binary, roles array<string>, texts array<string>, "
    "blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "low long, high long, first_turn long, last_turn long, turns long, cost long, audit string, repaired string"
)
LEGAL = {"su", "ua", "au"}


class _Segment:
    """Symbols of consecutive rows of a conversation, and what is counted on them."""

    def __init__(self, conv) -> None:
        self.conv, self.symbols, self.rows, self.chars = conv, bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = self.first_turn = self.last_turn = None

    def put(self, turn, role: str, text: str, later: bool, room: int, n: int) -> int:
        """Add up to ``room`` of ``n`` equal rows; returns how many are left."""
        took = min(n, room)
        bare = text.rstrip(SPACE)
        symbol = 0
        if not bare:
            self.blank += took
        elif later:
            self.duplicate += took
        else:
            cut = bare[-1] not in ENDS
            self.truncated += cut
            self.duplicate += took - 1
            symbol = symbol_of(role, cut)
            self.rows.append((len(self.symbols), role, text))
            self.chars += len(text)
        self.symbols.append(symbol)
        self.symbols.extend(bytes(took - 1))
        initial = role[:1]
        if self.tail is None:
            self.head, self.first_turn = initial, turn
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += took - 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.high = turn
            self.turns += self.last_turn != turn
        self.tail, self.last_turn = initial, turn
        return n - took

    def row(self, part: int, seg: int, done: bool) -> dict:
        out = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "head", "tail")}
        out |= {k: getattr(self, k) for k in ("low", "high", "first_turn", "last_turn", "turns")}
        out |= {"conv_id": self.conv, "part": part, "seg": seg, "done": done}
        if not done:
            return out | {
                "symbols": bytes(self.symbols), "roles": [r for _, r, _ in self.rows], "texts": [t for _, _, t in self.rows],
            }
        symbols = np.frombuffer(self.symbols, np.uint8)
        vectors, cost = tables().between(symbols, 0)
        edits, _ = tables().edits(symbols, vectors, 0)
        audit, lines, _ = repaired_rows(edits, 0, _spread(symbols, [r for _, *r in self.rows]), True)
        return out | {"cost": cost, "audit": audit, "repaired": "\n".join(lines) if lines else None}


def _spread(symbols: np.ndarray, rows: list) -> list[tuple[str, str]]:
    """(role, text) by symbol; a row that must go needs none."""
    left = iter(rows)
    return [tuple(next(left)) if s else ("", "") for s in symbols.tolist()]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _schema(conv: pa.DataType, ddl: str) -> pa.Schema:
    fields = [f.strip().split(" ") for f in ddl.split(", ")]
    return pa.schema([("conv_id", conv), *[(name, _ARROW[kind]) for name, kind in fields]])


def _cut(most_rows: int, most_chars: int):
    """Sorted rows of a range to segments; those of a whole short conversation are done."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind: list[pa.DataType] = []

        def segments() -> Iterator[dict]:
            now, seg, edge, cut = None, 0, True, False  # edge: the conversation may begin before this range
            for batch in batches:
                kind.append(batch.schema.field("conv_id").type)
                for conv, turn, role, text, n, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if now is not None and now.conv != conv:
                        yield now.row(part, seg, not edge and not cut)
                        now, seg, edge, cut = None, seg + 1, False, False
                    while n:
                        if now is not None and (len(now.symbols) >= most_rows or now.chars >= most_chars):
                            yield now.row(part, seg, False)
                            now, seg, cut = None, seg + 1, True
                        now = now or _Segment(conv)
                        n = now.put(turn, role, text, later, most_rows - len(now.symbols), n)
                        later = True  # the other copies of a row
            if now is not None:
                yield now.row(part, seg, False)

        rows = segments()
        first = next(rows, None)
        if first is not None:
            yield from _batches((r for some in ([first], rows) for r in some), _schema(kind[0], SEGMENT))

    return make


MAPS = "part int, seg int, to binary, costs binary, ends binary"
RIGHTS = "part int, seg int, after int, last boolean, cost long, ends binary"
STARTS = "part int, seg int, after int, last boolean, cost long, state int"


def _map_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's map of vectors, and its last state by vector after it and first state."""
    of = tables()
    for batch in batches:
        def rows(batch=batch) -> Iterator[dict]:
            for row in batch.to_pylist():
                symbols = np.frombuffer(row["symbols"], np.uint8)
                to, costs = of.map_of(symbols)
                ends = bytearray()
                for vector in range(len(of.vectors)):
                    between, _ = of.between(symbols, vector)
                    ends.extend(of.edits(symbols, between, s)[1] for s in range(STATES))
                yield {
                    "conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"],
                    "to": to.astype("<u2").tobytes(), "costs": costs.astype("<i8").tobytes(), "ends": bytes(ends),
                }

        yield from _batches(rows(), _schema(batch.schema.field("conv_id").type, MAPS))


def _scan(step, ddl: str):
    """Run ``step(row, carried)`` over sorted rows; what it carries begins anew with each conversation."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, carried = False, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not started or row["conv_id"] != conv:
                    started, conv, carried = True, row["conv_id"], None
                found, carried = step(row, carried)
                out.append(found | {k: row[k] for k in ("conv_id", "part", "seg")})
            yield from _batches(iter(out), _schema(batch.schema.field("conv_id").type, ddl), 4096)

    return make


def _backward(row: dict, carried) -> tuple[dict, tuple]:
    after, cost = carried or (0, 0)
    to, costs = np.frombuffer(row["to"], "<u2"), np.frombuffer(row["costs"], "<i8")
    before, total = int(to[after]), cost + int(costs[after])
    found = {
        "after": after, "last": carried is None, "cost": total + tables().vectors[before][0],
        "ends": row["ends"][STATES * after : STATES * after + STATES],
    }
    return found, (before, total)


def _forward(row: dict, carried) -> tuple[dict, int]:
    state = carried or 0
    return {k: row[k] for k in ("after", "last", "cost")} | {"state": state}, row["ends"][state]


def _repair_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = tables()
    for batch in batches:
        audits, texts = [], []
        columns = [batch.column(c).to_pylist() for c in ("symbols", "roles", "texts", "after", "last", "state")]
        for symbols, roles, own, after, last, state in zip(*columns, strict=True):
            symbols = np.frombuffer(symbols, np.uint8)
            edits, _ = of.edits(symbols, of.between(symbols, after)[0], state)
            rows = _spread(symbols, list(zip(roles, own, strict=True)))
            audit, lines, _ = repaired_rows(edits, state, rows, last)
            audits.append(audit)
            texts.append("\n".join(lines) if lines else None)
        kept = batch.select([c for c in batch.schema.names if c not in ("symbols", "roles", "texts", "after", "last", "state")])
        columns = [*kept.columns, pa.array(audits, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "audit", "repaired"])


COUNTED = ("blank", "duplicate", "truncated", "illegal")
PIECE = "part int, seg int, " + ", ".join(
    [f"{c} long" for c in COUNTED]
    + ["head string", "tail string", "low long", "high long", "first_turn long", "last_turn long", "turns long", "cost long"]
    + ["audit string", "repaired string"]
)


def repair(conversations: DataFrame, rows: int = 512, chars: int = 1 << 22) -> DataFrame:
    """Pieces of repaired conversations: conv_id, their order (part, seg), counts of the
    faults, the audit of the edits and the repaired text (lines ``role:text``; null if
    there is none) of each. A conversation of up to ``rows`` rows and ``chars``
    characters is one piece, unless a range of the input ends in it.

    ``conversations`` has conv_id, turn, role, text and, if rows are repeated, ``n``.
    """
    if "n" not in conversations.columns:
        conversations = conversations.withColumn("n", F.lit(1))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    spark = conversations.sparkSession
    role = F.substring("role", 1, RANGE_CHARS)
    text = F.when(F.length("role") <= RANGE_CHARS, F.substring("text", 1, RANGE_CHARS)).otherwise("")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    dealt = (
        _faults(conversations).select("conv_id", "turn", "role", "text", "n", "later")
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, role, text)
        .sortWithinPartitions(*order, "role", "text")
    )
    found = materialize(dealt.mapInArrow(_cut(rows, chars), f"conv_id {kind}, {SEGMENT}"), "segments")
    names = ["conv_id", *[f.split(" ")[0] for f in PIECE.split(", ")]]
    whole = found.where("done").select(names)

    parts = found.where("not done")
    maps = parts.select("conv_id", "part", "seg", "symbols").mapInArrow(_map_segments, f"conv_id {kind}, {MAPS}")
    down = [F.asc_nulls_first("conv_id"), F.desc("part"), F.desc("seg")]
    rights = maps.repartition("conv_id").sortWithinPartitions(*down).mapInArrow(_scan(_backward, RIGHTS), f"conv_id {kind}, {RIGHTS}")
    up = [F.asc_nulls_first("conv_id"), "part", "seg"]
    starts = rights.repartition("conv_id").sortWithinPartitions(*up).mapInArrow(_scan(_forward, STARTS), f"conv_id {kind}, {STARTS}")
    starts = materialize(starts.drop("conv_id"), "segment-starts")
    joined = parts.drop("done", "cost", "audit", "repaired").join(starts, ["part", "seg"])
    kept = [n for n in names if n not in ("audit", "repaired")]
    ddl = f"conv_id {kind}, {PIECE}"
    mended = joined.select(*kept, "symbols", "roles", "texts", "after", "last", "state").mapInArrow(_repair_segments, ddl)
    return whole.withColumn("whole", F.lit(True)).unionByName(mended.withColumn("whole", F.lit(False)))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its sorted pieces; texts pass as a stream."""
    now: dict | None = None
    kind = None

    def close() -> dict:
        low, high = now["low"], now["high"]
        return {
            "conv_id": now["conv_id"], "gaps": 0 if low is None else high - low + 1 - now["turns"], "cost": now["cost"],
            "audit": "".join(now["audits"]), "repaired_sha256": now["digest"].hexdigest(),
        } | {c: now[c] for c in COUNTED}

    def rows() -> Iterator[dict]:
        nonlocal now, kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield close()
                    now = row | {"audits": [], "digest": hashlib.sha256(), "lines": False}
                else:
                    for c in COUNTED:
                        now[c] += row[c]
                    now["illegal"] += now["tail"] + row["head"] not in LEGAL
                    again = row["first_turn"] is not None and row["first_turn"] == now["last_turn"]
                    now["turns"] += row["turns"] - again
                    if row["low"] is not None:
                        now["low"] = row["low"] if now["low"] is None else now["low"]
                        now["high"] = row["high"]
                    now["tail"], now["last_turn"] = row["tail"], row["last_turn"]
                now["audits"].append(row["audit"])
                if row["repaired"] is not None:
                    now["digest"].update((b"\n" if now["lines"] else b"") + row["repaired"].encode())
                    now["lines"] = True
        if now is not None:
            yield close()

    found = rows()
    first = next(found, None)
    if first is not None:
        yield from _batches((r for some in ([first], found) for r in some), _schema(kind, REPORT))


def _report(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost, audit and digest of its repaired text."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    digest = F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256)
    names = ["conv_id", *[f.split(" ")[0] for f in REPORT.split(", ")]]
    single = pieces.where("whole").withColumn("gaps", gaps).withColumn("repaired_sha256", digest).select(names)
    up = [F.asc_nulls_first("conv_id"), "part", "seg"]
    others = pieces.where("not whole").drop("whole").repartition("conv_id").sortWithinPartitions(*up)
    return single.unionByName(others.mapInArrow(_fold, f"conv_id {kind}, {REPORT}").select(names))


def _absent(conversations: DataFrame) -> DataFrame:
    """Reports of the conversations that the damage leaves without rows."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTED, "cost")]
    gone = conversations.groupBy("conv_id").agg(F.max(damage_kind() != 0).alias("left")).where("not left")
    empty = F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256")
    return gone.select("conv_id", *zero, F.lit("").alias("audit"), empty)


def damage_and_repair(conversations: DataFrame, rows: int = 512, chars: int = 1 << 22) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of each conversation of the table, after damage and repair."""
    found = _report(repair(damaged(conversations), rows, chars))
    return found.unionByName(_absent(conversations))
