"""Repair of conversation structure by least-cost edits, ranked by prefix doubling.

The turns of a conversation and the roles that may stand next form a small automaton (nothing yet,
after a system turn, after a user turn, after an assistant turn). A node is a turn to come and a state;
arcs are the edits: delete (2), insert an empty turn (5), keep (0), change the role (1), and 5
more where a truncated turn stays. A dynamic programme from the end gives each node its least
cost; arcs on which the cost of both ends differs by just their own are optimal.

Of the optimal paths the one whose edits read least in ASCII is taken. An edit leads from a node to one
node only, so the least letter of a node's optimal arcs is the least audit of length one and names
its pointer. Doubling: with the rank of each node's least audit of length n and the node it leads
to, the pair of a node's rank and its pointer's rank orders the audits of length 2 n, and the
pointers are doubled. When every pointer stands at an end, ranks order whole audits (equal
ranks are equal audits, spelled once) and the doubled pointers give all nodes of a path at once.

Layout. Conversations are dealt to chunks of bounded size by a hash. A conversation above a size bound is
cut along its order into segments over many tasks: a segment's least costs from each state to each
state are a 4 x 4 table, tables are folded from the end, and with the cost at its end a segment is
ranked like a conversation. Only the digest of such a conversation reads it in one task, as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, text_batches, written

CHUNK_BYTES = 4 << 20
#: Conversations above this size (texts, roles and ``ROW_BYTES`` a turn) are cut into segments.
LARGE_BYTES = 8 << 20
ROW_BYTES = 64
SALTS = 32
#: Tables of large conversations are broadcast up to this number of them.
MOST_BROADCAST = 100_000

#: Fixed values of the edits: costs, letters (rank 0 is the end of an audit), states and roles.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LETTERS = np.frombuffer(b" DIKR", np.uint8)
ROLE_OF = {2: "user", 3: "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
#: State after a kept turn by its role's initial (s, u, a, other) and the state before; 4 is none.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: State after an inserted turn or a changed role.
NEXT = np.array([2, 2, 3, 2])
NEVER = 1 << 40
#: Least costs after the last turn: an audit may end with nothing or after an assistant turn.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, part long, step long, edit string, role string, text string"
STATS = "conv_id long, part long, blank long, duplicate long, truncated long, illegal long, head int, tail int, costs array<long>"
ENDS = "conv_id long, part long, final boolean, costs array<long>"
EXITS = "conv_id long, part long, exits array<int>"
ENTRIES = "conv_id long, part long, entry int"
PIECES = "conv_id long, part long, audit string, lines binary, some boolean"


class Turns:
    """Turns of many conversations (or of segments) in order, and their faults."""

    def __init__(self, rows: pa.Table, seen: bool = False):
        keys = [("conv_id", "ascending"), *([("seq", "ascending")] if seen else [("turn", "ascending"), ("role", "ascending"), ("tie", "ascending")])]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        self.rows, n = rows, rows.num_rows
        conv = rows.column("conv_id").to_pylist()
        new = [k for k in range(n) if not k or conv[k] != conv[k - 1]]
        self.names = [conv[k] for k in new]
        self.first = np.array([*new, n], np.int64)
        self.roles, self.texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        initial = {"s": 0, "u": 1, "a": 2}
        self.symbol = np.array([initial.get(r[:1], 3) for r in self.roles], np.int64)
        self.fault = np.zeros(n, np.int64)
        owner = np.repeat(np.arange(len(new)), np.diff(self.first)).tolist()
        ties, known, before = rows.column("tie").to_pylist(), rows.column("seen").to_pylist() if seen else None, set()
        for k, text in enumerate(self.texts):
            stripped = text.rstrip(SPACES)
            key = (owner[k], self.roles[k], ties[k])
            if not stripped:
                self.fault[k] = BLANK
            elif known[k] if known else key in before:
                self.fault[k] = DUPLICATE
            elif stripped[-1] not in ".!?":
                self.fault[k] = CUT
            if not known:
                before.add(key)

    def per_name(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[self.first])

    def counts(self) -> list[np.ndarray]:
        """Blank, duplicate, truncated turns and illegal neighbours of each conversation."""
        legal = np.zeros((4, 4), bool)
        legal[[0, 1, 2], [1, 2, 1]] = True
        bad = np.zeros(len(self.symbol), np.int64)
        bad[1:] = ~legal[self.symbol[:-1], self.symbol[1:]]
        bad[self.first[:-1][np.diff(self.first) > 0]] = 0
        return [*(self.per_name(self.fault == f) for f in (BLANK, DUPLICATE, CUT)), self.per_name(bad)]


def least_costs(fault: np.ndarray, symbol: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost to the end of every node (turns and one end a conversation, by 4 states), a step
    of all conversations at a time, from their last turns on."""
    n = len(first) - 1
    cost = np.empty((len(fault) + n, 4), np.int64)
    last = first[1:] + np.arange(n)
    cost[last] = ends
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for back, m in enumerate(active.tolist(), 1):
        conv = order[:m]
        row, node = first[conv + 1] - back, last[conv] - back
        after = cost[node + 1]
        low = after + DELETE
        stays = np.where(fault[row] == CUT, TRUNCATED, np.where(fault[row] > 0, NEVER, 0))[:, None]
        wide = np.concatenate([after, np.full((m, 1), NEVER)], 1)
        low = np.minimum(low, np.take_along_axis(wide, KEEP[symbol[row]], 1) + stays)
        low = np.minimum(low, after[:, NEXT] + REROLE + stays)
        out = low.copy()
        out[:, 2], out[:, 3] = np.minimum(low[:, 2], low[:, 3] + INSERT), np.minimum(low[:, 3], low[:, 2] + INSERT)
        out[:, :2] = np.minimum(low[:, :2], out[:, 2:3] + INSERT)
        cost[node] = out
    return cost


class Ranked:
    """Least optimal audits of all nodes by prefix doubling."""

    def __init__(self, fault, symbol, first, ends, final):
        n = len(first) - 1
        cost = least_costs(fault, symbol, first, ends)
        nodes = len(cost)
        is_end = np.zeros(nodes, bool)
        is_end[first[1:] + np.arange(n)] = True
        f, s = np.zeros(nodes, np.int64), np.full(nodes, 3)
        f[~is_end], s[~is_end] = fault, symbol
        closing = np.zeros(nodes, bool)
        closing[is_end] = final
        state = np.arange(4)
        at = np.arange(nodes)[:, None] * 4
        after = np.concatenate([cost[1:], np.full((min(1, nodes), 4), NEVER)])
        wide = np.concatenate([after, np.full((nodes, 1), 2 * NEVER)], 1)
        stays = np.where(f == CUT, TRUNCATED, np.where(f > 0, NEVER, 0))[:, None]
        turn = ~is_end[:, None]
        # Optimal arcs in the order of their letters; the first one that a node has is its least.
        found = [turn & (cost == after + DELETE),
                 (turn | closing[:, None]) & (cost == cost[:, NEXT] + INSERT),
                 turn & (KEEP[s] < 4) & (cost == np.take_along_axis(wide, KEEP[s], 1) + stays),
                 turn & (cost == after[:, NEXT] + REROLE + stays)]
        leads = [at + 4 + state, at + NEXT + np.zeros_like(at), at + 4 + np.minimum(KEEP[s], 3), at + 4 + NEXT]
        letter = np.select(found, [1, 2, 3, 4], 0)
        pointer = np.select(found, leads, at + state)
        self.cost, self.letter = cost, letter.reshape(-1).astype(np.int64)
        self.start = (first[:-1] + np.arange(n)) * 4
        self.pointers = [pointer.reshape(-1).astype(np.int32)]
        rank = self.letter
        while self.letter[self.pointers[-1]].any():
            pointer = self.pointers[-1]
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            self.pointers.append(pointer[pointer])
        self.rank = rank

    def paths(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each start's least path, end to end, and the cuts between starts."""
        who, step, node = np.arange(len(start)), np.zeros(len(start), np.int64), start
        some = self.letter[node] > 0
        who, step, node = who[some], step[some], node[some]
        for level in range(len(self.pointers) - 1, -1, -1):
            far = self.pointers[level][node]
            some = self.letter[far] > 0
            who, step, node = np.concatenate([who, who[some]]), np.concatenate([step, step[some] + (1 << level)]), np.concatenate([node, far[some]])
        order = np.lexsort((step, who))
        return node[order], np.searchsorted(who[order], np.arange(len(start) + 1))


def spelled(turns: Turns, ranked: Ranked, start: np.ndarray):
    """Of each start: the audit and the repaired turns as (edit, role, text)."""
    nodes, cuts = ranked.paths(start)
    letters = ranked.letter[nodes]
    flat, audits = LETTERS[letters].tobytes().decode("ascii"), {}
    for k, r in enumerate(ranked.rank[start].tolist()):  # equal ranks are equal audits
        if r not in audits:
            audits[r] = flat[cuts[k] : cuts[k + 1]]
    owner = np.repeat(np.arange(len(start)), np.diff(cuts))
    name = np.searchsorted(ranked.start, start, "right") - 1
    row, to = nodes // 4 - name[owner], NEXT[nodes % 4]
    lines = [[] for _ in start]
    for k, edit, r, t in zip(owner.tolist(), letters.tolist(), row.tolist(), to.tolist()):
        if edit == 2:
            lines[k].append(("I", ROLE_OF[t], ""))
        elif edit == 3:
            lines[k].append(("K", turns.roles[r], turns.texts[r]))
        elif edit == 4:
            lines[k].append(("R", ROLE_OF[t], turns.texts[r]))
        else:
            lines[k].append(("D", None, None))
    return [audits[r] for r in ranked.rank[start].tolist()], lines


def _joined(lines) -> bytes:
    return "\n".join(f"{role}:{text}" for edit, role, text in lines if edit != "D").encode("utf-8")


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0


def _report(rows: pa.Table) -> pa.Table:
    """Whole conversations of one chunk."""
    every = dict.fromkeys(rows.column("conv_id").to_pylist())
    turns = Turns(rows.filter(rows.column("present")))
    n = len(turns.names)
    ranked = Ranked(turns.fault, turns.symbol, turns.first, AT_END, True)
    audits, lines = spelled(turns, ranked, ranked.start)
    counts, position = turns.counts(), turns.rows.column("turn").to_pylist()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for k in range(n):
        every[turns.names[k]] = (_gaps(position[turns.first[k] : turns.first[k + 1]]), *(int(c[k]) for c in counts),
                                 int(ranked.cost.reshape(-1)[ranked.start[k]]), audits[k], hashlib.sha256(_joined(lines[k])).hexdigest())
    cols = zip(*((conv, *(found or empty)) for conv, found in every.items()))
    return pa.table([pa.array(c, pa.int64() if k < 7 else pa.string()) for k, c in enumerate(cols)], names=[c.split()[0] for c in REPORT.split(", ")])


def _listed(rows: pa.Table) -> pa.Table:
    """The edits and repaired turns of whole conversations of one chunk."""
    turns = Turns(rows.filter(rows.column("present")))
    _, lines = spelled(turns, ranked := Ranked(turns.fault, turns.symbol, turns.first, AT_END, True), ranked.start)
    return _turn_table([(conv, 0, k, *line) for conv, each in zip(turns.names, lines) for k, line in enumerate(each)])


def _turn_table(found: list) -> pa.Table:
    cols = list(zip(*found)) or [[]] * 6
    return pa.table([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(cols)], names=[c.split()[0] for c in TURNS.split(", ")])


# Large conversations: segments of one order, found in several passes over the same written table.


def _tables(rows: pa.Table) -> pa.Table:
    """Per segment: counts, the outer roles, and the least costs from each state to each state."""
    turns, part = Turns(rows, True), rows.column("part")[0].as_py()
    costs = []
    for k in range(4):
        ends = np.full(4, NEVER)
        ends[k] = 0
        costs.append(least_costs(turns.fault, turns.symbol, turns.first, ends)[turns.first[:-1] + np.arange(len(turns.names))])
    table = np.stack(costs, 2).reshape(len(turns.names), 16)  # from state to state
    cols = [turns.names, [part] * len(turns.names), *turns.counts(), turns.symbol[turns.first[:-1]], turns.symbol[turns.first[1:] - 1], table.tolist()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 6, pa.int32(), pa.int32(), pa.list_(pa.int64())])], names=[c.split()[0] for c in STATS.split(", ")])


def _from_the_end(rows: pa.Table) -> pa.Table:
    """The least costs at the end of each segment of one conversation."""
    order = sorted(zip(rows.column("part").to_pylist(), rows.column("costs").to_pylist()), reverse=True)
    after, out = AT_END, []
    for k, (part, table) in enumerate(order):
        out.append((part, not k, after.tolist()))
        after = np.minimum((np.array(table, np.int64).reshape(4, 4) + after).min(1), NEVER)
    cols = [[rows.column("conv_id")[0].as_py()] * len(out), *zip(*out)]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))], names=[c.split()[0] for c in ENDS.split(", ")])


def _ranked_segments(rows: pa.Table, ends: pa.Table) -> tuple[Turns, Ranked, list]:
    turns = Turns(rows, True)
    known = {r["conv_id"]: r for r in ends.to_pylist()}
    mine = [known[c] for c in turns.names]
    return turns, Ranked(turns.fault, turns.symbol, turns.first, np.array([m["costs"] for m in mine]), np.array([m["final"] for m in mine])), mine


def _exits(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """The state in which a segment's least path ends, from each state at its start."""
    turns, ranked, _ = _ranked_segments(rows, ends)
    out = ranked.pointers[-1][ranked.start[:, None] + np.arange(4)] % 4
    cols = [turns.names, [rows.column("part")[0].as_py()] * len(out), out.tolist()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=[c.split()[0] for c in EXITS.split(", ")])


def _from_the_start(rows: pa.Table) -> pa.Table:
    state, out = 0, []
    for part, exits in sorted(zip(rows.column("part").to_pylist(), rows.column("exits").to_pylist())):
        out.append((part, state))
        state = exits[state]
    cols = [[rows.column("conv_id")[0].as_py()] * len(out), *zip(*out)]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=[c.split()[0] for c in ENTRIES.split(", ")])


def _segments(large: DataFrame, volume: int, segment_bytes: int) -> DataFrame:
    """Turns of large conversations with ``seen`` (role and text occur earlier), cut along their
    order into parts; ``seq`` is the order. Written, so that every pass reads the same cut."""
    rows = written(large.withColumn("row", F.monotonically_increasing_id()), "large")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    # The first of equal turns meets the others by salt, so that a text that fills a conversation is spread.
    salt = F.pmod("row", F.lit(SALTS)).cast("int")
    firsts = rows.withColumn("o", order).withColumn("salt", salt).groupBy("conv_id", "role", "tie").agg(
        F.min("o").alias("least"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tie").alias("t"), "least", F.explode("salts").alias("s"))
    rows = rows.withColumn("o", order).withColumn("salt", salt)
    same = rows["conv_id"].eqNullSafe(firsts["c"]) & (rows["role"] == firsts["r"]) & (rows["tie"] == firsts["t"]) & (rows["salt"] == firsts["s"])
    marked = rows.join(firsts, same, "left").withColumn("seen", F.coalesce(F.col("o") > F.col("least"), F.lit(False)))
    marked = marked.select("conv_id", "turn", "role", "text", "tie", "row", "seen")
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "row"]
    cut = marked.repartitionByRange(parts(volume, segment_bytes, 2), *keys).sortWithinPartitions(*keys)
    return written(cut.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "segments")


def _large(large: DataFrame, volume: int, segment_bytes: int):
    """Segments, their tables, and for each segment the cost at its end and the state at its start."""
    rows = _segments(large, volume, segment_bytes)
    stats = written(rows.groupBy("part").applyInArrow(lambda t: _tables(t), STATS), "tables")
    ends = written(stats.select("conv_id", "part", "costs").groupBy("conv_id").applyInArrow(lambda t: _from_the_end(t), ENDS), "ends")
    exits = rows.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(lambda a, b: _exits(a, b), EXITS)
    entries = exits.groupBy("conv_id").applyInArrow(lambda t: _from_the_start(t), ENTRIES)
    known = ends.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p").join(entries, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part"))).drop("c", "p")
    return rows, stats, written(known, "entries")


def _large_turns(rows: DataFrame, known: DataFrame) -> DataFrame:
    def run(table, ends):
        turns, ranked, mine = _ranked_segments(table, ends)
        _, lines = spelled(turns, ranked, ranked.start + np.array([m["entry"] for m in mine]))
        part = table.column("part")[0].as_py()
        return _turn_table([(conv, part, k, *line) for conv, each in zip(turns.names, lines) for k, line in enumerate(each)])

    return rows.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, TURNS)


def _large_report(rows: DataFrame, stats: DataFrame, known: DataFrame) -> DataFrame:
    def run(table, ends):
        turns, ranked, mine = _ranked_segments(table, ends)
        audits, lines = spelled(turns, ranked, ranked.start + np.array([m["entry"] for m in mine]))
        kept = [[x for x in each if x[0] != "D"] for each in lines]
        cols = [turns.names, [table.column("part")[0].as_py()] * len(kept), audits, [_joined(x) for x in kept], [bool(x) for x in kept]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()))], names=[c.split()[0] for c in PIECES.split(", ")])

    def digest(batches):
        """Streams the pieces of each conversation in order through one hash."""
        held, audit, some, state = None, [], False, hashlib.sha256()

        def close():
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([held[0]], pa.int64()), "audit": ["".join(audit)], "repaired_sha256": [state.hexdigest()]})

        for b in batches:
            for r in b.to_pylist():
                if held != (r["conv_id"],):
                    if held:
                        yield close()
                    held, audit, some, state = (r["conv_id"],), [], False, hashlib.sha256()
                audit.append(r["audit"])
                if r["some"]:
                    state.update((b"\n" if some else b"") + r["lines"])
                    some = True
        if held:
            yield close()

    pieces = rows.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, PIECES)
    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")
    # Neighbours across a cut, and the cost of the whole from its first segment's table.
    pair = F.col("part")
    line = stats.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(pair, "head", "tail"))).alias("s"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
                                        F.min_by("costs", "part").alias("costs"))
    legal = F.array(*(F.lit(x) for x in (1, 6, 9)))  # head after tail: tail * 4 + head of su, ua, au
    across = F.aggregate(F.sequence(F.lit(1), F.size("s") - 1), F.lit(0).cast("long"), lambda n, k: n + (~F.array_contains(legal, F.get("s", k - 1)["tail"] * 4 + F.get("s", k)["head"])).cast("long"))
    line = line.withColumn("illegal", F.col("illegal") + F.when(F.size("s") > 1, across).otherwise(0)).drop("s")
    first = known.groupBy("conv_id").agg(F.min_by("costs", "part").alias("end"))
    cost = F.array_min(F.zip_with(F.slice("costs", 1, 4), "end", lambda a, b: a + b))
    line = line.withColumnRenamed("conv_id", "c").join(first.withColumnRenamed("conv_id", "f"), F.col("c").eqNullSafe(F.col("f"))).withColumn("cost", cost)
    line = line.join(digests, F.col("c").eqNullSafe(F.col("conv_id")))
    spans = rows.groupBy(F.col("conv_id").alias("g")).agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))).alias("gaps"))
    return line.join(spans, F.col("c").eqNullSafe(F.col("g"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _split(turns: DataFrame, present: str | None, large_bytes: int):
    """Turns with the needed columns, dealt to chunks, and the large conversations apart."""
    text_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    rows = rows.withColumn("tie", F.md5(F.col("text").cast("binary")))
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + F.octet_length("role") + ROW_BYTES).alias("volume"))
    sizes = written(sizes, "sizes")
    volume = int(sizes.agg(F.sum("volume")).first()[0] or 0)
    over = sizes.filter(F.col("volume") > large_bytes).select(F.col("conv_id").alias("big"), F.col("volume").alias("bytes"))
    total = over.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("v")).first()
    whole, large = rows, None
    if total["n"]:
        side = F.broadcast(over.select("big")) if total["n"] <= MOST_BROADCAST else over.select("big")
        large = rows.filter("present").drop("present").join(side, F.col("conv_id").eqNullSafe(F.col("big"))).drop("big")
        whole = rows.join(side, F.col("conv_id").eqNullSafe(F.col("big")), "left_anti")
    chunk = F.pmod(F.xxhash64("conv_id"), F.lit(parts(volume, CHUNK_BYTES))).cast("int")
    return whole.withColumn("chunk", chunk), large, over, int(total["v"] or 0)


def repair_report(turns: DataFrame, present: str | None = None, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """One row per conversation: gaps in its turn numbers, blank, duplicate and truncated turns, illegal
    neighbours, the least cost of a repair, its audit (D, I, K, R) and the digest of the repaired turns.

    Turns are taken by turn number, nulls first; equal numbers by role and the MD5 of the text.
    A null role or text is one space; rows without a conv_id are one conversation. ``present`` names a
    boolean column: rows where it is false only make their conversation known. A conversation without
    rows has zeros and an empty audit; an empty table gives an empty result; other columns are not read."""
    whole, large, over, volume = _split(turns, present, large_bytes)
    out = whole.groupBy("chunk").applyInArrow(lambda t: _report(t), REPORT)
    if large is None:
        return out
    rows, stats, known = _large(large, volume, max(1, large_bytes))
    found = _large_report(rows, stats, known).withColumnRenamed("conv_id", "c")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = over.join(found, F.col("big").eqNullSafe(F.col("c")), "left").select(
        F.col("big").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return out.unionByName(found)


def repaired_turns(turns: DataFrame, present: str | None = None, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """The edits of every conversation in order (conv_id, part, step): edit, and the role and text of the
    turn that stays or comes in (null where one is deleted). Cases as in ``repair_report``."""
    whole, large, _, volume = _split(turns, present, large_bytes)
    out = whole.groupBy("chunk").applyInArrow(lambda t: _listed(t), TURNS)
    if large is None:
        return out
    rows, _, known = _large(large, volume, max(1, large_bytes))
    return out.unionByName(_large_turns(rows, known))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20 (a null there is one
    space): 0 drops the row (``present`` is false), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it,
    4 makes it a user's. A null role or text is one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("_fault"))
    fault = F.col("_fault")
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), copies.alias("_copy")).drop("_copy")
