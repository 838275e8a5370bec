"""Conversation structure repair: turns aligned to the strings of an alternating grammar at least cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: an optional system turn, then user and
assistant in turn. Its turns are aligned (Wagner-Fischer) with the grammar's strings of every feasible length: a turn is
kept (K), given the other role (R) or deleted (D), an empty turn is inserted (I). Strings that end alike share one
matrix, indexed by what is still to come, so its first row holds the costs of all lengths. A first matrix around the
diagonal gives the incumbent cost, a real alignment's; the second holds Ukkonen's band, the cells through which an
alignment of at most that cost can lead. The audits (letters of the edits) of all lengths of least cost are traced back
and the least in ASCII is taken.

Turns are put in order by one range shuffle, so a very long conversation lies in several tasks. Each cuts its turns into
pieces of at most ``PIECE`` and aligns a piece between any two states of the grammar (nothing yet, after s, after u,
after a). Of these a few numbers per piece meet in a fold, which says between which states each piece lies; the audits of
the pieces, one after the other, are the conversation's. Inserts stand before the next turn (behind the last one only at the
end), so that no audit of a piece begins another and comparing them piece by piece compares the whole ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import stage

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
PIECE = 256
#: What a turn is: its role's initial (s, u, a or another) times its first fault (none, blank, duplicate, truncated).
SYMBOLS = "ABCDEFGHIJKLMNOP"
INITIALS = "sua"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the grammar: nothing yet, after s, after u, after a; it may end in the first and the last.
EMPTY, S, U, A = range(4)
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}


def _matrix(symbols: str, end: int, last: bool, low: int, high: int) -> np.ndarray:
    """``m[i, o - low]``: least cost of turns i.. against the last r roles of a string that ends in state ``end``, where
    o = r - (turns left), for low <= o <= high."""
    n = len(symbols)
    o = np.arange(low, high + 1)
    m = np.full((n + 1, len(o)), FAR, np.int64)
    m[n][(o >= 0) if last else (o == 0)] = INSERT * o[(o >= 0) if last else (o == 0)]
    odd = "u" if end == U else "a"
    even = "a" if end == U else "u"
    for i in range(n - 1, -1, -1):
        initial, fault = divmod(SYMBOLS.index(symbols[i]), 4)
        r = o + (n - i)
        row = np.full(len(o), FAR, np.int64)
        row[:-1] = m[i + 1][1:] + DELETE
        if fault not in (BLANK, DUPLICATE):
            own = (INITIALS + "?")[initial]
            change = np.where(r % 2 == 1, KEEP if own == odd else REROLE, KEEP if own == even else REROLE) + (CUT_OFF if fault == TRUNCATED else 0)
            row = np.where(r > 0, np.minimum(row, m[i + 1] + change), row)
        row[r < 0] = FAR
        m[i] = np.minimum(np.minimum.accumulate(row - INSERT * o) + INSERT * o, FAR)
    return m


def _trace(symbols: str, m: np.ndarray, end: int, low: int, i: int, r: int) -> str:
    """The ASCII-least audit of cost m at (i, r)."""
    n, out = len(symbols), []
    odd, even = ("u", "a") if end == U else ("a", "u")

    def at(i: int, r: int) -> int:
        o = r - (n - i) - low
        return int(m[i, o]) if r >= 0 and 0 <= o < m.shape[1] else FAR

    while i < n or r:
        cost = at(i, r)
        if i < n and cost == DELETE + at(i + 1, r):
            out.append("D")
            i += 1
        elif r and cost == INSERT + at(i, r - 1):
            out.append("I")
            r -= 1
        else:
            initial = SYMBOLS.index(symbols[i]) // 4
            out.append("K" if (INITIALS + "?")[initial] == (odd if r % 2 else even) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def _to_end(symbols: str, end: int, last: bool, begins: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """From each state of ``begins``: least cost and ASCII-least audit that lead to ``end`` (U or A) over ``symbols``."""
    n = len(symbols)
    kinds = [divmod(SYMBOLS.index(x), 4) for x in symbols]
    forced = sum(f in (BLANK, DUPLICATE) for _, f in kinds)
    heads = [i for i, (c, f) in enumerate(kinds) if c == S - 1 and f not in (BLANK, DUPLICATE)]

    def starts(m: np.ndarray, low: int, begin: int) -> list[tuple[int, str, int, int]]:
        """(cost, letters so far, turn, roles to come) of the feasible lengths."""
        parity = (0 if begin == U else 1) if end == U else (1 if begin == U else 0)
        found = []

        def lengths(i: int, so_far: int, letters: str, least: int) -> None:
            for o in range(m.shape[1]):
                r = o + low + n - i
                if r >= least and r % 2 == parity and m[i, o] < FAR:
                    found.append((so_far + int(m[i, o]), letters, i, r))

        lengths(0, 0, "", 0 if begin == end else 1)
        if begin == EMPTY:
            for i in heads:
                lengths(i + 1, DELETE * i + KEEP + (CUT_OFF if kinds[i][1] == TRUNCATED else 0), "D" * i + "K", 1)
        return found

    low, high = -forced - 2, 2
    m = _matrix(symbols, end, last, low, high)
    incumbent = max(min((c for c, *_ in starts(m, low, b)), default=FAR) for b in begins)
    if incumbent >= FAR:
        wide = -n - 2, n + 2  # nothing near the diagonal: the whole matrix
    else:
        wide = min(low, -(incumbent // DELETE) - 1), max(high, incumbent // INSERT + 1)
    if wide != (low, high):
        (low, high), m = wide, _matrix(symbols, end, last, *wide)
    out = {}
    for begin in begins:
        found = starts(m, low, begin)
        best = min((c for c, *_ in found), default=FAR)
        if best < FAR:
            out[begin] = best, min(letters + _trace(symbols, m, end, low, i, r) for c, letters, i, r in found if c == best)
    return out


@lru_cache(maxsize=5_000)
def between(symbols: str, last: bool, begin: int | None = None) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of a piece; only from ``begin`` if it is given."""
    n, out = len(symbols), {}
    begins = tuple(range(4)) if begin is None else (begin,)
    for b in begins:
        if b in (EMPTY, S):
            out[b, b] = DELETE * n, "D" * n
    if EMPTY in begins:
        kept = [(DELETE * (n - 1) + (CUT_OFF if f == TRUNCATED else 0), "D" * i + "K" + "D" * (n - 1 - i))
                for i, (c, f) in enumerate(divmod(SYMBOLS.index(x), 4) for x in symbols) if c == 0 and f not in (BLANK, DUPLICATE)]
        if kept:
            out[EMPTY, S] = min(kept)
    for end in (U, A):
        for b, found in _to_end(symbols, end, last, begins).items():
            out[b, end] = found
    return out


def best_audit(symbols: str) -> tuple[int, str]:
    """Cost and audit of a conversation that is one piece."""
    found = between(symbols, True, EMPTY)
    return min(found[EMPTY, e] for e in (EMPTY, A) if (EMPTY, e) in found)


def illegal_pairs(symbols: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    c = [(INITIALS + "?")[SYMBOLS.index(x) // 4] for x in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(c, c[1:]))


def fold(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The states before and after each piece on the least path from EMPTY to EMPTY or A. A piece is its costs and the
    ranks of its audits, 4 x 4 by states: the cost to go is summed from the end, then the least audit is taken forward."""
    to_go = np.empty((len(pieces) + 1, 4), np.int64)
    to_go[-1] = [0, FAR, FAR, 0]
    for i in range(len(pieces) - 1, -1, -1):
        to_go[i] = np.minimum((pieces[i][0] + to_go[i + 1][None, :]).min(1), FAR)
    at, out = EMPTY, []
    for i, (cost, rank) in enumerate(pieces):
        ways = np.nonzero(cost[at] + to_go[i + 1] == to_go[i][at])[0]
        to = int(min(ways, key=lambda t: rank[at][t]))
        out.append((at, to))
        at = to
    return out


def symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.substring(F.lit(SYMBOLS), kind * 4 + fault + 1, F.lit(1))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns -> pieces. A turn like the one before it (same tag) is a duplicate."""
    run, piece, conv, tag, held = TaskContext.get().partitionId(), 0, None, None, []
    out: list[tuple] = []

    def flush() -> None:
        nonlocal piece, held
        if held:
            out.append((conv, run, piece, "".join(held)))
            piece, held = piece + 1, []

    names = ["conv", "run", "piece", "symbols"]
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv").type
        for c, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if held and (c != conv or len(held) == PIECE):
                flush()
            if c == conv and t == tag and SYMBOLS.index(x) % 4 != BLANK:
                x = SYMBOLS[SYMBOLS.index(x) // 4 * 4 + DUPLICATE]
            conv, tag = c, t
            held.append(x)
        if out:
            yield _batch(out, names, kind)
            out = []
    flush()
    if out:
        yield _batch(out, names, kind)


def _batch(rows: list[tuple], names: list[str], conv: pa.DataType) -> pa.RecordBatch:
    types = {"conv": conv, "run": pa.int32(), "piece": pa.int64(), "symbols": pa.string(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64()), "begin": pa.int32(), "end": pa.int32(),
             "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[c]) for i, c in enumerate(names)], names=names)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> audits: of whole conversations, or between the states that the fold found."""
    for batch in batches:
        rows = []
        for conv, run, piece, symbols, begin, end, last in _columns(batch, "conv", "run", "piece", "symbols", "begin", "end", "last"):
            cost, audit = best_audit(symbols) if begin is None else between(symbols, last, begin)[begin, end]
            rows.append((conv, run, piece, symbols, audit, cost, illegal_pairs(symbols)))
        yield _batch(rows, ["conv", "run", "piece", "symbols", "audit", "cost", "illegal"], batch.schema.field("conv").type)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations -> their costs and the ranks of their audits between any two states."""
    for batch in batches:
        rows = []
        for conv, run, piece, symbols, last in _columns(batch, "conv", "run", "piece", "symbols", "last"):
            found = between(symbols, last)
            costs, ranks = [FAR] * 16, [0] * 16
            for b in range(4):
                order = sorted({found[b, e][1] for e in range(4) if (b, e) in found})
                for e in range(4):
                    if (b, e) in found:
                        costs[b * 4 + e], ranks[b * 4 + e] = found[b, e][0], order.index(found[b, e][1])
            rows.append((conv, run, piece, costs, ranks))
        yield _batch(rows, ["conv", "run", "piece", "costs", "ranks"], batch.schema.field("conv").type)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measured pieces in order -> the states between which each lies; holds the numbers of one conversation."""
    conv, places, held, kind = None, [], [], pa.int64()

    def done() -> pa.RecordBatch:
        return _batch([(conv, *at, *states) for at, states in zip(places, fold(held))], ["conv", "run", "piece", "begin", "end"], kind)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for c, run, piece, costs, ranks in _columns(batch, "conv", "run", "piece", "costs", "ranks"):
            if held and c != conv:
                yield done()
                places, held = [], []
            conv = c
            places.append((run, piece))
            held.append((np.array(costs).reshape(4, 4), np.array(ranks, np.int8).reshape(4, 4)))
    if held:
        yield done()


ORDER = ("turn", "role", "text")


def prepared(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """-> ``conv, turn, role, text``: the turns as the operator takes them. Null roles and texts are one space."""
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))


def audits(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` (of ``prepared``) -> ``conv, run, piece, symbols, audit, cost, illegal``: the edits of every
    conversation in pieces, in the order of run and piece. ``illegal`` counts neighbours inside the piece."""
    conv_type = turns.schema["conv"].dataType.simpleString()
    text = F.md5(F.col("text").cast("binary"))
    seen = (turns.withColumn("digest", text).groupBy("conv", "role", "digest")
            .agg(F.min("turn").alias("first"), F.max("turn").alias("end"), F.count("turn").alias("known"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("first") < F.col("end")) | ((F.col("known") < F.col("n")) & (F.col("known") > 0)))
            .select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), F.when(F.col("known") == F.col("n"), F.col("first")).alias("__first"), F.lit(True).alias("__again")))
    joined = turns.withColumn("digest", text).join(seen, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")), "left")
    later = F.coalesce(F.col("__again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("__first"))
    fault = (F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(later, DUPLICATE)
             .when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), TRUNCATED).otherwise(NONE))
    tag = F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "role", "digest")
    keyed = joined.select("conv", "turn", "role", "text", tag.alias("tag"), symbol(F.col("role"), fault).alias("symbol"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "tag", "symbol")
    pieces = stage(dealt.mapInArrow(_cut, f"conv {conv_type}, run int, piece long, symbols string"), "turns-pieces")
    whole = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("run", "piece")).alias("end")).withColumnRenamed("conv", "__conv")
    known = pieces.join(whole, F.col("conv").eqNullSafe(F.col("__conv"))).withColumn("last", (F.col("run") == F.col("end.run")) & (F.col("piece") == F.col("end.piece"))).drop("__conv", "end")
    solved = f"conv {conv_type}, run int, piece long, symbols string, audit string, cost long, illegal long"
    none = F.lit(None).cast("int")
    short = known.filter("n = 1").select("conv", "run", "piece", "symbols", none.alias("begin"), none.alias("end"), "last")
    long = known.filter("n > 1").drop("n")
    measured = long.mapInArrow(_measure, f"conv {conv_type}, run int, piece long, costs array<long>, ranks array<long>")
    states = measured.repartition("conv").sortWithinPartitions("conv", "run", "piece").mapInArrow(_join_pieces, f"conv {conv_type}, run int, piece long, begin int, end int")
    # A piece is known by run and piece alone.
    placed = long.join(states.drop("conv"), ["run", "piece"]).select("conv", "run", "piece", "symbols", "begin", "end", "last")
    return stage(short.unionByName(placed).mapInArrow(_solve, solved), "turns-audits")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its turns in order -> a row per edit. Holds one conversation's audit: a byte per edit."""
    conv, audit, at, step, out_at, head, begun = None, [], 0, 0, 0, False, False
    rows: list[tuple] = []
    names = ["conv", "step", "edit", "turn", "role", "text"]
    kinds: list[pa.DataType] = []

    def inserts() -> None:
        nonlocal at, step, out_at
        while at < len(letters) and letters[at] == "I":
            rows.append((conv, step, "I", None, ROLES["ua"[(out_at - head) % 2]], ""))
            at, step, out_at = at + 1, step + 1, out_at + 1

    letters = ""
    for batch in batches:
        kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string()]
        for c, own, turn, role, text in _columns(batch, "conv", "audit", "turn", "role", "text"):
            if not begun or c != conv:
                inserts()
                conv, audit, letters, at, step, out_at, head, begun = c, [], "", 0, 0, 0, False, True
            if own is not None:
                audit.append(own)
                continue
            if audit:
                letters, audit = "".join(audit), []
            inserts()
            edit = letters[at]
            if edit == "K" and not out_at:
                head = role[:1] == "s"
            new = None if edit == "D" else role if edit == "K" else ROLES["ua"[(out_at - head) % 2]]
            rows.append((conv, step, edit, turn, new, text))
            at, step, out_at = at + 1, step + 1, out_at + (edit != "D")
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
                rows.clear()
    inserts()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def edits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """-> ``conv, step, edit, turn, role, text``: a row per edit, with the repaired role (null where deleted) and the text.

    A conversation's rows stand in one partition in the order of ``step``: its audit comes first, then its turns, streamed
    in their order, so nothing but the audit is held."""
    kind = {f.name: f.dataType.simpleString() for f in turns.schema}
    first = found.select("conv", F.lit(0).alias("kind"), "run", "piece", "audit", F.lit(None).cast(kind["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    then = turns.select("conv", F.lit(1).alias("kind"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    order = ["conv", "kind", "run", "piece", F.col("turn").asc_nulls_first(), "role", "text"]
    both = first.unionByName(then).repartition("conv").sortWithinPartitions(*order).select("conv", "audit", "turn", "role", "text")
    return both.mapInArrow(_apply, f"conv {kind['conv']}, step long, edit string, turn {kind['turn']}, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, hashed, empty, kind, out = None, None, True, pa.int64(), []
    for batch in batches:
        kind = batch.schema.field("conv").type
        for c, role, text in _columns(batch, "conv", "role", "text"):
            if hashed is None or c != conv:
                if hashed is not None:
                    out.append((conv, hashed.hexdigest()))
                conv, hashed, empty = c, hashlib.sha256(), True
            if role is not None:
                hashed.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], names=["conv", "repaired_sha256"])
            out = []
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(steps: DataFrame) -> DataFrame:
    """``edits``, as they come -> ``conv, repaired_sha256`` of the lines ``role:text``, joined by newlines."""
    return steps.mapInArrow(_digest, f"conv {steps.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def report(turns: DataFrame, found: DataFrame) -> DataFrame:
    """-> ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row per conversation that has turns.

    ``gaps`` counts turn numbers missing between the least and the largest (null where it passes a long)."""
    wide = "decimal(20,0)"
    gaps = turns.groupBy("conv").agg((F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.countDistinct("turn")).alias("g"), F.count("turn").alias("n")).select(
        F.col("conv").alias("__conv"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("try_cast(g as bigint)")).alias("gaps"))
    initial = lambda x: F.translate(x, SYMBOLS, "ssssuuuuaaaa????")
    counted = lambda letters: F.sum(F.regexp_count("symbols", F.lit(f"[{letters}]"))).cast("long")
    ends = F.struct("run", "piece", "audit", initial(F.substring("symbols", 1, 1)).alias("a"), initial(F.substring("symbols", -1, 1)).alias("z"))
    by_conv = found.groupBy("conv").agg(counted("BFJN").alias("blank"), counted("CGKO").alias("duplicate"), counted("DHLP").alias("truncated"), F.sum("illegal").alias("inside"),
                                        F.sum("cost").cast("long").alias("cost"), F.sort_array(F.collect_list(ends)).alias("pieces"))
    seams = F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), F.slice("pieces", 2, F.size("pieces")), lambda x, y: F.concat(x["z"], y["a"]).isin("su", "ua", "au"))
    return (by_conv.join(gaps, F.col("conv").eqNullSafe(F.col("__conv")))
            .select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("inside") + F.size(F.filter(seams, lambda ok: ~ok))).cast("long").alias("illegal"),
                    "cost", F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit")))


def repair(rows: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(``report``, ``edits``) of conversations ``conv_id, turn, role, text``.

    Turns stand in the order of turn (nulls first), role and text. The first fault of a turn counts: blank (nothing but
    white space, also null), duplicate (role and text stand earlier in the conversation), truncated (its last character
    that is not white space is not one of . ! ?). Blank and duplicate turns must be deleted. A null conversation id is a
    conversation of its own, an unknown or empty role matches no role of the grammar, rows that repeat are duplicates.
    An empty table gives no rows; other columns are not read, whatever their names. Texts are never cut.
    """
    turns = prepared(rows, **columns)
    found = audits(turns)
    return report(turns, found), edits(turns, found)
