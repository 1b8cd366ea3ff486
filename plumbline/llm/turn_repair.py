"""Conversation structure repair by a time-major dynamic programme over tensors.

A conversation is right when its role initials read ``(s?(ua)+)?``: nothing, or turns of a user
and an assistant in alternation, a system turn before them or not. Four states say what may come:
at the start, after the system turn, after a user, after an assistant. Each row is kept (0), given
the role that is due (2) or deleted (3), and empty turns of the role that is due are inserted
anywhere (2). Blank and duplicate rows must go; a truncated row that stays costs 1.

Conversations are put into buckets by length, and laid out as arrays of (turn, conversation). Going
back over the turns, the costs from each state to the end are worked out for all conversations of
a bucket at once, and kept; going forward, the edits are read off for all of them at once. Of the
cheapest edits those come out whose initials are least, since at each turn the least initial is
taken that still leads to the least cost.

Conversations of over ``LONG`` rows are solved from one byte a row, cut into stretches that stand
side by side as if they were conversations: first the costs of each stretch from each state to
each state, which are put together from the end, then the edits of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import cut, dropped, slices

START, SYSTEM, USER, ASSISTANT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 28
#: A row's byte: the role's initial (3: another), whether it must go, whether it is truncated; PAD is no row.
MUST_GO, CUT_SHORT, PAD = 4, 8, 16
INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state after the role that is due in each state.
DUE = np.array([USER, USER, ASSISTANT, USER])
DUE_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What is left to pay at a conversation's end: the turns that must still be inserted.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: The state that a kept row leads to, by byte and state, and what keeping and a new role cost.
TO = np.zeros((32, 4), np.int64)
KEPT, REROLED, DELETED = (np.full((32, 4), NEVER) for _ in range(3))
for _code in range(16):
    for _state in range(4):
        _to = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}.get((_code & 3, _state))
        _extra = TRUNCATED if _code & CUT_SHORT else 0
        DELETED[_code, _state] = DELETE
        if not _code & MUST_GO:
            REROLED[_code, _state] = REROLE + _extra
            if _to is not None:
                TO[_code, _state], KEPT[_code, _state] = _to, KEEP + _extra
#: No row: the state stays, at no cost.
TO[PAD], KEPT[PAD] = np.arange(4), 0
#: Rows of a conversation that one task holds; cells of a bucket that are worked on at once.
LONG, CELLS = 20_000, 1 << 20


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end, ``(turns + 1, conversations, 4)``, of ``codes (turns, conversations)`` and the costs ``end (conversations, 4)`` after them."""
    costs = np.empty((len(codes) + 1, codes.shape[1], 4), np.int64)
    costs[-1] = end
    for i in range(len(codes) - 1, -1, -1):
        row, rest = codes[i], costs[i + 1]
        best = np.minimum(rest + DELETED[row], np.take_along_axis(rest, TO[row], 1) + KEPT[row])
        best = np.minimum(best, rest[:, DUE] + REROLED[row])
        costs[i] = np.minimum(best, np.minimum(INSERT + best[:, DUE], 2 * INSERT + best[:, DUE[DUE]]))
    return np.minimum(costs, NEVER)


def forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Initials of the edits, ``(conversations, 3 * turns)`` with zeros between, and the state after the last turn.

    Up to two insertions come before the edit of a row; a turn that is padding has none.
    """
    turns, n = codes.shape
    edits, state, at = np.zeros((n, turns, 3), np.uint8), state.copy(), np.arange(n)
    for i in range(turns):
        row, rest, here = codes[i], costs[i + 1], costs[i]
        real = row != PAD
        for slot in range(3):
            todo = real & (edits[:, i, 2] == 0)
            left = here[at, state]
            delete = todo & (rest[at, state] + DELETED[row, state] == left)
            insert = todo & ~delete & (INSERT + here[at, DUE[state]] == left)
            keep = todo & ~delete & ~insert & (rest[at, TO[row, state]] + KEPT[row, state] == left)
            rerole = todo & ~delete & ~insert & ~keep
            edits[:, i, 2] += (ord("D") * delete + ord("K") * keep + ord("R") * rerole).astype(np.uint8)
            if slot < 2:
                edits[insert, i, slot] = ord("I")
            state = np.where(insert | rerole, DUE[state], np.where(keep, TO[row, state], state))
    return edits.reshape(n, 3 * turns), state


def solved(codes: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Least cost and edits of each conversation, given a byte for each of its rows."""
    out: list[tuple[int, bytes]] = [(0, b"")] * len(codes)
    lengths = np.array([len(c) for c in codes], np.int64)
    bucket = np.ceil(np.log(np.maximum(lengths, 1)) / np.log(1.25)).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        most = max(int(lengths[members].max()), 1)
        for begin in range(0, len(members), max(1, CELLS // most)):
            part = members[begin : begin + max(1, CELLS // most)]
            laid = np.full((len(part), most), PAD, np.uint8)
            for k, m in enumerate(part):
                laid[k, : lengths[m]] = codes[m]
            laid = laid.T
            costs = backward(laid, np.broadcast_to(END, (len(part), 4)))
            edits, state = forward(laid, costs, np.zeros(len(part), np.int64))
            for k, m in enumerate(part):
                out[m] = int(costs[0, k, START]), edits[k][edits[k] > 0].tobytes() + b"I" * int(END[state[k]] // INSERT)
    return out


def solved_long(codes: np.ndarray) -> tuple[int, bytes]:
    """As ``solved``, for one long conversation, in stretches that are worked on side by side."""
    stretch = max(1, int(len(codes) ** 0.5))
    laid = np.full(-(-len(codes) // stretch) * stretch, PAD, np.uint8)
    laid[: len(codes)] = codes
    laid = np.ascontiguousarray(laid.reshape(-1, stretch).T)
    n = laid.shape[1]
    units = np.where(np.eye(4, dtype=bool), 0, NEVER)
    through = np.stack([backward(laid, np.broadcast_to(units[j], (n, 4)))[0] for j in range(4)], axis=2)  # stretch, from, to
    ends = np.empty((n + 1, 4), np.int64)
    ends[n] = END
    for k in range(n - 1, -1, -1):
        ends[k] = np.minimum((through[k] + ends[k + 1][None, :]).min(axis=1), NEVER)
    costs = backward(laid, ends[1:])
    traced = [forward(laid, costs, np.full(n, s, np.int64)) for s in range(4)]
    state, found = START, []
    for k in range(n):
        edits, after = traced[state]
        found.append(edits[k][edits[k] > 0].tobytes())
        state = int(after[k])
    return int(ends[0, START]), b"".join(found) + b"I" * int(END[state] // INSERT)


def ends_whole(text: str) -> bool | None:
    """Whether the last character that is no white space ends a sentence; None if there is none."""
    last = text.rstrip(BLANKS)[-1:]
    return last in (".", "!", "?") if last else None


def code(role: str, text: str, seen: bool) -> int:
    """A row's byte; ``seen`` says that its role and text came before."""
    whole = ends_whole(text)
    return INITIALS.get(role[:1], 3) | (MUST_GO if whole is None or seen else 0 if whole else CUT_SHORT)


def counted(rows: list[tuple]) -> tuple[list, np.ndarray]:
    """gaps, blank, duplicate, truncated, illegal of ordered (turn, role, text), and the rows' bytes."""
    seen: set[tuple[str, str]] = set()
    codes = np.empty(len(rows), np.uint8)
    blank = duplicate = illegal = 0
    for i, (_, role, text) in enumerate(rows):
        whole, again = ends_whole(text), (role, text) in seen
        blank += whole is None
        duplicate += whole is not None and again
        seen.add((role, text))
        codes[i] = code(role, text, again)
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return [gaps, blank, duplicate, int((codes & CUT_SHORT > 0).sum()), illegal], codes


def applied(edits: Iterable[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired (role, text), given the edits' initials and the rows that they go over."""
    state = START
    for edit in edits:
        if edit == "I":
            state = int(DUE[state])
            yield DUE_ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "R":
            state = int(DUE[state])
            yield DUE_ROLE[state], text
        elif edit == "K":
            state = int(TO[INITIALS[role[:1]], state])
            yield role, text


_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), *[(c, pa.int64()) for c in _STATS], ("audit", pa.string()), ("repaired", _REPAIRED)])
SCHEMA = "conv_id long, piece long, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired array<struct<role:string,text:string>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


def _rows(batches: Iterable[pa.RecordBatch], at_once: int = 4096) -> Iterator[tuple]:
    for b in slices(batches, at_once):
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, many at once; each gives one piece."""

    def done(waiting: list[tuple]) -> pa.RecordBatch:
        told = [counted(rows) for _, rows in waiting]
        answers = solved([codes for _, codes in told])
        out = []
        for (conv_id, rows), (stats, _), (cost, edits) in zip(waiting, told, answers, strict=True):
            audit = edits.decode()
            fixed = [{"role": r, "text": t} for r, t in applied(audit, ((r[1], r[2]) for r in rows))]
            out.append((conv_id, 0, *stats, cost, audit, fixed))
        return _batch(out)

    waiting: list[tuple] = []
    size = 0
    for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
        rows = [(turn, role, text) for _, turn, role, text, gone in group if not gone]
        waiting.append((conv_id, rows))
        size += 200 + sum(100 + len(r[2]) for r in rows)
        if size > 4_000_000:
            yield done(waiting)
            waiting, size = [], 0
    if waiting:
        yield done(waiting)


def _of_long(rows: DataFrame) -> DataFrame:
    """Pieces of the long conversations.

    Their rows are put into order over all tasks. What repeats is found by a join of digests, and
    one task a conversation reads a byte for each row. The repaired rows stream, a piece at a time.
    """
    spark = rows.sparkSession
    keyed = rows.where("not gone").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("salt"))
    ordered = cut(
        keyed.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt")
        .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq")),
        "turns",
    )
    told = ordered.select("conv_id", "seq", "turn", F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256).alias("digest"), "role", F.rtrim(F.translate("text", BLANKS[1:], " " * (len(BLANKS) - 1))).alias("text"))
    told = told.select("conv_id", "seq", "turn", "digest", F.substring("role", 1, 1).alias("initial"), F.expr("right(text, 1)").alias("last"))
    first = told.groupBy("conv_id", "digest").agg(F.min("seq").alias("first"))
    marked = told.alias("t").join(first.alias("f"), F.expr("t.conv_id <=> f.conv_id and t.digest = f.digest")).select("t.conv_id", "seq", "turn", "initial", "last", (F.col("seq") > F.col("first")).alias("seen"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
            codes, before, last_turn, low = bytearray(), None, None, None
            turns = blank = duplicate = illegal = 0
            for _, _, turn, initial, last, seen in group:
                codes.append(code(initial, last, seen))
                blank += not last
                duplicate += bool(last) and seen
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != last_turn
                    last_turn = turn
            rows = np.frombuffer(bytes(codes), np.uint8)
            cost, edits = solved_long(rows)
            gaps = 0 if low is None else last_turn - low + 1 - turns
            yield _batch([(conv_id, -1, gaps, blank, duplicate, int((rows & CUT_SHORT > 0).sum()), illegal, cost, edits.decode(), None)])

    answers = marked.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(solve, SCHEMA)
    asked = rows.select("conv_id").distinct().alias("i").join(answers.alias("a"), F.expr("i.conv_id <=> a.conv_id"), "left")
    heads = asked.select("i.conv_id", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _STATS], F.coalesce("audit", F.lit("")).alias("audit"))
    streamed = heads.unionByName(ordered.select("conv_id", "seq", "role", "text"), allowMissingColumns=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in groupby(_rows(batches, 256), key=lambda r: r[0]):
            head = next(group)
            stats, audit = head[4:10], head[10]
            piece, fixed, size = 0, [], 0
            for role, text in applied(audit, ((r[2], r[3]) for r in group)):
                fixed.append({"role": role, "text": text})
                size += 100 + len(text)
                if size > 4_000_000:
                    yield _batch([(conv_id, piece, *stats, audit, fixed)])
                    piece, fixed, size, stats, audit = piece + 1, [], 0, (0,) * 6, ""
            yield _batch([(conv_id, piece, *stats, audit, fixed)])

    return streamed.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(write, SCHEMA)


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``: each conversation's faults, cheapest edits and repaired turns.

    ``repaired`` holds (role, text). A conversation is one piece; one of over ``LONG`` rows has
    more, whose ``repaired`` follow each other; figures and audit are in piece 0, and 0 and empty
    in the others. The pieces of a conversation lie together, in order.

    Rows are ordered by turn, those without one first, ties by role and text. Null roles and texts
    are one space; rows without a conv_id are one conversation; rows that repeat are duplicates,
    which must go. Where ``turns`` has a boolean ``gone``, a row for which it is true names its
    conversation only: a conversation of none but such rows has zeros and an empty audit. Further
    columns are ignored; an empty table gives no rows.

    A conversation is written by one task, as its audit is one value. Up to ``LONG`` rows the task
    holds its texts, beyond that a byte for each row, its audit, and a piece of its texts.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), gone.alias("gone"))
    ids = cut(rows.groupBy("conv_id").count().where(F.col("count") > LONG).select("conv_id"), "long")
    whole = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(_short, SCHEMA)
    if ids.isEmpty():
        dropped(ids)
        return whole(rows)
    meet = F.expr("r.conv_id <=> i.conv_id")
    return whole(rows.alias("r").join(ids.alias("i"), meet, "left_anti")).unionByName(_of_long(rows.alias("r").join(ids.alias("i"), meet, "left_semi")))


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: figures, audit, and the digest of the repaired ``role:text``, newline-joined.

    ``repaired`` is the frame that ``repair`` gives; its order is relied on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[dict]:
            for conv_id, group in groupby(_rows(batches, 256), key=lambda r: r[0]):
                digest, begun, head = hashlib.sha256(), False, None
                for row in group:
                    head = head or row
                    for turn in row[9]:
                        digest.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode())
                        begun = True
                yield dict(zip(names, (conv_id, *head[2:9], digest.hexdigest()), strict=True))

        names = ["conv_id", *_STATS, "audit", "repaired_sha256"]
        kinds = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _STATS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for rows in batched(told(), 4096):
            yield pa.RecordBatch.from_pylist(list(rows), kinds)

    return repaired.mapInArrow(read, "conv_id long, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired_sha256 string")
