"""Repair of the turn structure of conversations at least cost.

A repaired conversation's role initials fit ``(s?(ua)+)?``, which has four states: nothing yet, after a system turn, after
a user turn, after an assistant turn. Edits of a row: Keep costs 0, Rerole to user or assistant 1, Delete 2; Insert of an
empty turn costs 5 anywhere. Blank and duplicate rows must be deleted; truncated rows cost 5 more unless deleted.

Layers of cost: for each place of a conversation, layer c is the set of states from which the rest can be repaired at cost
c. All layers of a place are one whole number, four bits a layer, so one edit moves all of them at once: a shift by a
layer for each unit of cost. From any state the rest costs at most 10 more than from the best one (two inserts lead from
any state to any that is not behind it, and a system turn that is too late is deleted for 2), so twelve layers above the
least one hold all that a cheapest repair can use, however long the conversation is.

Rows are dealt out by conversation and sorted, last turn first; one pass of batches writes to each row the layers after
it. Sorted the other way round, a second pass walks from the first state and the least cost, and takes the least letter
that the layers after the row still allow. Neither pass holds more than one row's state, so a conversation may be as long
as it likes; duplicates are found before, by a window over equal turns of a conversation, which spreads a long one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied

RETYPE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

#: States: nothing yet, after system, after user, after assistant. The next one by (state, initial).
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LAYERS = 12
_ALL = (1 << 4 * _LAYERS) - 1
_ONES = int("1" * 2 * _LAYERS, 16)  # the lowest bit of each layer, in room for shifts by ten layers
_ROLES = {"u": "user", "a": "assistant"}

EDITS = "conv_id long, place long, edit string, fault string, turn long, given_role string, role string, text string, cost long"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _before(layers: int, initial: str) -> int:
    """The states from which a turn with that initial leads into ``layers``."""
    if initial == "u":
        return ((layers >> 2) & _ONES) * 0b1011
    if initial == "a":
        return ((layers >> 3) & _ONES) << 2
    return (layers >> 1) & _ONES if initial == "s" else 0


def _either(layers: int) -> int:
    return _before(layers, "u") | _before(layers, "a")


def _settled(layers: int, base: int) -> tuple[int, int]:
    """With inserts (two in a row at most: a third one leads back), the least layer first."""
    for _ in range(2):
        layers |= _either(layers) << 4 * INSERT
    low = ((layers & -layers).bit_length() - 1) // 4
    return (layers >> 4 * low) & _ALL, base + low


#: Layers after the last row: the grammar accepts nothing, and a conversation that ends with an assistant turn.
END = _settled(0b1001, 0)


def before_row(layers: int, base: int, initial: str, fault: str | None) -> tuple[int, int]:
    """Layers and least cost before a row, from those after it."""
    out = layers << 4 * DELETE
    if fault not in ("blank", "duplicate"):
        more = BROKEN if fault == "truncated" else 0
        out |= _before(layers, initial) << 4 * more | _either(layers) << 4 * (RETYPE + more)
    return _settled(out, base)


def _holds(layers: int, base: int, state: int | None, cost: int) -> bool:
    return state is not None and 0 <= cost - base < _LAYERS and bool(layers >> (4 * (cost - base) + state) & 1)


def choose(state: int, cost: int, after: tuple[int, int], initial: str, fault: str | None) -> tuple[list[str], str, str | None, int, int]:
    """From a state before a row and the cost that the rest has: (roles inserted before it, edit, new role, state, cost) of the least letters."""
    inserted: list[str] = []
    whole = before_row(*after, initial, fault)
    more = BROKEN if fault == "truncated" else 0
    turn = {2: "a"}.get(state, "u")
    while True:
        if _holds(*after, state, cost - DELETE):
            return inserted, "Delete", None, state, cost - DELETE
        if _holds(*whole, to := _NEXT.get((state, turn)), cost - INSERT):
            inserted.append(_ROLES[turn])
            state, cost, turn = to, cost - INSERT, "a" if turn == "u" else "u"
            continue
        if fault not in ("blank", "duplicate"):
            if _holds(*after, to := _NEXT.get((state, initial)), cost - more):
                return inserted, "Keep", None, to, cost - more
            if _holds(*after, to := _NEXT.get((state, turn)), cost - more - RETYPE):
                return inserted, "Rerole", _ROLES[turn], to, cost - more - RETYPE
        raise ArithmeticError("no edit leads to the least cost")


def closing(state: int, cost: int) -> list[str]:
    """Roles inserted after the last row."""
    out = []
    while cost:
        turn = "a" if state == 2 else "u"
        out.append(_ROLES[turn])
        state, cost = _NEXT[state, turn], cost - INSERT
    return out


def faults(rows: DataFrame, absent: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space), absent, nth among equal turns of a conversation, and the row's first fault or null.

    blank: nothing but white space; duplicate: role and text came earlier in the conversation, in an earlier turn or as an
    earlier one of equal rows; truncated: the last character but white space is none of ``.!?``.
    """
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(False) if absent is None else absent).alias("absent"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "absent").orderBy(F.col("turn").asc_nulls_first()))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(body == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.withColumn("nth", nth).withColumn("fault", F.when(~F.col("absent"), kind))


def _layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last to the first, with the layers after each."""
    conv, now = object(), END
    for batch in batches:
        layers, base = [], []
        for c, role, fault, absent in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "fault", "absent")), strict=True):
            if c != conv:
                conv, now = c, END
            layers.append(now[0])
            base.append(now[1])
            if not absent:
                now = before_row(*now, role[:1], fault)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layers, pa.int64()), pa.array(base, pa.int64())], [*batch.schema.names, "layers", "base"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the first to the last, as edits."""
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("given_role", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])
    conv, state, cost, place, rows, open_ = None, 0, None, 0, [], False

    def put(*row) -> None:
        nonlocal place
        rows.append((conv, place, *row))
        place += 1

    def close() -> None:
        if open_ and cost is None:
            put(None, None, None, None, None, None, 0)
        for role in closing(state, cost or 0) if open_ else ():
            put("Insert", None, None, None, role, "", INSERT)

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        rows.clear()
        return out

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "absent", "fault", "layers", "base"))
        for c, turn, role, text, absent, fault, layers, base in zip(*columns, strict=True):
            if not open_ or c != conv:
                close()
                conv, state, cost, place, open_ = c, 0, None, 0, True
            if absent:
                continue
            after, initial = (layers, base), role[:1]
            if cost is None:
                whole, least = before_row(*after, initial, fault)
                cost = next(least + k for k in range(_LAYERS) if whole >> 4 * k & 1)
            had = cost
            inserted, edit, new, state, cost = choose(state, cost, after, initial, fault)
            for r in inserted:
                put("Insert", None, None, None, r, "", INSERT)
            gone = edit == "Delete"
            put(edit, fault, turn, role, None if gone else new or role, None if gone else text, had - cost - INSERT * len(inserted))
        if rows:
            yield told()
    close()
    if rows:
        yield told()


def repair(rows: DataFrame, absent: Column | None = None) -> DataFrame:
    """The cheapest edits of every conversation, in order: conv_id, place, edit, fault, turn, given_role, role, text, cost.

    Rows come by turn, nulls first, equal turns by role and text. Among cheapest edits those whose initials come first in
    ASCII are taken. given_role is the row's role, role and text are those of the repaired turn: null where it is deleted.
    Rows for which ``absent`` holds are not there, but their conversation is: without any row it has one row without edit.
    Null roles and texts are one space: such a text is blank, such a role fits nowhere; so does an empty role. Rows
    without conv_id are one conversation. Repeated rows are duplicates; an empty table gives no rows. Other columns are
    not looked at.
    """
    order = ["conv_id", "turn", "role", "text", "nth"]
    known = faults(rows, absent).select(*order, "absent", "fault")
    kinds = "conv_id long, turn long, role string, text string, nth int, absent boolean, fault string, layers long, base long"
    dealt = known.repartition("conv_id").sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in order])
    back = dealt.mapInArrow(tidied(_layered), kinds).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return back.mapInArrow(tidied(_edited), EDITS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    now, done = None, []

    def close() -> None:
        if now:
            turns = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            done.append((now["conv_id"], turns, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        done.clear()
        return out

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "place", "edit", "fault", "turn", "given_role", "role", "text", "cost"))
        for conv, place, edit, fault, turn, given, role, text, cost in zip(*columns, strict=True):
            if place == 0:
                close()
                now = {"conv_id": conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "joint": b"", "last": None}
            now["cost"] += cost
            if edit:
                now["audit"].append(edit[0])
            if fault:
                now[fault] += 1
            if given is not None:
                now["illegal"] += now["last"] is not None and now["last"] + given[:1] not in LEGAL
                now["last"] = given[:1]
            if turn is not None:
                now["turns"] += turn != now["high"]
                now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            if role is not None:
                now["sha"].update(now["joint"] + f"{role}:{text}".encode())
                now["joint"] = b"\n"
        if len(done) >= 1000:
            yield told()
    close()
    if done:
        yield told()


def summary(edits: DataFrame) -> DataFrame:
    """One row a conversation of what ``repair`` returned: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired turns.

    gaps: turns missing between the least and the greatest, nulls left aside. illegal: neighbours, as given, whose
    initials are none of su, ua, au. A conversation without rows has zeros, an empty audit and an empty text's digest.
    """
    return edits.mapInArrow(tidied(_summed), SUMMARY)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent: rows with faults by crc32(``conv_id:turn``) % 20, nulls as one space throughout.

    0 drops the row (absent), 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    code, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (code == 0).alias("absent"),
        F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("_copy"),
    )
    return hurt.drop("_copy")
