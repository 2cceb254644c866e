"""Chat records of any known layout as marked-up turns with a loss mask, and back.

1. A record's schema is the set of its nested field paths (``messages[].role``); its fingerprint is a hash of them.
2. A fingerprint selects a ``Mapping``: the first of those with most paths of which all are there. That is decided once a
   fingerprint and task, however many records share it. Records that no mapping fits keep a row, without a layout.
3. The mapping says which paths give which turns; the template marks each turn and escapes control strings in its texts.

Each turn is a row of its own with the place of its loss span, so a conversation may be as long as it likes: reading back
goes over rows by conversation and turn and holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

PARTS = "conv_id long, turn long, record long, item long, fingerprint string, layout string, part string, loss_start long, loss_end long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Turn:
    """One turn: its role and the paths whose texts, where not empty, it joins by a blank line. Optional ones may be absent."""

    role: str
    texts: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for each item of a list: the item's role and texts (all of a list of parts), roles renamed where ``names`` says so."""

    items: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    name: str
    turns: tuple[Turn | Each, ...]

    def paths(self) -> tuple[str, ...]:
        """Paths that a record must have."""
        out: list[str] = []
        for t in self.turns:
            if isinstance(t, Each):
                out += [f"{t.items}[].{t.role}", f"{t.items}[].{t.text}"]
            elif not t.optional:
                out += t.texts
        return tuple(out)


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_SYSTEM = Turn("system", ("system",), optional=True)

#: Layouts in use, in order of preference among those with equally many paths.
MAPPINGS = (
    Mapping("messages", (_SYSTEM, Each("messages", "role", "content"))),
    Mapping("messages in parts", (_SYSTEM, Each("messages", "role", "content[].text"))),
    Mapping("from and value", (_SYSTEM, Each("conversations", "from", "value", NAMES))),
    Mapping("one turn", (Each("", "role", "text"),)),
    Mapping("instruction, input, output", (_SYSTEM, Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Mapping("instruction, output", (_SYSTEM, Turn("user", ("instruction",)), Turn("assistant", ("output",)))),
    Mapping("instruction, context, response", (_SYSTEM, Turn("user", ("instruction", "context")), Turn("assistant", ("response",)))),
    Mapping("instruction, response", (_SYSTEM, Turn("user", ("instruction",)), Turn("assistant", ("response",)))),
    Mapping("prompt, completion", (_SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Mapping("prompt, response", (_SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Mapping("question, answer", (_SYSTEM, Turn("user", ("question",)), Turn("assistant", ("answer",)))),
)


def _key(name: str) -> str:
    return json.dumps(name) if re.search(r'[."\[\]{}]', name) or not name else name


def paths(record: object) -> set[str]:
    """Paths of all leaves; an empty list ends in ``[]``, an empty object in ``{}``."""
    out, rest = set(), [("", record)]
    while rest:
        at, value = rest.pop()
        if isinstance(value, dict) and value:
            rest += [(f"{at}.{_key(k)}" if at else _key(k), v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            rest += [(f"{at}[]", v) for v in value]
        else:
            out.add(at + {dict: "{}", list: "[]"}.get(type(value), ""))
    return out


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _there(path: str, found: set[str]) -> bool:
    """Whether a record has the path, or an empty list where it would go on."""
    path = path.removeprefix("[].")
    return path in found or any(path[: m.end()] in found for m in re.finditer(r"\[\]", path))


def select(found: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    fits = [m for m in mappings if all(_there(p, found) for p in m.paths())]
    return max(fits, key=lambda m: len(m.paths()), default=None)


def _values(value: object, path: str) -> list:
    """What is found at a path: a value, or all of the lists that it goes through."""
    at = [value]
    for step in path.split(".") if path else []:
        key = step.rstrip("[]")
        at = [x.get(key) for x in at if isinstance(x, dict)]
        if step.endswith("[]"):
            at = [y for x in at if isinstance(x, list) for y in x]
    return at


def _text(found: list, joint: str = "") -> str:
    return joint.join(x for x in ("" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in found) if x)


def turns(record: object, mapping: Mapping) -> Iterator[tuple[str, str]]:
    """(role, text) of a record's canonical turns."""
    for t in mapping.turns:
        if isinstance(t, Each):
            for item in _values(record, f"{t.items}[]") if t.items else [record]:
                role = _text(_values(item, t.role))
                yield dict(t.names).get(role, role), _text(_values(item, t.text))
        else:
            found = [_text(_values(record, p)) for p in t.texts]
            if not t.optional or any(found):
                yield t.role, _text(found, "\n\n")


# --- the template: "### role:", the text, "</turn>"; a backslash keeps what follows from being read as a mark
_CONTROL, _NAME, _ESCAPED = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:|\n"), re.compile(r"\\(.)", re.DOTALL)
_HEAD, _END = re.compile(r"\\.|:\n", re.DOTALL), re.compile(r"\\.|\n</turn>\n", re.DOTALL)
_OPEN = "### "


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked-up turn, and where in it the text stands."""
    head = f"{_OPEN}{_NAME.sub(r'\\\g<0>', role)}:\n"
    body = _CONTROL.sub(r"\\\g<0>", text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


class Reader:
    """Turns of marked-up text that comes in parts, cut anywhere."""

    def __init__(self):
        self.rest, self.at, self.role = "", 0, None

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while True:
            start = 0 if self.role is not None else len(_OPEN)
            want = _HEAD if self.role is None else _END
            if self.role is None and len(self.rest) >= len(_OPEN) and not self.rest.startswith(_OPEN):
                raise ValueError("a turn must begin with its mark")
            end = None
            for m in want.finditer(self.rest, max(start, self.at)):
                if m[0][0] != "\\":
                    end = m
                    break
                self.at = m.end()
            if end is None:
                return
            got = unescape(self.rest[start : end.start()])
            self.rest, self.at = self.rest[end.end() :], 0
            if self.role is None:
                self.role = got
            else:
                yield self.role, got
                self.role = None

    def done(self) -> bool:
        return not self.rest and self.role is None


def _clean(text: str) -> str:
    """Half characters, which JSON can spell and UTF-8 cannot, as a replacement character."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def format_chats(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, loss_role: str = "assistant") -> DataFrame:
    """Marked-up turns of ``records`` (conv_id, turn, and ``record``, an object as JSON).

    One row a turn: conv_id, turn, record (a hash that tells records of one turn apart and orders them), item (place in
    the record), fingerprint, layout (the mapping's name), part (the marked-up turn), loss_start and loss_end (code points
    of its text in ``part``, null where the turn is not of ``loss_role``). Null texts and roles are empty; values that are
    no text are JSON. A record that cannot be read, that no mapping fits (layout null) or that has no turns gives one row
    without part: none is dropped. Null conv_id and turn stay; repeated records give their turns each; other columns are
    not looked at; an empty table gives no rows.
    """
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.string() if n in ("fingerprint", "layout", "part") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for conv, turn, n, text in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    try:
                        record = json.loads(text)
                        found = paths(record)
                        mark = fingerprint(found)
                    except (TypeError, ValueError, RecursionError):
                        out.append((conv, turn, n, 0, None, None, None, None, None))
                        continue
                    if mark not in chosen:
                        if len(chosen) > 10_000:  # only what is remembered is bounded
                            chosen.clear()
                        chosen[mark] = select(found, mappings)
                    mapping, item = chosen[mark], 0
                    for role, said in turns(record, mapping) if mapping else ():
                        part, start, end = render(_clean(role), _clean(said))
                        mask = (start, end) if role == loss_role else (None, None)
                        out.append((conv, turn, n, item, mark, mapping.name, part, *mask))
                        item += 1
                    if not item:
                        out.append((conv, turn, n, 0, mark, mapping and mapping.name, None, None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    given = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64("record").alias("n"), F.col("record").cast("string").alias("record"))
    return given.mapInArrow(tidied(run), PARTS)


def layouts(parts: DataFrame) -> DataFrame:
    """fingerprint, layout, n: turns of each schema, null layouts being those that need a mapping."""
    return parts.groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def in_order(parts: DataFrame) -> DataFrame:
    """Parts dealt out by conversation, each conversation's in order: by turn, nulls first, then record, then item."""
    return parts.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "record", "item")])


def whole_chats(parts: DataFrame) -> DataFrame:
    """conv_id, text, loss (start and end in ``text``, in code points): each conversation as one row, for those that fit into one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in _conversations(batches):
            texts, loss, at = [], [], 0
            for part, start, end in group:
                if start is not None:
                    loss.append({"start": at + start, "end": at + end})
                texts.append(part)
                at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(texts)]), pa.array([loss], kind)], ["conv_id", "text", "loss"])

    return in_order(parts).mapInArrow(tidied(run), "conv_id long, text string, loss array<struct<start: long, end: long>>")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its parts) one after the other; each conversation's parts must be read before the next one's."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "loss_start", "loss_end")), strict=True))
    for conv, group in groupby(rows, lambda r: r[0]):
        yield conv, (r[1:] for r in group if r[1] is not None)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the marked-up text.

    turns_sha256 digests role, newline, text, newline of each turn; loss_sha256 all text under the mask, unescaped.
    Conversations of which no turn came out have zeros and an empty text's digests.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n.endswith("sha256") else pa.int64()) for x, n in zip(zip(*done, strict=True), names, strict=True)], names)
            done.clear()
            return out

        for conv, group in _conversations(batches):
            reader, said, lost = Reader(), hashlib.sha256(), hashlib.sha256()
            n = chars = size = 0
            for part, start, end in group:
                size += len(part)
                for role, text in reader.feed(part):
                    n += 1
                    said.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(part[start:end])
                    chars += len(text)
                    lost.update(text.encode())
            if not reader.done():
                raise ValueError(f"conversation {conv} ends inside a turn")
            done.append((conv, n, said.hexdigest(), chars, lost.hexdigest(), size))
            if len(done) >= 1000:
                yield told()
        if done:
            yield told()

    return in_order(parts).mapInArrow(tidied(run), READ)
