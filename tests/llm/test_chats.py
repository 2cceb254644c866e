"""Chat formatting, repair of conversations and resampling against plain Python, on the tables and on awkward rows."""

import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from proofloom.llm import chatformat, queries, repair, resampling
from proofloom.llm.common import table

LONG = "tokens and more. " * 20_000
TURNS = [
    (1, 0, "user", "hi."), (1, 1, "assistant", "### Assistant: </turn>\n\\"), (1, None, "system", "rules!"), (2, 0, None, None), (2, 0, "user", ""), (None, 3, "user", "x?"), (None, 3, "user", "x?"),
    (3, 0, "assistant", LONG), (3, 0, "assistant", LONG), (3, 7, "user:\n### x\\", "\\</turn>"), (4, -3, "", "no stop"), (5, 0, "Upper", "a."), (5, 1, "assistant", "b"), (5, 2, "assistant", "c."),
]
KINDS = "conv_id long, turn long, role string, text string, part string, record long, fault string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "p", 1, "f") for r in TURNS], KINDS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def key(x):
    return (x is not None, x if x is not None else 0)


# --- chat formatting
def digests(convs):
    out = {}
    for conv, turns in convs.items():
        lost = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost))
    return out


def test_chats_whole_table(spark, sf_dir):
    convs = defaultdict(list)
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (key(r.conv_id), key(r.turn))):
        convs[r.conv_id].append((r.role or "", r.text or ""))
    convs[-7] = [("user", queries.TRAP), ("assistant", queries.TRAP)]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op11_chat_formatting(spark, sf_dir).collect()}
    assert got == digests(convs)


def test_chats_awkward_rows(spark, awkward):
    records = awkward.withColumn("record", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}))
    parts = chatformat.format_chats(records)
    convs, order = defaultdict(list), {}
    for r in parts.collect():
        order.setdefault(r.conv_id, []).append(((key(r.turn), r.record, r.item), r.part))
    for conv, found in order.items():
        for _, part in sorted(found):
            convs[conv] += chatformat.Reader().feed(part)
    assert Counter((c, r, t) for c, turns in convs.items() for r, t in turns) == Counter((c, r or "", t or "") for c, _, r, t in TURNS)
    got = {r.conv_id: r for r in chatformat.read_back(parts).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == digests(convs)
    for r in chatformat.whole_chats(parts).collect():
        assert len(r.text) == got[r.conv_id].formatted_chars
        assert chatformat.unescape("".join(r.text[x.start : x.end] for x in r.loss)) == "".join(t for role, t in convs[r.conv_id] if role == "assistant")


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages in parts", [("user", "ab")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from and value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "", "output": "done", "meta": {"k": [1, {"z": 2}]}}, "instruction, input, output", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction, input, output", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": 5}, "prompt, completion", [("user", "p"), ("assistant", "5")]),
    ({"messages": []}, "messages", []),
    ({"a.b": {"role": "x"}}, None, []),
    ([], None, []),
])
def test_fingerprints_select_layouts(record, layout, turns):
    mapping = chatformat.select(chatformat.paths(record))
    assert (mapping and mapping.name) == layout
    assert (list(chatformat.turns(record, mapping)) if mapping else []) == turns


def test_fingerprints_are_of_paths_only():
    a, b = ({"x": [{"y": v}], "z": v} for v in (1, "other"))
    assert chatformat.fingerprint(chatformat.paths(a)) == chatformat.fingerprint(chatformat.paths(b))
    assert chatformat.paths({"a.b": 1}) != chatformat.paths({"a": {"b": 1}})


def test_records_that_no_mapping_fits_stay(spark):
    rows = spark.createDataFrame([(1, 0, '{"odd": 1}'), (1, 1, "not json"), (2, 0, None), (3, 0, '{"role": "user", "text": "\\ud800x"}')], "conv_id long, turn long, record string")
    parts = chatformat.format_chats(rows)
    assert sorted((r.conv_id, r.turn, r.layout, r.part) for r in parts.collect() if r.conv_id < 3) == [(1, 0, None, None), (1, 1, None, None), (2, 0, None, None)]
    assert {r.conv_id: r.n_turns for r in chatformat.read_back(parts).collect()} == {1: 0, 2: 0, 3: 1}
    assert {(r.layout, r.n) for r in chatformat.layouts(parts).collect()} == {(None, 1), (None, 2), ("one turn", 1)}
    assert chatformat.read_back(chatformat.format_chats(rows.limit(0))).count() == 0


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_reader_takes_text_cut_anywhere(step):
    turns = [("a:\nb\\", "x\n</turn>\n"), ("", ""), ("###", "\\\\</turn>\\###\n"), ("user", "end\\")]
    text, reader, got = "".join(chatformat.render(*t)[0] for t in turns), chatformat.Reader(), []
    for at in range(0, len(text), step):
        got += reader.feed(text[at : at + step])
    assert got == turns and reader.done()
    assert text.count("\n</turn>\n") >= len(turns)


# --- repair
def hurt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv] += []
        if code:
            row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            convs[conv] += [row, row] if code == 3 else [row]
    return {c: sorted(x, key=lambda r: (key(r[0]), r[1], r[2])) for c, x in convs.items()}


def marked(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Plain shortest paths: (cost, audit, repaired) by state, best first."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def inserted(found):
        for _ in range(3):
            for s, (cost, audit, said) in list(found.items()):
                for x in "ua":
                    if (s, x) in step:
                        new = (cost + 5, audit + "I", (*said, (name[x], "")))
                        to = step[s, x]
                        found[to] = min(found.get(to, new), new, key=lambda v: v[:2])
        return found

    now = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(to, value):
            new[to] = min(new.get(to, value), value, key=lambda v: v[:2])

        for s, (cost, audit, said) in now.items():
            put(s, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (s, role[:1]) in step:
                put(step[s, role[:1]], (cost + more, audit + "K", (*said, (role, text))))
            for x in "ua":
                if (s, x) in step:
                    put(step[s, x], (cost + 1 + more, audit + "R", (*said, (name[x], text))))
        now = inserted(new)
    return min((now[s] for s in (0, 3) if s in now), key=lambda v: v[:2])


def expected(rows):
    out = {}
    for conv, turns in hurt(rows).items():
        faults = marked(turns)
        n = Counter(faults)
        cost, audit, said = cheapest(turns, faults)
        numbers = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in said)))
    return out


def test_repair_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == expected(rows)


def test_repair_awkward_and_random_rows(spark, awkward):
    import random

    dice = random.Random(3)
    texts = ["done.", "again!", "cut", "", " \n", "why?", "cut "]
    rows = [*TURNS, *((100 + c, dice.choice([None, *range(6)]), dice.choice(["user", "assistant", "system", "u", "bot", None]), dice.choice(texts)) for c in range(300) for _ in range(dice.randrange(1, 9)))]
    rows += [(9000, t, dice.choice(["user", "assistant", "bot"]), f"{dice.choice(texts)}{t % 50}{dice.choice(['.', ''])}") for t in range(3000)]
    frame = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], KINDS)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summary(repair.repair(repair.damage(frame), F.col("absent"))).collect()}
    assert got == expected(rows)
    assert repair.summary(repair.repair(frame.limit(0))).count() == 0


def test_repair_gives_the_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "first."), (1, 2, "assistant", "second."), (1, 3, "user", " "), (2, 0, "user", "only.")]
    edits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text, r.cost) for r in edits] == [
        (1, "Keep", "system", "s.", 0), (1, "Rerole", "user", "first.", 1), (1, "Keep", "assistant", "second.", 0), (1, "Delete", None, None, 2), (2, "Delete", None, None, 2),
    ]


# --- resampling
def sampled(docs, target):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), ws + [f"{a} {b}" for a, b in itertools.pairwise(ws)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    counts = []
    for texts in ([t for _, t in docs], target):
        counts.append(Counter(bucket(f) for t in texts for f in features(t)[1]))
    (s, t), (all_s, all_t) = counts, (sum(c.values()) for c in counts)
    rows = []
    for doc, text in docs:
        n, fs = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha(f"7:{'' if doc is None else doc}")[:8], 16)
        rows.append((doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((k for k, r in enumerate(rows) if r[4]), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1:3]))
    place = {k: p + 1 for p, k in enumerate(order[: 25 * len(order) // 100])}
    return [(*r[:4], place.get(k)) for k, r in enumerate(rows)]


def test_resampling_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op13_importance_resampling(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted(sampled(docs, [r.text for r in table(spark, sf_dir, "benchmark").collect()]), key=str)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r["rank"] is not None for r in got)))


@pytest.mark.parametrize(("nodes", "words", "part"), [(200_000, 200_000, 1 << 20), (5, 30, 64)])
def test_resampling_awkward_rows(spark, monkeypatch, nodes, words, part):
    monkeypatch.setattr(resampling, "WORDS", words)
    monkeypatch.setattr(resampling, "SLICE", part)
    for f in (resampling.bucket_totals, resampling.weights):
        monkeypatch.setattr(f, "__defaults__", tuple(nodes if x == resampling.NODES else x for x in f.__defaults__))
    docs = [(1, None), (2, ""), (3, "ONE two"), (3, "ONE two"), (4, "é ü 漢字 Ⅷ x_y-9 " * 30), (None, "a b " * 12), (5, "w " * 3000 + "x" * 300 + " y " + "x" * 63 + " " + "z" * 64 + " q"), (6, " ".join(f"w{i} x{i % 7}" for i in range(2000)))]
    docs += [(k, f"word{k % 5} and some others that many share " * 4) for k in range(10, 40)] + [(17, "word2 and some others that many share " * 4)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank long, score long")
    target = ["word1 and some others", None, "漢字 ü"]
    got = resampling.resample(frame.repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sampled(docs, target)))
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame.limit(0), none).count() == 0
    assert sorted(map(str, map(tuple, resampling.resample(frame.limit(3), none).collect()))) == sorted(map(str, sampled(docs[:3], [])))
