"""Chat formatting against a plain reading of the rows."""

import hashlib
import random
from collections import defaultdict

from lociform.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, own string, window string"


def rows():
    r = random.Random(8)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\/s>", "<", "[", "/s>", "ok ", "é🙂", "\n", "word " * 30, "$1"]
    out = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "lost"), (5000, 0, "assistant", None), (5000, 1, None, "x"), (5001, 0, "assistant", "long " * 5000)]
    for conv in range(60):
        for turn in range(r.randint(1, 40)):
            out.append((conv, turn, "system" if turn == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))))
        if conv % 7 == 0:
            out += out[-2:]
    return [(*x, "clash", "clash") for x in out]


def want(data):
    convs = defaultdict(list)
    for c, t, role, text, *_ in data:
        convs[c].append((t, (role or "").encode(), (text or "").encode()))
    out = {}
    for c, own in convs.items():
        own.sort()
        target = b"".join(x for _, role, x in own if role == b"assistant")
        out[c] = (len(own), hashlib.sha256(b"".join(role + b"\n" + x + b"\n" for _, role, x in own)).hexdigest(), len(target.decode()), hashlib.sha256(target).hexdigest())
    return out


def test_round_trip(spark):
    data = rows()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == want(data)


def test_windows(spark):
    """Three turns of some 130 tokens fit 400: the system turn, one of history and an own one; of 300 history has no room."""
    text = "word " * 100
    data = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2 == 0], f"{k} {text}", "", "") for k in range(30)]
    tight = chat.windows(spark.createDataFrame(data, SCHEMA), budget=300, history=1, history_budget=300).orderBy("window").collect()
    assert all(len(w.own) == 2 for w in tight) and sum(sum(w.own) for w in tight) == 30
    got = chat.windows(spark.createDataFrame(data, SCHEMA), budget=400, history=1, history_budget=300).orderBy("window").collect()
    assert len(got) > 3
    for k, w in enumerate(got):
        assert w.formatted.startswith("<s>system[INST]0 word")  # the system turn is in every window
        assert sum(w.own) >= 1 and (k == 0 or len(w.own) - sum(w.own) == 2)  # system and one turn of history
        for span in w.loss:
            assert w.formatted[span.start : span.start + span.length].endswith("word ")
    assert sum(sum(w.own) for w in got) == 30
    assert sum(len(w.loss) for w in got) == 14


def cost(text):
    return -(-len(text.encode()) // 4) + 4


def test_windows_fit_the_budget(spark):
    r = random.Random(4)
    data = [(conv, k, "system" if k == (conv % 3) and conv % 2 else r.choice(["user", "assistant"]), f"{k} " + "é" * r.choice([5, 60, 200, 500, 990, 1400]), "", "") for conv in range(40) for k in range(r.randint(1, 30))]
    data += [(100, k, "user", "x" * 2000, "", "") for k in range(2)]  # two turns of 504 tokens
    data += [(None, k, "assistant", f"{k:04d}" + "y" * 1200, "", "") for k in range(1500)]  # more windows than the fold keeps in one list
    got = chat.windows(spark.createDataFrame(data, SCHEMA)).collect()
    convs, spans = defaultdict(list), defaultdict(list)
    for c, t, role, text, *_ in data:
        convs[c].append((t, role, text))
    for w in sorted(got, key=lambda w: w.window):
        turns = [piece.split("[INST]", 1)[1] for piece in w.formatted.split("[/INST]</s>")[:-1]]
        total = sum(map(cost, turns))
        alone = sum(w.own) == 1 and len(w.own) <= 1 + w.formatted.startswith("<s>system[INST]")
        assert total <= chat.BUDGET or alone  # an own turn and the system turn, and no history
        spans[w.conv_id].append((total, [t for t, own in zip(turns, w.own) if own]))
    assert any(len(w.own) > 1 + sum(w.own) for w in got)  # history is repeated where it fits
    assert any(len(own) > 1 for windows in spans.values() for _, own in windows)
    assert len(spans[100]) == 2 and len(spans[None]) > 1000
    for c, own in convs.items():
        assert [t for _, span in spans[c] for t in span] == [text for _, _, text in sorted(own)]
        # Spans are not closed early: the next window's first turn would not have fitted.
        assert all(total + cost(after[0]) > chat.BUDGET for (total, _), (_, after) in zip(spans[c], spans[c][1:]))


def test_stretches_of_a_long_conversation(spark, monkeypatch):
    """A conversation in several stretches keeps its turns, targets and budget; each stretch begins a window."""
    monkeypatch.setattr(chat, "STRETCH", 16)
    data = rows() + [(70, k, "system" if k == 2 else ("user", "assistant")[k % 2], f"{k} " + "word " * (k % 90), "", "") for k in range(200)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == want(data)
    windows = chat.windows(spark.createDataFrame(data, SCHEMA)).filter("conv_id = 70").orderBy("window").collect()
    assert [w.window for w in windows] == list(range(1, len(windows) + 1))
    seen, starts = 0, []
    for w in windows:
        starts.append(seen)
        seen += sum(w.own)
        turns = [piece.split("[INST]", 1)[1] for piece in w.formatted.split("[/INST]</s>")[:-1]]
        assert sum(map(cost, turns)) <= chat.BUDGET or sum(w.own) == 1
        assert seen <= 3 or w.formatted.count("<s>system[INST]2 ") == 1
    assert set(range(0, 200, 16)) <= set(starts)


def test_empty(spark):
    assert chat.report(spark.createDataFrame([], SCHEMA)).count() == 0
