"""Token groups, links and corpus counts against a plain walk over both tokenizers' tokens."""

import hashlib
import random
from collections import Counter

import pytest

from lociform.llm import alignment
from lociform.llm.bpe import vocabulary
from lociform.llm.queries import piece_model_path, tokenizer_path

SCHEMA = "doc_id long, text string, row string, links string"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    aligner = alignment.Aligner(vocabulary(tokenizer_path()), b.serialized_model_proto())
    bytes_a, bytes_b = aligner._a.token_bytes, aligner._b.token_bytes

    def walk(text):
        if not text:
            return 0, 0, [], ""
        ids, pieces, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(bytes_a[i] for i in ids) != raw or b"".join(bytes_b[i] for i in pieces) != raw:
            return 0, 0, [], ""
        i = j = x = y = 0
        groups, links, own = [], [], ([], [])
        while i < len(ids) or j < len(pieces):
            if x <= y:
                own[0].append(ids[i])
                x, i = x + len(bytes_a[ids[i]]), i + 1
            else:
                own[1].append(pieces[j])
                y, j = y + len(bytes_b[pieces[j]]), j + 1
            if x == y:
                groups.append(own)
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        return len(ids), len(pieces), links, ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)

    return aligner, walk


def texts():
    r = random.Random(2)
    bits = ["a", " ", "  ", "▁", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", "é", "🙂", "ﬁ", "　", "\xa0", "\n", "\t", "don't", "'s", " 12", "the ", " the", "\x00", "中文", "_", "ing", "Über"]
    out = ["", None, " ", "   ", "▁", "x▁y", "a ", " a", "<|endoftext|>", "</s> <s>", "a" * 20000, " a" * 9000, "é" * 3000, "the cat " * 4000]
    return out + ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)]


def test_groups_of_a_slice(plain):
    aligner, walk = plain
    every = [t or "" for t in texts()]
    for step in (1, 7, len(every)):
        for k in range(0, len(every), step):
            some = every[k : k + step]
            got = aligner.align(some)
            links, shown, where = aligner.links(got).tolist(), aligner.shown(got), got.text_group.tolist()
            for q, text in enumerate(some):
                n_a, n_b, pairs, groups = walk(text)
                assert (got.text_a[q + 1] - got.text_a[q], got.text_b[q + 1] - got.text_b[q], shown[q].decode()) == (n_a, n_b, groups)
                assert links[where[q] : where[q + 1]] == [a * aligner.width + b for a, b in pairs]


def test_pieces_that_cannot_be_cut(plain):
    aligner, walk = plain
    some = [t or "" for t in texts()[:40]]
    before = [aligner.shown(aligner.align(some)), aligner._b.cuttable]
    aligner._b.cuttable = False
    try:
        assert aligner.shown(aligner.align(some)) == before[0] and before[1]
    finally:
        aligner._b.cuttable = True


def test_spans_are_scanned_in_parts():
    labels = b"nnabx" * 3 + b"n" * (3 << 20) + b"x" + b"abx"
    assert alignment._stops(labels).tolist() == [5, 10, 15, 16 + (3 << 20), 19 + (3 << 20)] and alignment._stops(b"").tolist() == []


@pytest.mark.parametrize("most", [alignment.PAIRS, 0])
def test_report(spark, plain, most):
    _, walk = plain
    data = [(k, t, "clash", "clash") for k, t in enumerate(texts())] + [(3, "the cat", None, None), (None, "the cat", None, None), (None, "the cat", None, None)]
    walked = [walk(t) for _, t, _, _ in data]
    count = Counter(p for _, _, links, _ in walked for p in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (d, *_), (n_a, n_b, links, groups) in zip(data, walked):
        want.append((str(d), n_a, n_b, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    got = alignment.report(spark.createDataFrame(data, SCHEMA).repartition(3), tokenizer_path(), piece_model_path(), most).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted(want)
    if most:
        table = alignment.pairs(spark.createDataFrame(data, SCHEMA), tokenizer_path(), piece_model_path()).collect()
        assert {(r.a_id, r.b_id): r.n for r in table} == dict(count) and all(r.best == (count[r.a_id, r.b_id] == best[r.b_id]) for r in table)
        shown = {r.doc_id: r.groups for r in alignment.align(spark.createDataFrame(data[:30], SCHEMA), tokenizer_path(), piece_model_path()).collect()}
        assert shown == {d: walk(t)[3] for d, t, _, _ in data[:30]}


def test_tasks_hand_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 3)
    docs = spark.createDataFrame([(k, "one two three four five six") for k in range(20)], "doc_id long, text string")
    rows = alignment.report(docs, tokenizer_path(), piece_model_path()).collect()
    assert len(rows) == 20 and {r.count_sum for r in rows} == {20 * rows[0].n_links}


def test_empty(spark):
    assert alignment.report(spark.createDataFrame([], SCHEMA), tokenizer_path(), piece_model_path()).count() == 0
