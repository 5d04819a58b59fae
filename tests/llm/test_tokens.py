"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lociform.llm import bpe, packing
from lociform.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, start long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def texts():
    r = random.Random(1)
    bits = ["'", "s", "t", "re", "ll", "d", "ve", "m", " ", "  ", "\n", "\t", "!", "é", "1", "²", "日本", "🙂", " ", "́", " ", "\x1c", "\x85", "<|endoftext|>", "<|end", "word", "Word", "՘", "\x00"]
    out = ["", None, " ", "\n\n", "a" * 30000, " " * 5000, "\n \n" * 400, "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "word " * 20000]
    out += ["".join(r.choice(bits) for _ in range(r.randint(1, 16))) for _ in range(4000)]
    return out


def test_ids_and_round_trip(spark, library):
    data = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in data], SCHEMA)
    got = {r.doc_id: r for r in bpe.digests(docs, tokenizer_path()).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in data}
    for i, t in data:
        assert got[i].n_tokens == len(want[i]), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want[i])).encode()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want[i], skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs, tokenizer_path())
    assert {r.doc_id: list(np.frombuffer(r.ids, "<u4")) for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_path()).collect()} == {i: t or "" for i, t in data}


def test_every_assigned_letter(library):
    known = bpe.vocabulary(tokenizer_path()).tokenizer()
    r = random.Random(2)
    points = [chr(c) for c in [*range(0x3000), *r.sample(range(0x3000, 0x30000), 4000)] if not 0xD800 <= c < 0xE000]
    some = [f"a{c}b {c}1{c} {c}'s {c}" for c in points]
    for text, ids in zip(some, known.encode(some)):
        assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), ascii(text)


def test_a_full_table_starts_again(library):
    from lociform.llm.byte_bpe import ByteBpe

    vocabulary = bpe.vocabulary(tokenizer_path())
    small = ByteBpe(vocabulary.spec, vocabulary.table)
    small._known.MOST = 50
    some = [t or "" for t in texts()[10:600]]
    for k in range(0, len(some), 30):
        for text, ids in zip(some[k : k + 30], small.encode(some[k : k + 30])):
            assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def check_pieces(rows, want, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[doc]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc])
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
        padding += window - at if at & (at - 1) else 0
    return padding, total


def test_packing(spark, library):
    r = random.Random(5)
    data = [(i, None if i == 3 else "" if i == 4 else " ".join(r.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(int(r.lognormvariate(5, 1.2))))) for i in range(700)]
    data.append((1000, "word " * 9000))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in data], SCHEMA).repartition(3)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in data}
    padding, total = check_pieces(packing.pack(docs, tokenizer_path()).collect(), want, 1024)
    assert padding < 0.01 * total
    again = packing.pack(docs, tokenizer_path())
    assert sorted(again.collect()) == sorted(packing.pack(docs, tokenizer_path()).collect())
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_sum_of_squares_places_like_the_rule():
    r = random.Random(6)
    packer, levels = packing.Packer(16, 0), {}
    for k in range(400):
        size = r.randint(1, 15)
        packer.add(k, bytes(4 * size))
        squares = {}
        for h in [0, *[h for h, c in levels.items() if c]]:
            if h + size <= 16:
                new = dict(levels)
                if h:
                    new[h] -= 1
                if h + size < 16:
                    new[h + size] = new.get(h + size, 0) + 1
                squares[h] = (sum(c * c for c in new.values()), -h, new)
        levels = min(squares.values(), key=lambda x: x[:2])[2]
        assert {h: int(c) for h, c in enumerate(packer.count) if c} == {h: c for h, c in levels.items() if c}
    packer.settle()
    assert sum(row[2] for row in packer.rows) == sum(row[4] for row in {row[0]: row for row in packer.rows}.values())


def test_few_tokens_leave_the_window_that_the_rule_chose(spark, library):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), tokenizer_path()).select("length", "sequence_id", "moved").collect()
    total, fill = sum(r.length for r in rows), {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(r.length for r in rows if r.moved) < 0.05 * total
    assert sum(1024 - n for n in fill.values() if n & (n - 1)) < 0.01 * total


def test_open_windows_are_settled_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(packing, "HELD", 5000)
    packer = packing.Packer(1024, 0)
    for k in range(300):  # no two fit together, so the rule alone would leave all windows open
        packer.add(k, bytes(4 * (520 + k % 7)))
        assert packer.held <= 5000 + 1024
    packer.settle()
    own = {}
    for doc, start, size, _, total, sequence, offset, _ in packer.rows:
        own.setdefault(sequence, []).append((offset, size))
    for pieces in own.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at and size > 0
            at += size
        assert at <= 1024
    fill = [sum(size for _, size in x) for x in own.values()]
    assert sum(fill) == sum(520 + k % 7 for k in range(300)) and sum(1024 - x for x in fill if x & (x - 1)) < 0.01 * sum(fill)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, "c", "", 0)], SCHEMA)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in bpe.digests(docs, tokenizer_path()).collect()) == [(-1, 1), (1, 2), (1, 2)]
    assert sum(r.length for r in packing.pack(docs, tokenizer_path()).collect()) == 8
