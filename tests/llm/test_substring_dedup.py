"""Sentence-span deduplication against a plain reading of the rule."""

import hashlib
import random
import re

from lociform.llm import substring_dedup as sd
from lociform.llm.shingles import word_hashes

SCHEMA = "doc_id long, text string, rid long, places string"


def sentences(text):
    """Start, end and words of each sentence, word by word."""
    out, own, begin = [], [], None
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for k, m in enumerate(found):
        begin = m.start() if begin is None else begin
        own.append(re.sub("[A-Z]", lambda c: c[0].lower(), m[0]))
        after = found[k + 1].start() if k + 1 < len(found) else len(text)
        if re.search(r"[.!?][\"')\]]{0,3}$", m[0]) or "\n" in text[m.end() : after] or k + 1 == len(found):
            if len(own) > sd.LONG:
                at, part, ends = begin, [], [x.end() for x in found[k + 1 - len(own) : k + 1]]
                for i, word in enumerate(own):
                    part.append(word)
                    if int(word_hashes(word.encode())[0][0]) % sd.PICK == 0 and i + 1 < len(own):
                        end = found[k + 2 - len(own) + i].start()
                        out.append((at, end, part))
                        at, part = end, []
                assert ends
                out.append((at, after, part))
            else:
                out.append((begin, after, own))
            own, begin = [], None
    return out


def runs(parts):
    out = []
    for k in range(len(parts)):
        for end in range(k + sd.SPAN, len(parts) + 1):
            words = [w for _, _, own in parts[k:end] for w in own]
            if len(words) >= sd.WORDS:
                out.append((k, end - k, tuple(words)))
                break
    return out


def corpus():
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(500)]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + r.choice(".!?")
    clean = [" ".join(sentence(r.randint(3, 25)) for _ in range(r.randint(1, 12))) for _ in range(40)]
    passages = [" ".join(sentence(r.randint(6, 14)) for _ in range(6)) for _ in range(4)] + [sentence(70)]
    out = list(clean)
    planted = []
    for k in range(60):
        head, tail = clean[k % 40].split()[:9], sentence(11)
        planted.append(len(out))
        out.append(f"{' '.join(r.choice(vocab) for _ in head)}. {passages[k % 5].upper() if k % 7 == 0 else passages[k % 5]}{r.choice([' ', chr(10)])}{tail}")
    out += ["", None, "The " * 400, "The " * 500, "x" * 30000, "short. one.", "short. one."]
    return out, planted


def want(data):
    first, out = {}, []
    key = lambda i, d: (d if d is not None else 1 << 63, i)
    for i, (d, t) in enumerate(data):
        for k, _, h in runs(sentences(t or "")):
            first[h] = min(first.get(h, (1 << 64, 0, 0)), (*key(i, d), k))
    for i, (d, t) in enumerate(data):
        text = t or ""
        parts = sentences(text)
        gone = {j for k, size, h in runs(parts) if first[h] != (*key(i, d), k) for j in range(k, k + size)}
        kept, at = [], 0
        for j, (a, b, _) in enumerate(parts):
            if j in gone:
                kept.append(text[at:a])
                at = b
        kept = "".join([*kept, text[at:]])
        out.append((d, len(parts), len(gone), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_report(spark):
    texts, planted = corpus()
    data = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, 0, "clash") for d, t in data], SCHEMA).coalesce(1)
    got = sorted((r.doc_id, r.n_sentences, r.n_removed, r.kept_chars, r.kept_sha256) for r in sd.report(docs).collect())
    assert got == sorted(want(data))
    removed = {d: n for d, _, n, _, _ in got}
    assert all(removed[d] == 0 for d in range(40))  # clean documents are left alone
    assert sum(removed[d] > 0 for d in planted) == len(planted) - 5  # all but the first of each passage


def test_sentences_cover_the_text():
    for text in corpus()[0]:
        parts = sentences(text or "")
        assert all(a < b for a, b, _ in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
        assert [w for _, _, words in parts for w in words] == re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def passages(r, vocab):
    """Streams of words: sentences of 14 to 16 words, no marks, and tables of words that no hash picks."""
    marked = [w + ("." if k % 15 == 14 else "") for k, w in enumerate(r.choice(vocab) for _ in range(160))]
    odd = [w for w in vocab if int(word_hashes(w.encode())[0][0]) % sd.PICK][:3]
    return {"marked": marked, "plain": [r.choice(vocab) for _ in range(160)], "table": [r.choice(odd) for _ in range(160)], "period": odd * 54, "constant": odd[:1] * 160}


def test_repeats_of_51_words_hold_a_run_at_every_offset():
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(2000)]
    around = lambda: [r.choice(vocab) for _ in range(40)]
    for kind, words in passages(r, vocab).items():
        for offset in range(100):
            own = words[offset : offset + 51]
            texts = [" ".join([*around(), *own, *around()]).encode() for _ in range(2)]
            b = sd.Batch(texts)
            assert (b.last - b.first).max() <= sd.GAP
            a, c = (set(zip(b.high[b.text[b.run] == k].tolist(), b.low[b.text[b.run] == k].tolist())) for k in (0, 1))
            assert a & c, (kind, offset)


def test_repeats_that_begin_and_end_inside_sentences_are_removed(spark):
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(5000)]
    data = []
    for k in range(40):
        words = [w + ("." if i % 15 == 14 else "") for i, w in enumerate(r.choice(vocab) for _ in range(80))]
        own = " ".join(words[k % 20 : k % 20 + 51] if k % 2 else [w.strip(".") for w in words[:51]])
        data += [(2 * k + j, f"{' '.join(r.choice(vocab) for _ in range(5 + k))} {own} {' '.join(r.choice(vocab) for _ in range(9))}", 0, "") for j in (0, 1)]
    for row in sd.dedup(spark.createDataFrame(data, SCHEMA)).collect():
        gone = sum(len(data[row.doc_id][1][s.start : s.end].split()) for s in row.spans)
        assert gone == 0 if row.doc_id % 2 == 0 else 20 <= gone <= 51


def test_nulls_and_empty(spark):
    assert sd.report(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen. Eighteen nineteen twenty."
    got = sd.dedup(spark.createDataFrame([(None, text, 0, ""), (4, text, 0, ""), (4, text, 0, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 4), (4, 0), (4, 4)]
