"""Secrets and personal data against plain regular expressions over whole texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lociform.llm import pii, secrets

SCHEMA = "doc_id long, text string, blob string, spans string"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def card(r):
    body = "".join(r.choice("0123456789") for _ in range(r.randint(13, 18)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def texts():
    r = random.Random(4)
    bits = ["a@b.co", "_x@y.com", "é", "🙂", "\x01", "\x02", "$0", "\\", "256.1.2.3", "1.2.3.4", "001.02.3.255", ".5", "+1 (555) 123-4567", "+", "12", "-", " ", "\n", "(", ")", "@", "x.y@-z.-.q", "4111 1111 1111 1111", "password=", "ToKen: '", "abcdefgh", "API_KEY ", "=", "AKIA", "ABCDEFGHJKLM", "deadbeef" * 4, "0123", "ſecret=abcdefghij", "Licensed v2.0", "(415) 555-1234", "ssn 123-45-6789", "DE44 5001 0517 5407 3249 31", "me(at)site(dot)org", "ghp_" + "a1" * 20]
    out = ["", None, "9" * 20000, "a" * 20000, "1." * 5000, "+1" + "-2" * 5000, "a." * 4000 + "@x.y", "1 " * 4000]
    out += ["".join(r.choice(bits) if r.random() < 0.9 else card(r) for _ in range(r.randint(1, 14))) for _ in range(600)]
    out.append(" ".join(["1.2.3.4", "me@here.org"] * 900))
    return out


def rows():
    return [(i, t, "clash", "clash") for i, t in enumerate(texts())] + [(0, "again a@b.co", None, None), (None, "a@b.co password=abcdefgh", None, None)]


def test_pii_base_spans(spark):
    data = rows()
    got = pii.report(spark.createDataFrame(data, SCHEMA)).collect()
    want = sorted((d if d is not None else -1, digest(s), *(sum(k == kind for k, _, _ in s) for kind in pii.BASE)) for d, s in ((d, base_pii(t or "")) for d, t, _, _ in data))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    shown = {r.doc_id: r.spans for r in got}
    for d, t, _, _ in data[: len(texts())]:
        if d:
            assert {f"{k}:{a}:{b}" for k, a, b in base_pii(t or "")} <= set(shown[d].split(",")) | {""}


def test_pii_added_kinds(spark):
    data = [(1, "phone: (415) 555-1234 ok"), (2, "see 12/11/2020 and version 2.0.1"), (3, "IBAN: DE44500105175407324931"), (4, "write me(at)site(dot)org"), (5, "Ünder SSN 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert "number:7:21" in got[1] and got[2] == "" and "account:6:28" in got[3] and "spelled:6:24" in got[4] and "number:10:21" in got[5]


def test_pii_trees_agree_with_columns(spark):
    from pyspark.sql import functions as F

    for kind, match, before in (("number", "(415) 555-1234", "call "), ("number", "12.11", "version "), ("account", "DE44500105175407324931", ""), ("spelled", "me(at)x(dot)de", "mail "), ("cardpart", "4111111111111111", ""), ("phonepart", "+1 (826) 555-4081", "des ")):
        row = pii.features(kind, match, before)
        got = spark.range(1).select(*(pii.feature_column(kind, F.lit(match), F.lit(before), n).alias(n) for n in pii.FEATURES), pii.model(kind).column(lambda n: pii.feature_column(kind, F.lit(match), F.lit(before), n)).alias("p")).first()
        assert {n: got[n] for n in pii.FEATURES} == row
        import math

        assert abs(got.p - 1 / (1 + math.exp(-pii.model(kind).margin(row)))) < 1e-9


def test_pii_settles_overlaps_and_redacts(spark):
    data = [
        (1, "des +1 (826) 555-4081 190.137.223.204 du", 1, None),  # one run of phone characters with too many digits
        (2, "le 4111111111111111 5500000000000004 fin", 2, None),  # two cards in one run
        (3, "\x01é +1 (555) 123-4567, a@b.co", 3, None),
        (4, None, None, None),
        (5, "clean", 5, None),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, __x string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[1].spans == "phonepart:4:21,ip:22:37" and got[1].n_added == 1 and got[1].n_spans == 2
    assert got[2].spans == "cardpart:3:19,cardpart:20:36" and got[2].n_card == 0
    assert got[3].spans == "phone:3:20,email:22:28" and got[3].n_added == 0  # the tail of a phone is no number of its own
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()}
    assert text[1] == ("des [PHONEPART] [IP] du", 23) and text[2][0] == "le [CARDPART] [CARDPART] fin"
    assert text[3][0] == "\x01é [PHONE], [EMAIL]" and text[4] == (None, None) and text[5] == ("clean", 5)


def test_pii_weak_labels(spark):
    text = "tel +1 (555) 123-4567 and 12.34 then 4111 1111 1111 1111"
    rows = {(r.kind, r.match): r.label for r in pii.weak(spark.createDataFrame([(text,)], "text string")).collect()}
    assert rows[("phonepart", "+1 (555) 123-4567")] == 1 and rows[("number", "12.34")] == 0 and rows[("cardpart", "4111 1111 1111 1111")] == 1
    many = spark.range(3000).select(F.concat(F.lit("go 12."), (F.col("id") + 1000).cast("string"), F.lit(" on")).alias("text"))
    assert pii.weak(many, 50).count() == 50
    assert pii._some(many).count() == 3000 and 350 < pii._some(many, 500).count() < 650


def test_secrets_base_spans_and_ledger(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    ledger = secrets.new_ledger(spark)
    got = secrets.report(docs, ledger).collect()
    want = sorted((d if d is not None else -1, digest(s), *(sum(k == kind for k, _, _ in s) for kind in secrets.BASE)) for d, s in ((d, base_secrets(t or "")) for d, t, _, _ in data))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    n = ledger.entries().count()
    assert n == len({t or "" for _, t, _, _ in data})
    more = spark.createDataFrame([(7, "token=abcdefgh9", "", ""), (8, data[9][1], "", "")], SCHEMA)
    assert [r.n_assign for r in secrets.report(more, ledger).orderBy("doc_id").collect()][0] == 1
    assert ledger.entries().count() == n + 1  # only the unseen blob was scanned
    assert ledger.rules == secrets.RULES and len(secrets.RULES) == 16
    ledger.rules = "other"
    assert secrets.report(more, ledger).count() == 2 and ledger.entries().count() == n + 3


def test_redaction(spark):
    text = "é password=abcdefgh12 and AKIAABCDEFGHJKLM token=" + "0" * 40 + " end"
    docs = spark.createDataFrame([(1, text, len(text)), (2, "clean", 5), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(docs, secrets.new_ledger(spark)).collect()}
    assert got[1].text == "é [SECRET] and [SECRET] [SECRET] end" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[3].text is None


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii.report(docs).count() == 0 and secrets.report(docs, secrets.new_ledger(spark)).count() == 0
