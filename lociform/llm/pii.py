"""Operator 8: personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap.  Base candidates
(email, ip, card, phone) are settled by their formats and always stay.  Further
generators propose national phone and identity numbers, account numbers,
spelled out addresses, and cards and phones inside longer runs of digits that no
base format takes.  Boosted trees score these by format and context; a kind's
threshold is calibrated on held-out examples.  Of what reaches it, spans that
overlap a base span go, then of overlapping ones all but the first and longest.

Trees learn from made-up examples and from candidates of some ``DOCS`` documents
that a hash chooses over the whole corpus, at most ``WEAK`` of each kind and
label; all documents are scored.  Candidates are labelled by weak rules: a candidate inside a base span is personal, one that touches neither a
base span nor a match of a base generator that fails its format is not, and
others are left out.

A generator's matches are found in one regular-expression pass: matches are
fenced with a control character and the text is split at the fences, so lengths
of the parts give positions in code points.

Defined results: null text counts as empty (``redact`` leaves it null); texts
without candidates get zeros and the digest of the empty string; repeated rows
stay repeated; a null ``doc_id`` stays null; an empty table gives an empty
result; ``report`` reads no other columns, and ``redact`` hands all of them on.
Patterns are possessive or anchored at the start of a run, so very long texts
and runs cost linear time and no stack.
"""

from __future__ import annotations

import functools
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import as_row, id_and_text, masked, rewritten

#: Base formats.  \G stands for the end of the previous match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators that the method adds.
NUMBER = r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,6}){1,4}+(?![0-9A-Za-z])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"
SPELLED = r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,24}+)++"

CARDPART = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+)(?![0-9])"
PHONEPART = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "account", "spelled", "cardpart", "phonepart")
KINDS = (*BASE, *ADDED)
#: The most weakly labelled candidates of each kind and label that trees learn from.
WEAK = 400
#: About how many documents they are taken from; learning costs a part of a pass beyond it.
DOCS = 4096
_FENCE, _STAND_IN, _BLOCK = "\x01", "\x02", 256
_SPAN = "struct<kind:string,start:long,end:long>"


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points.

    Positions are summed in blocks, so the cost of many matches stays near
    linear.  ``text`` holds no fence.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_FENCE}$0{_FENCE}")), _FENCE)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / (2 * _BLOCK)).cast("int")), lambda b: F.slice(parts, b * (2 * _BLOCK) + 1, 2 * _BLOCK))
    empty = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def one(block: Column, first: Column) -> Column:
        # Within a block, parts at odd places are matches.
        def step(acc: Column, part: Column) -> Column:
            stop = acc["at"] + F.length(part)
            grown = F.when(acc["odd"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), stop.alias("end"), part.alias("match"))))).otherwise(acc["out"])
            return F.struct(stop.alias("at"), (~acc["odd"]).alias("odd"), grown.alias("out"))

        return F.aggregate(block, F.struct(first.alias("at"), F.lit(False).alias("odd"), empty.alias("out")), step, lambda acc: acc["out"])

    def ahead(acc: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0).cast("long"), lambda a, p: a + F.length(p))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    starts = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")), ahead, lambda acc: acc["out"])
    return F.flatten(F.zip_with(blocks, starts, one))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check over a string of at most 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        size = F.length(digits)
        return F.when(size.between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


# --- scored candidates -------------------------------------------------------

#: Words before a candidate that speak for or against personal data.
FOR = r"(?i)(?:phone|tel|mobile|call|fax|ssn|social|passport|iban|account|acct|konto|id|mail|contact|reach|write)\W*+(?:no|number|nr|is|me|at|to)?\W*+$"
AGAINST = r"(?i)(?:version|isbn|page|pages|chapter|section|year|price|order|item|vol|figure|table|score|from)\W*+(?:no|number|nr|is|of)?\W*+$"
FEATURES = ("digits", "groups", "letters", "shape", "bracket", "for", "against", "marks", "check")
_SHAPE = {"number": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}", "account": r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,34}", "spelled": r"[A-Za-z0-9._-]+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9.()\[\]\x20-]+", "cardpart": r"[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}", "phonepart": r"\+[0-9]{1,3}\x20?\(?[0-9]{3}\)?[\x20-][0-9]{3}-?[0-9]{4}"}


def features(kind: str, match: str, before: str) -> dict[str, float]:
    """The features of one candidate; ``feature_column`` gives the same as Columns."""
    return {
        "digits": float(len(re.sub("[^0-9]", "", match))),
        "groups": float(len(re.findall("[0-9]+", match))),
        "letters": float(len(re.sub("[^A-Za-z]", "", match))),
        "shape": float(bool(re.fullmatch(_SHAPE[kind], match))),
        "bracket": float("(" in match or "[" in match),
        "for": float(bool(re.search(FOR, before))),
        "against": float(bool(re.search(AGAINST, before))),
        "marks": float(len(re.sub(r"[A-Za-z0-9\x20]", "", match))),
        "check": float(luhn(re.sub("[^0-9]", "", match))),
    }


def luhn(digits: str) -> bool:
    """Whether 13 to 19 digits pass Luhn's check."""
    each = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in each) % 10 == 0


def feature_column(kind: str, match: Column, before: Column, name: str) -> Column:
    made = {
        "digits": lambda: F.length(_digits(match)),
        "groups": lambda: F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))),
        "letters": lambda: F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
        "shape": lambda: match.rlike(f"^(?:{_SHAPE[kind]})$"),
        "bracket": lambda: match.contains("(") | match.contains("["),
        "for": lambda: before.rlike(FOR),
        "against": lambda: before.rlike(AGAINST),
        "marks": lambda: F.length(F.regexp_replace(match, r"[A-Za-z0-9\x20]", "")),
        "check": lambda: F.when(F.length(_digits(match)).between(13, 19), _luhn(_digits(match))).otherwise(F.lit(False)),
    }
    return made[name]().cast("int").cast("double")


def examples(kind: str, seed: int = 5, n: int = 240) -> tuple[list[dict[str, float]], list[int]]:
    """Generated candidates with their labels."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(3, 8)))
    good_ctx, bad_ctx, plain = ("phone: ", "call ", "tel. ", "SSN ", "IBAN: ", "account no ", "mail "), ("version ", "pages ", "price ", "ISBN ", "order no ", "score "), (" ", "and ", "of the ")
    x, y = [], []
    for _ in range(n):
        good = r.random() < 0.5
        if kind == "number":
            match = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(2)}-{d(4)}")) if good else r.choice((f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}", f"{d(3)} {d(3)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(5)}-{d(2)}", f"{d(3)}.{d(2)}.{d(2)}"))
        elif kind == "account":
            match = r.choice(("DE", "FR", "ES", "GB")) + d(2) + (" " if r.random() < 0.5 else "").join(["", *(d(4) for _ in range(4))]) + d(2) if good else "AB" + d(2) + "".join(r.choice("ABCDEFGHXYZ0123456789") for _ in range(r.choice((8, 12, 16))))
        elif kind == "cardpart":
            body = d(15)
            last = next(c for c in "0123456789" if luhn(body + c) == good)
            match = body + last if r.random() < 0.6 else " ".join((body + last)[k : k + 4] for k in range(0, 16, 4))
        elif kind == "phonepart":
            match = r.choice((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)}-{d(4)}")) if good else r.choice((f"+{d(1)}{d(2)}{d(3)}{d(3)}", f"+{d(3)}.{d(2)}.{d(3)}.{d(3)}", f"+{d(2)}-{d(2)}-{d(3)}{d(3)}"))
        else:
            match = f"{word()}(at){word()}(dot)com" if good else f"{word()} [at] {word()}. {word()}"
        before = r.choice((*good_ctx, *plain) if good else (*bad_ctx, *plain, *plain))
        x.append(features(kind, match, before))
        y.append(int(good))
    return x, y


@functools.cache
def model(kind: str) -> Boosted:
    """Trees from made-up examples only."""
    return Boosted().fit(*examples(kind))


def _some(docs: DataFrame, most: int = 0) -> DataFrame:
    """Texts of about ``DOCS`` documents (or ``most``), chosen by a hash of the whole text; all of a smaller table."""
    total = docs.count()
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if total <= (most or DOCS):
        return texts
    return texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((most or DOCS) / total * (1 << 30)))


def models(docs: DataFrame) -> dict[str, Boosted]:
    """Trees of each added kind, from made-up examples and weakly labelled candidates of the corpus."""
    own: dict[str, list] = {kind: [] for kind in ADDED}
    for row in sorted(weak(_some(docs)).collect()):
        own[row["kind"]].append((features(row["kind"], row["match"], row["before"]), int(row["label"])))
    out = {}
    for kind, more in own.items():
        x, y = examples(kind)
        out[kind] = Boosted().fit([*x, *(f for f, _ in more)], [*y, *(label for _, label in more)]) if more else model(kind)
    return out


def _patterns() -> dict[str, tuple[str, Column]]:
    """Each kind's generator, and a test that texts without candidates fail."""
    digit = F.col("__t").rlike("[0-9]")
    return {
        "email": (EMAIL, F.col("__t").contains("@")),
        "ip": (IP, digit & F.col("__t").rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        "card": (CARD, digit & F.col("__t").rlike(CARD)),
        "phone": (PHONE, F.col("__t").rlike(r"\+[0-9]")),
        "number": (NUMBER, digit & F.col("__t").rlike(r"[0-9]\)?[\x20./-][0-9]")),
        "account": (ACCOUNT, digit & F.col("__t").rlike(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}")),
        "spelled": (SPELLED, F.col("__t").rlike(r"[(\[]at[)\]]")),
        "cardpart": (CARDPART, digit & F.col("__t").rlike(CARDPART)),
        "phonepart": (PHONEPART, F.col("__t").rlike(r"\+[0-9]")),
    }


def _named(kind: str, spans: Column, hint: Column) -> Column:
    named = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(hint, named).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _based(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__t`` (the text without the fence), an array of spans of each base kind, and ``__base``, all of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__t", F.when(text.contains(_FENCE), F.translate(text, _FENCE, _STAND_IN)).otherwise(text))
    patterns = _patterns()

    def valid(kind: str) -> Column:
        pattern, hint = patterns[kind]
        return _named(kind, F.filter(_spans(F.col("__t"), pattern), lambda s: _valid(kind, s["match"])), hint)

    return rows.withColumns({f"__{kind}": valid(kind) for kind in BASE}).withColumn("__base", F.concat(*(f"__{kind}" for kind in BASE)))


def _before(s: Column) -> Column:
    """Up to 24 characters before a candidate."""
    return F.substring(F.col("__t"), F.greatest(s["start"] - 23, F.lit(1)).cast("int"), F.least(s["start"], F.lit(24)).cast("int"))


def _apart(s: Column, spans: str = "__base") -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def weak(docs: DataFrame, most: int = WEAK) -> DataFrame:
    """``kind``, ``label``, ``match``, ``before``: at most ``most`` candidates of each added kind and label, chosen by a hash."""

    def labelled(kind: str, pattern: str, hint: Column) -> Column:
        inside = lambda s: F.exists("__base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
        each = F.transform(_spans(F.col("__t"), pattern), lambda s: F.struct(F.lit(kind).alias("kind"), F.when(inside(s), 1).when(_apart(s) & _apart(s, "__odd"), 0).alias("label"), F.substring(s["match"], 1, 80).alias("match"), _before(s).alias("before")))
        return F.when(hint, F.filter(each, lambda c: c["label"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,label:int,match:string,before:string>>"))

    patterns = _patterns()

    def failing(kind: str) -> Column:
        pattern, hint = patterns[kind]
        return _named(kind, F.filter(_spans(F.col("__t"), pattern), lambda s: ~_valid(kind, s["match"])), hint)

    rows = _based(docs.select("text")).withColumn("__odd", F.concat(*map(failing, ("ip", "card", "phone")))).select(F.inline(F.concat(*(labelled(kind, *patterns[kind]) for kind in ADDED)))).distinct()
    rank = F.row_number().over(W.partitionBy("kind", "label").orderBy(F.xxhash64("match", "before"), "match", "before"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("kind", "label", "match", "before")


def _found(docs: DataFrame, trees: dict[str, Boosted]) -> DataFrame:
    """``_based`` with ``__added``, the spans that the method adds, settled and by start."""
    patterns = _patterns()

    def chosen(kind: str) -> Column:
        pattern, hint = patterns[kind]
        good = lambda s: trees[kind].column(lambda name: feature_column(kind, s["match"], _before(s), name)) >= F.lit(trees[kind].threshold)
        return _named(kind, F.filter(F.filter(_spans(F.col("__t"), pattern), lambda s: _apart(s)), good), hint)

    rows = _based(docs).withColumn("__added", F.concat(*(chosen(kind) for kind in ADDED)))
    order = F.array_sort(F.transform("__added", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def settle(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"))
        return F.struct(F.when(free, -s["back"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    settled = F.aggregate(order, begin, settle, lambda acc: acc["out"])
    return rows.withColumn("__added", F.when(F.size("__added") > 1, settled).otherwise(F.col("__added")))


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: sum((F.when(s["kind"] == kind, k).otherwise(0) for k, kind in enumerate(KINDS)), F.lit(0))
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _shown(spans: Column) -> Column:
    """kind:start:end of all spans."""
    return F.array_join(F.transform(_sorted(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, trees: dict[str, Boosted] | None = None) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and how many they are."""
    rows = id_and_text(docs)
    return _found(rows, trees or models(rows)).select(
        "doc_id",
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_shown(F.col("__base")), 256).alias("base_sha256"),
        _shown(F.concat("__base", "__added")).alias("spans"),
        F.size(F.concat("__base", "__added")).cast("long").alias("n_spans"),
        F.size("__added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, trees: dict[str, Boosted] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced together, by the first kind.

    All columns stay; ``n_chars``, where it is present, is counted anew for changed texts.
    """
    rows = _found(docs.select(as_row(docs), "text"), trees or models(docs)).withColumn("__spans", _sorted(F.concat("__base", "__added")))
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    return rewritten(rows, F.size("__spans") > 0, masked(F.col("text"), F.col("__spans"), mark))
