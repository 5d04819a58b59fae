"""Columns of the user's whose names an operator uses itself stay as they are."""

from pyspark.sql import functions as F

from lociform.llm import exact_dedup, near_dedup, pii, secrets

NAMES = ("row", "blob", "n", "spans", "changed", "new", "null", "others", "digest", "salt", "order", "rid", "root", "__t", "__base", "__spans", "__added", "__new", "__changed", "__blob", "__n", "__null", "__rid", "__hot", "__cold", "__spread", "__email", "size", "first", "dotted.name")


def docs(spark):
    rows = [(1, "see password=abcdefgh12 or a@b.co", 33), (2, "see password=abcdefgh12 or a@b.co", 33), (3, None, 0), (4, "one two three four five six seven", 33), (None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.concat(F.lit(f"{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def held(out, df):
    assert out.columns == df.columns
    rows = out.collect()
    for r in rows:
        assert [r[name] for name in NAMES] == [f"{k}-{'none' if r.doc_id is None else r.doc_id}" for k in range(len(NAMES))]
    return {r.doc_id: (r.text, r.n_chars) for r in rows}


def test_redactions(spark):
    df = docs(spark)
    hidden = held(secrets.redact(df, secrets.new_ledger(spark)), df)
    assert hidden[1] == ("see [SECRET] or a@b.co", 22) and hidden[3] == (None, 0) and len(hidden) == 5
    hidden = held(pii.redact(df), df)
    assert hidden[2] == ("see password=abcdefgh12 or [EMAIL]", 34) and hidden[4][1] == 33


def test_redaction_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PICKED", 0)
    df = docs(spark)
    assert held(secrets.redact(df, secrets.new_ledger(spark)), df)[1][0] == "see [SECRET] or a@b.co"


def test_dedups(spark):
    df = docs(spark)
    assert set(held(exact_dedup.dedup(df), df)) == {2, 3, 4}
    assert set(held(near_dedup.dedup(df, near_dedup.Measure(width=5, percent=80)), df)) == {1, 3, 4, None}
