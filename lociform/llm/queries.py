"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact_dedup, licenses, near_dedup, neighbours, packing, pii, quality, ranked, secrets, substring_dedup
from .common import table


def tokenizer_path() -> str:
    """Where the byte-level vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """Where the sentencepiece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.pmod(F.col("vec_id"), F.lit(20)) == 0), k=20)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    fixed = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(own))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.unionByName(fixed))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: an earlier one holds the English documents; the whole table then meets a filled ledger."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.new_ledger(spark)
    ledger.update(docs.filter(F.col("lang") == "en"))
    return secrets.report(docs, ledger)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_neighbours, op3_chat, op4_bpe, op5_packing, op6_substring_dedup, op7_secrets, op8_pii, op9_exact_dedup, op10_near_dedup, op11_licenses, op12_ranked, op13_alignment)}

def _spans_sql(kind: str, pattern: str, rank: int, keep: str = "true") -> str:
    """Spans of one pattern: matches and the parts between them give positions in code points."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s.a AS a, s.a + length(s.m) AS b FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)}})) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS p FROM d) WHERE len(m) > 0) WHERE {keep}"""


_ASSIGN_SQL = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_SPANS = (
    ("assign", _ASSIGN_SQL, "length(regexp_extract(s.m, '" + _ASSIGN_SQL.replace("'", "''") + "', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(s.m) >= 16"),
    ("hex", "[0-9a-f]+", "length(s.m) >= 32"),
    ("keyblock", secrets.KEY_BLOCK.pattern, "true"),
    ("bearer", secrets.BEARER.pattern, "true"),
)

ORACLE_SQL: dict[str, str] = {
    "op7_secrets": f"""
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
        f AS ({" UNION ALL ".join(_spans_sql(kind, pattern, k, keep) for k, (kind, pattern, keep) in enumerate(_SECRET_SPANS))}),
        g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
    """,
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, top) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.doc_id)
        SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.top) AS component_id, w.doc_id = min(r.top) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
    """,
    "op12_ranked": r"""
        WITH t AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
        f AS (SELECT r, doc_id, t, count(*) AS tf FROM t GROUP BY r, doc_id, t),
        n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        m AS (SELECT r, 50 + (50 * n * docs) // total AS m FROM n, s),
        q AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM f GROUP BY t), s),
        c AS (SELECT item_id, f.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM q JOIN w ON q.t = w.t JOIN f ON f.t = q.t JOIN m ON m.r = f.r GROUP BY item_id, f.r, doc_id HAVING sum(w) > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 50
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text
    """,
}
