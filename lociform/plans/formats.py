"""Registered queries of readers and writers: a table is written in a file format, read back, and held against SQL.

Files are made by Spark from the same derived tables, in line order, so readers
meet folders of several files.
"""

from __future__ import annotations

import io
import json
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import align, geno, gwas, screen
from ..sources import bed, files, sinks, specs, text
from .catalog import _SCAN, _SCAN_OUT, G, _intercept, _scanned, query, r6
from .fixtures import Tables


def _written(t: Tables, rows: DataFrame, order: str, line: Column, name: str, head: str | None = None) -> str:
    """Path of a new text file: ``head``, then a line for each row."""
    path = files.scratch(t.spark, name)
    rows.repartitionByRange(3, order).sortWithinPartitions(order).select(line.alias("value")).write.text(f"{path}/b")
    if head is not None:
        files.put(f"{path}/a/head", (head + "\n").encode())
    # Both are one table: files in order of their names.
    return f"{path}/*"


def _people(t: Tables) -> DataFrame:
    return t.read("customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("string").alias("nation"))


_LINE = "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS sample_idx, c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS nation FROM customer"


@query(f"SELECT sample_idx, nation AS fid, 'i' || CAST(k AS VARCHAR) AS iid FROM ({_LINE}) WHERE k % 17 <> 3", tables=False)
def read_fam(t: Tables) -> DataFrame:
    """Lines with tabs, runs of blanks and too few fields: those drop out, but keep their numbers."""
    iid = F.concat(F.lit("i"), F.col("k").cast("string"))
    line = F.when(F.col("k") % 17 == 3, F.concat(F.lit("  "), "nation", F.lit(" "))).when(F.col("k") % 5 == 1, F.concat(F.lit(" \t"), "nation", F.lit("\t \t"), iid, F.lit("  0\t0 0 -9 "))).otherwise(F.concat_ws(" ", "nation", iid, F.lit("0 0 0 -9")))
    return text.read_fam(t.spark, _written(t, _people(t), "k", line, "fam"))


@query(f"SELECT sample_idx, nation AS fid, 'i' || CAST(k AS VARCHAR) AS iid FROM ({_LINE})", tables=False)
def read_fam_strict(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", "nation", F.concat(F.lit("i"), F.col("k").cast("string")), F.lit("0 0 0 -9"))
    return text.read_fam(t.spark, _written(t, _people(t), "k", line, "fam"), strict=True)


@query(f"SELECT sample_idx, 'i' || CAST(k AS VARCHAR) AS iid FROM ({_LINE})", tables=False)
def read_psam(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", F.lit("1"), "nation", F.concat(F.lit("i"), F.col("k").cast("string")))
    return text.read_psam(t.spark, _written(t, _people(t), "k", line, "psam", "##made=here\n#SEX\tFID\tIID"))


@query(f"SELECT sample_idx, 'i' || CAST(k AS VARCHAR) AS iid FROM ({_LINE})", tables=False)
def read_psam_plain(t: Tables) -> DataFrame:
    """Without a header the first line is a sample, the second field its id."""
    line = F.concat_ws(" ", "nation", F.concat(F.lit("i"), F.col("k").cast("string")), F.lit("1"))
    return text.read_psam(t.spark, _written(t, _people(t), "k", line, "psam"))


@query(f"SELECT sample_idx, 'i' || CAST(k AS VARCHAR) AS fid, 'i' || CAST(k AS VARCHAR) AS iid, '0' AS father, '0' AS mother, '0' AS sex, '-9' AS status FROM ({_LINE})", tables=False)
def fam_from_psam(t: Tables) -> DataFrame:
    line = F.concat(F.lit("i"), F.col("k").cast("string"))
    return text.fam_from_psam(text.read_psam(t.spark, _written(t, _people(t), "k", line, "psam", "#IID")))


@query("SELECT CAST(c_custkey AS BIGINT) AS sample_idx, 'i' || CAST(c_custkey AS VARCHAR) AS iid FROM customer WHERE c_custkey % 3 = 0", tables=False)
def keep_file(t: Tables) -> DataFrame:
    """A keep file, written and read, and the samples that it keeps."""
    samples = _people(t).select(F.col("k").alias("sample_idx"), F.concat(F.lit("i"), F.col("k").cast("string")).alias("iid"))
    path = files.scratch(t.spark, "keep")
    sinks.write_keep(samples.filter("sample_idx % 3 = 0"), path)
    return samples.join(text.read_keep(t.spark, path), "iid", "left_semi").select("sample_idx", "iid")


_VARIANTS = "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS variant_idx, 'c' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, 'rs' || CAST(p_partkey AS VARCHAR) AS variant_id, CAST(p_size AS VARCHAR) AS bp, p_partkey AS k FROM part"


def _sites(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return t.read("part").select(k.alias("k"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("chrom"), F.concat(F.lit("rs"), k.cast("string")).alias("id"), F.col("p_size").cast("string").alias("bp"))


@query(f"SELECT variant_idx, chrom, variant_id, '0' AS cm, bp, 'A' AS a1, 'G' AS a2 FROM ({_VARIANTS})", tables=False)
def read_bim(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "sites")
    line = F.concat_ws(" ", "chrom", "id", F.lit("0"), "bp", F.lit("A G"))
    _sites(t).repartitionByRange(3, "k").sortWithinPartitions("k").select(line.alias("value")).write.text(f"{path}.bim")
    return text.read_variants(t.spark, path, "bed")


def _pvar(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", "chrom", "id", "bp", F.lit("G"), F.when(F.col("k") % 2 == 0, "A,T").otherwise("C"))
    return text.read_pvar(t.spark, _written(t, _sites(t), "k", line, "pvar", "##made=here\n#CHROM\tID\tPOS\tREF\tALT"))


_PVAR = f"SELECT variant_idx, chrom, variant_id, '.' AS cm, bp, CASE WHEN k % 2 = 0 THEN 'A' ELSE 'C' END AS a1, 'G' AS a2 FROM ({_VARIANTS})"


@query(_PVAR, tables=False)
def read_pvar(t: Tables) -> DataFrame:
    """Columns by header; the first alternative allele counts."""
    return _pvar(t)


@query(f"SELECT CAST(r.k AS BIGINT) AS variant_idx, coalesce(variant_id, 'SNP_' || CAST(r.k AS VARCHAR)) AS variant_id, coalesce(chrom, 'NA') AS chrom, coalesce(cm, 'NA') AS cm, coalesce(bp, 'NA') AS bp, coalesce(a1, 'NA') AS a1, coalesce(a2, 'NA') AS a2 FROM range(0, 40000, 7) r(k) LEFT JOIN ({_PVAR}) ON variant_idx = r.k", tables=False)
def lookup_pvar(t: Tables) -> DataFrame:
    return screen.lookup(t.spark.range(0, 40000, 7).withColumnRenamed("id", "variant_idx"), _pvar(t))


@query("SELECT 'i' || CAST(c_custkey AS VARCHAR) AS iid, round(CAST(c_acctbal AS DOUBLE), 6) + 0.0 AS pheno FROM customer WHERE c_custkey % 9 NOT IN (0, 4) AND c_acctbal <> -9", tables=False)
def read_pheno(t: Tables) -> DataFrame:
    """A header, missing tokens and the missing number drop out."""
    rows = t.read("customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("y"))
    y = F.when(F.col("k") % 9 == 0, "NA").when(F.col("k") % 9 == 4, "-9.0").otherwise(F.col("y").cast("string"))
    path = _written(t, rows, "k", F.concat_ws("\t", F.lit("f"), F.concat(F.lit("i"), F.col("k").cast("string")), y), "pheno", "FID IID Y")
    out = align.parse_pheno(text.read_pheno(t.spark, path))
    return out.select("iid", r6("pheno").alias("pheno"))


@query("SELECT 'i' || CAST(iid AS VARCHAR) AS iid, x0, round(x1, 6) + 0.0 AS x1, x2 FROM covar WHERE iid % 11 <> 5")
def read_covar(t: Tables) -> DataFrame:
    """Rows with a missing covariate drop out."""
    x = F.transform("cov", lambda c: c.cast("string"))
    fields = F.concat_ws(" ", F.get(x, F.lit(0)), F.when(F.col("iid") % 11 == 5, "NA").otherwise(F.get(x, F.lit(1))), F.get(x, F.lit(2)))
    path = _written(t, t.covar(), "iid", F.concat_ws(" ", F.lit("f"), F.concat(F.lit("i"), F.col("iid").cast("string")), fields), "covar")
    out = align.parse_covar(text.read_covar(t.spark, path))
    return out.select("iid", F.col("cov")[0].alias("x0"), r6(F.col("cov")[1]).alias("x1"), F.col("cov")[2].alias("x2"))


@query("SELECT sample_idx, CAST(a - 1 AS INTEGER) AS ancestry, round(coalesce(q, 0), 6) + 0.0 AS q FROM samples CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS k(a) LEFT JOIN (SELECT sample_idx, ancestry AS a, q FROM adm) USING (sample_idx, a)")
def read_admixture(t: Tables) -> DataFrame:
    """Shares in a file whose people stand in another order; they meet samples by id."""
    wide = t.admixture().groupBy("sample_idx").pivot("ancestry", [1, 2, 3, 4, 5]).agg(F.first("q")).na.fill(0.0)
    rows = align.ordered(wide.join(t.samples(), "sample_idx").withColumn("back", -F.col("sample_idx")), "back")
    line = F.concat_ws(" ", *(F.format_string("%.9f", F.col(str(a))) for a in range(1, 6)))
    path = _written(t, rows, "number", line, "shares")
    fam = rows.select(F.col("number").alias("sample_idx"), "iid")
    out = text.read_admixture(t.spark, path, t.samples(), fam=fam)
    return out.select("sample_idx", F.col("ancestry").cast("int").alias("ancestry"), r6("q").alias("q"))


@query("SELECT variant_idx, CAST(sample_idx // 2 AS BIGINT) AS sample_idx, CAST(g AS TINYINT) AS dosage FROM cells WHERE (g IS NULL OR g <> 0) AND sample_idx % 2 = 1")
def read_bed(t: Tables) -> DataFrame:
    """A BED file that tasks wrote side by side; every other sample is kept where the file is read."""
    g = G(t)
    path = urlparse(files.scratch(t.spark, "bed"))
    bed.write_packed(geno.pack_2bit(g.geno, g.samples, g.variants), path.path, g.n, g.variants.count())
    return bed.read_bed(t.spark, path.path, g.n, keep=list(range(1, g.n, 2)), block=4)


_SPEC = """SELECT CAST(variant_idx % 3 AS INTEGER) AS component_idx, 'part ' || CAST(variant_idx % 3 AS VARCHAR) AS name, variant_idx, '{{"k": ' || CAST(variant_idx % 3 AS VARCHAR) || '}}' AS annotation FROM variants"""


def _spec(t: Tables) -> DataFrame:
    k = F.col("component_idx").cast("string")
    rows = t.components().groupBy("component_idx").agg(F.sort_array(F.collect_list("variant_idx")).alias("variant_indices"))
    return rows.select("component_idx", F.concat(F.lit("part "), k).alias("name"), "variant_indices", F.concat(F.lit('{"k": '), k, F.lit("}")).alias("annotation"), F.lit(None).cast("string").alias("provenance"))


def _claims(spec: DataFrame) -> DataFrame:
    return specs.spec_rows(spec).join(spec.select("component_idx", "name", "annotation"), "component_idx").select("component_idx", "name", "variant_idx", "annotation")


@query(_SPEC.format())
def spec_json(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "spec") + ".json"
    specs.write_spec(_spec(t), path)
    return _claims(specs.read_spec(t.spark, path))


@query(_SPEC.format())
def spec_npz(t: Tables) -> DataFrame:
    """An array file whose components are in the order of the numbers in their names."""
    rows = sorted(_spec(t).collect())  # three components
    out = io.BytesIO()
    arrays = {f"arr_{9 + r['component_idx']}": np.array(r["variant_indices"]) for r in reversed(rows)}
    np.savez(out, component_names=np.array([r["name"] for r in rows]), component_annotations_json=np.array([r["annotation"] for r in rows]), **arrays)
    path = files.scratch(t.spark, "spec") + ".npz"
    files.put(path, out.getvalue())
    return _claims(specs.read_spec(t.spark, path))


@query("SELECT block_idx, i, j, round(w, 6) + 0.0 AS w, CAST(5 AS DOUBLE) AS rank FROM bw")
def read_weights(t: Tables) -> DataFrame:
    """Weights of five blocks in four formats, listed in a text, with an effective rank beside the first."""
    blocks: dict[int, np.ndarray] = {}
    for r in t.block_w().collect():  # 25 brands: 125 weights
        blocks.setdefault(r["block_idx"], np.zeros((5, 5)))[r["i"] % 5, r["j"] % 5] = r["w"]
    base, paths = files.scratch(t.spark, "weights"), []
    for k in sorted(blocks):
        kind, out = ("npy", "npz", "csv", "txt")[k % 4], io.BytesIO()
        if kind == "npy":
            np.save(out, blocks[k])
        elif kind == "npz":
            np.savez(out, w=blocks[k])
        else:
            np.savetxt(out, blocks[k], fmt="%.17g", delimiter="," if kind == "csv" else " ")
        paths.append(f"{base}.{k}.{kind}")
        files.put(paths[-1], out.getvalue())
    files.put(f"{base}.0.json", json.dumps({"retained_rank": 5}).encode())
    paths = specs.weight_list(",".join(paths[:2]) + " # two\n" + "\n".join(paths[2:]))
    rank = specs.effective_rank(specs.sidecar(paths[0]), 5)
    rows = specs.weight_table(t.spark, [specs.load_weights(p) for p in paths], m=25)
    return rows.select("block_idx", "i", "j", r6("w").alias("w"), F.lit(rank).alias("rank"))


# --- writers -----------------------------------------------------------------


def _tsv(t: Tables, path: str, schema: str) -> DataFrame:
    return t.spark.read.option("sep", "\t").option("header", True).option("nanValue", "nan").schema(schema).csv(path)


@query(f"{_SCAN} SELECT g1.variant_idx, {_SCAN_OUT}, components.component_idx AS component_index, chr(97 + components.component_idx) AS component_name, chrom, variant_id FROM g1 JOIN components USING (variant_idx) JOIN variants USING (variant_idx)")
def write_gwas(t: Tables) -> DataFrame:
    """The association table, read back with the columns that its metadata lists."""
    g = G(t)
    names = t.spark.sql("SELECT * FROM VALUES (0, 'a'), (1, 'b'), (2, 'c') AS n(component_idx, component_name)")
    out = gwas.table(gwas.scan(g.geno, g.stats, _intercept(t), 1), g.cmap, names, g.variants)
    prefix = files.scratch(t.spark, "gwas")
    sinks.write_gwas(out, prefix, {"n": g.n})
    kinds = dict(out.dtypes)
    columns = json.loads(files.get(f"{prefix}.gwas_metadata.json"))["columns"]
    rows = _tsv(t, f"{prefix}.gwas.tsv", ", ".join(f"{c} {kinds[c]}" for c in columns)).withColumnRenamed("variant_index_global", "variant_idx").filter(~F.isnan("t"))
    return _scanned(rows).join(rows.select("variant_idx", "component_index", "component_name", "chrom", "variant_id"), "variant_idx")


def _effects(t: Tables) -> DataFrame:
    g = G(t)
    return g.cmap.join(t.coefficients(), "variant_idx").select("component_idx", "local_idx", "variant_idx", F.col("b").alias("beta"))


_EFFECTS = "SELECT CAST(component_idx AS INTEGER) AS component_index, CAST(row_number() OVER (PARTITION BY component_idx ORDER BY variant_idx) - 1 AS BIGINT) AS local, variant_idx, CAST(b AS DOUBLE) AS beta FROM components JOIN b USING (variant_idx)"
_NAMES = "SELECT * FROM VALUES (0, 'a'), (1, 'b'), (2, 'c') AS n(component_idx, component_name)"


def _effects_read(t: Tables, rows: DataFrame) -> DataFrame:
    """Effects written with their fixed and random parts and read back, the component from the folder's name."""
    prefix = files.scratch(t.spark, "effects")
    fixed = t.spark.createDataFrame([(0, "intercept", 0.5)], "covariate_index int, label string, beta double")
    random = t.samples().select(F.col("sample_idx").alias("sample_index"), "iid", F.lit(0.25).alias("component_000"))
    sinks.write_effects(prefix, fixed, random, random, rows, {"theta": np.array([0.5])})
    back = _tsv(t, f"{prefix}.snp_effects", ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "component_index") + ", component_index int")
    return back.select(*rows.columns)


@query(f"SELECT component_index, local AS component_local_snp_index, variant_idx AS source_snp_index, beta FROM ({_EFFECTS})")
def write_effects(t: Tables) -> DataFrame:
    return _effects_read(t, sinks.effect_rows(_effects(t)))


@query(f"SELECT component_index, chr(97 + component_index) AS component_name, local AS component_local_snp_index, 100 * component_index + local AS global_snp_index, beta FROM ({_EFFECTS})")
def write_effects_offset(t: Tables) -> DataFrame:
    offsets = t.spark.sql("SELECT * FROM VALUES (0, 0L), (1, 100L), (2, 200L) AS n(component_idx, first)")
    return _effects_read(t, sinks.effect_rows(_effects(t), t.spark.sql(_NAMES), offsets))


@query(f"SELECT component_index, local AS snp_index, beta FROM ({_EFFECTS})")
def write_effects_plain(t: Tables) -> DataFrame:
    return _effects_read(t, sinks.effect_rows(_effects(t).drop("variant_idx")))


@query("SELECT sample_idx AS sample_index, iid, round(100 + 20 * (0.25 + coalesce(zb, 0)), 5) + 0.0 AS y_pred FROM samples LEFT JOIN (SELECT sample_idx, sum(z * b) AS zb FROM z JOIN b USING (variant_idx) GROUP BY 1) USING (sample_idx)")
def write_prediction(t: Tables) -> DataFrame:
    g = G(t)
    parts = geno.zb(g.geno, g.stats, t.coefficients(), g.samples).select("sample_idx", F.lit(0.25).alias("fixed_effect"), F.col("value").alias("random_effect"))
    out = screen.predict(parts, 100.0, 20.0).join(g.samples, "sample_idx").withColumnRenamed("sample_idx", "sample_index")
    prefix = files.scratch(t.spark, "prediction")
    sinks.write_prediction(out, prefix, {"theta": np.array([0.5])})
    rows = _tsv(t, f"{prefix}.prediction.tsv", ", ".join(f"{c} {k}" for c, k in out.dtypes))
    return rows.select("sample_index", "iid", (F.round("y_pred", 5) + 0.0).alias("y_pred"))


@query("""SELECT i AS snp_index, CASE WHEN i % 2 = 0 THEN i + 1000 ELSE i END AS source_snp_index, CAST(CASE WHEN i < 25 THEN i % 3 ELSE -1 END AS INTEGER) AS grm, coalesce(chrom, 'NA') AS chr, coalesce(variant_id, 'SNP_' || CAST(i AS VARCHAR)) AS snp_id,
    coalesce(cm, 'NA') AS cm, coalesce(bp, 'NA') AS bp, coalesce(a1, 'NA') AS a1, coalesce(a2, 'NA') AS a2, i * 0.5 AS beta_lasso, CASE WHEN i % 4 = 0 THEN 0.0 ELSE i * 0.25 END AS beta_gls_reml
    FROM (SELECT CAST(k AS BIGINT) AS i FROM range(15, 30) r(k)) LEFT JOIN variants ON variant_idx = i""")
def write_selected(t: Tables) -> DataFrame:
    """Selected variants, some without metadata, component or refitted effect."""
    i = F.col("variant_idx")
    support = t.spark.range(15, 30).select(F.col("id").alias("variant_idx")).select("variant_idx", (i * 0.5).alias("beta_lasso"), F.when(i % 4 != 0, i * 0.25).alias("beta_gls_reml"))
    source = t.variants().select("variant_idx").union(t.spark.range(25, 30)).filter("variant_idx % 2 = 0").select("variant_idx", (i + 1000).alias("source_idx"))
    out = sinks.selected_rows(support, t.variants(), t.components(), source)
    prefix = files.scratch(t.spark, "selected")
    sinks.write_selected(out, prefix, {"h2": 0.5}, [])
    return _tsv(t, f"{prefix}.selected_snps.tsv", ", ".join(f"{c} {k}" for c, k in out.dtypes))


@query("SELECT CAST(component_idx AS INTEGER) AS round, 'fit' AS stage, CAST(m AS INTEGER) AS n_components, m_eff / 2.0 AS h2, CAST(NULL AS DOUBLE) AS z_min FROM cmeff")
def append_trace(t: Tables) -> DataFrame:
    """Rounds added one after another; what a round does not give is empty."""
    g = G(t)
    path = files.scratch(t.spark, "trace")
    for r in sorted(geno.component_stats(g.stats, g.cmap, g.n).collect(), key=lambda r: r["component_idx"]):  # three components
        sinks.append_trace([{"round": r["component_idx"], "stage": "fit", "n_components": r["m"], "h2": r["m_eff"] / 2}], path)
    return _tsv(t, path, ", ".join(f"{c} {k}" for c, k in sinks.TRACE)).select("round", "stage", "n_components", "h2", "z_min")


@query("SELECT variant_idx, CAST(group_idx AS INTEGER) AS group_idx, round(w, 6) + 0.0 AS w, CAST(k AS INTEGER) AS part, CAST(x AS DOUBLE) AS theta, CAST(h2 AS DOUBLE) AS h2 FROM soft, (VALUES (0, 0.5, 0.25), (1, 0.125, 0.25)) AS f(k, x, h2) WHERE k = group_idx")
def write_relaxation(t: Tables) -> DataFrame:
    """Group weights as a table, variance components as an array, statistics as a summary."""
    from types import SimpleNamespace

    prefix = files.scratch(t.spark, "relaxation")
    sinks.write_relaxation(prefix, t.soft(), SimpleNamespace(theta=np.array([0.5, 0.125]), loglik=-1.0, h2=0.25), [{"outer": 0}])
    theta = np.load(io.BytesIO(files.get(f"{prefix}.var_components.npy")))
    h2 = json.loads(files.get(f"{prefix}.meta.json"))["h2"]
    parts = F.broadcast(t.spark.createDataFrame([(k, k, float(x), h2) for k, x in enumerate(theta)], "group_idx int, part int, theta double, h2 double"))  # two groups
    return t.spark.read.parquet(f"{prefix}.theta").withColumn("w", r6("w")).join(parts, "group_idx")


@query("""SELECT CAST(a.col AS INTEGER) AS i, CAST(b.col AS INTEGER) AS j, round(any_value(g), 5) + 0.0 AS ai, any_value(theta) AS theta, any_value(s) AS grad, TRUE AS converged FROM (VALUES (0), (1)) a(col), (VALUES (0), (1)) b(col),
    (SELECT x.col AS p, y.col AS q, sum(x.score * y.score) AS g FROM zv x JOIN zv y USING (variant_idx) GROUP BY 1, 2), theta, (SELECT col, sum(v) AS s FROM v GROUP BY 1) sv WHERE p = a.col AND q = b.col AND component_idx = a.col AND sv.col = a.col GROUP BY 1, 2""")
def write_fit(t: Tables) -> DataFrame:
    """The information matrix, components and gradient of a fit, as arrays, with their statistics; all three are taken from the tables."""
    from types import SimpleNamespace

    g, prefix = G(t), files.scratch(t.spark, "fit")
    score = geno.xtv(g.geno, g.stats, t.v()).groupBy("variant_idx").pivot("col", [0, 1]).agg(F.first("score"))
    sums = score.agg(*(F.sum(F.col(str(i)) * F.col(str(j))).alias(f"{i}{j}") for i in (0, 1) for j in (0, 1))).first()
    own = {r["component_idx"]: r["theta"] for r in t.theta().collect()}
    grad = {r["col"]: r["s"] for r in t.v().groupBy("col").agg(F.sum("v").alias("s")).collect()}
    fit = SimpleNamespace(theta=np.array([own[0], own[1]]), ai=np.array([[sums["00"], sums["01"]], [sums["10"], sums["11"]]]), score=np.array([grad[0], grad[1]]), loglik=-2.0, h2=0.5, converged=True, history=[1])
    sinks.write_fit(prefix, fit)
    ai, theta, grad = (np.load(io.BytesIO(files.get(f"{prefix}.{n}.npy"))) for n in ("ai", "theta", "grad"))
    done = json.loads(files.get(f"{prefix}.ai_stats.json"))["converged"]
    return t.spark.createDataFrame([(i, j, round(float(ai[i, j]), 5) + 0.0, float(theta[i]), float(grad[i]), done) for i in range(2) for j in range(2)], "i int, j int, ai double, theta double, grad double, converged boolean")


# --- rules that had no query ---------------------------------------------------


@query("""SELECT variant_idx FROM components WHERE component_idx = 0 UNION
    (SELECT variant_idx FROM (SELECT variant_idx, abs(score) AS s FROM zv WHERE col = 0 AND variant_idx % 3 <> 0 AND abs(score) > 5 + greatest(1e-4, 1e-4 * 5)) ORDER BY s DESC, variant_idx LIMIT 4)""")
def add_violators(t: Tables) -> DataFrame:
    """Candidates and the worst violators of the optimality conditions, each once."""
    g = G(t)
    scores = geno.xtv(g.geno, g.stats, t.v(1)).select("variant_idx", "score")
    candidates = t.components().filter("component_idx = 0").select("variant_idx")
    return screen.add_violators(candidates, screen.kkt_violators(scores, candidates, 5.0), 4)


@query("SELECT CAST(CASE WHEN component_idx = 1 THEN 0 ELSE 1 END AS BIGINT) AS target, count(*) AS m, count(DISTINCT component_idx) AS n_sources, min(z) AS min_z, max(z) AS max_z FROM components JOIN (VALUES (0, 0.5), (1, 4.0), (2, 1.0)) AS s(component_idx, z) USING (component_idx) GROUP BY 1")
def merged_summary(t: Tables) -> DataFrame:
    """What each component that merging leaves was made of."""
    parts = t.spark.sql("SELECT * FROM VALUES (0, 0.25D, 0.5D), (1, 2.0D, 0.5D), (2, 0.5D, 0.5D) AS s(component_idx, theta, se)")
    return screen.merged_spec(t.components(), screen.merge_weak(parts)).select("target", "m", "n_sources", "min_z", "max_z")
