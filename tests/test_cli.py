"""Each analysis from files to files."""

import json

import numpy as np
import pytest

from lociform import cli
from lociform.sources.bed import write_bed


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    r = np.random.default_rng(1)
    g = r.binomial(2, 0.3, (18, 60)).astype(np.uint8)
    g[r.random(g.shape) < 0.02] = 3
    write_bed(str(d / "x.bed"), g)
    (d / "x.fam").write_text("".join(f"f i{k} 0 0 0 -9\n" for k in range(60)))
    (d / "x.bim").write_text("".join(f"1 rs{k} 0 {k * 100} A G\n" for k in range(18)))
    clean = np.where(g == 3, 0, g)
    y = clean[2] * 1.5 + r.normal(size=60)
    (d / "p").write_text("".join(f"f i{k} {y[k] if k % 10 else -9}\n" for k in range(60)))
    (d / "c").write_text("".join(f"f i{k} {r.normal()} 1\n" for k in range(60)))
    return d


def run(spark, d, analysis, *more):
    a = cli.parser().parse_args([analysis, "--genotypes", f"{d}/x", "--phenotypes", f"{d}/p", "--covariates", f"{d}/c", "--out", f"{d}/{analysis}", *more])
    cli.run(spark, a)
    return f"{d}/{analysis}"


def test_gwas(spark, files):
    out = run(spark, files, "gwas", "--component-sizes", "10,8")
    rows = spark.read.option("sep", "\t").option("header", True).csv(out + ".gwas.tsv").collect()
    assert len(rows) == 18 and min(rows, key=lambda r: float(r.p)).variant_id == "rs2" and {r.component_index for r in rows} == {"0", "1"}
    assert spark.read.csv(out + ".dropped").count() == 6


def test_reml_with_effects_and_prediction(spark, files):
    out = run(spark, files, "reml", "--effects", "--predict-genotypes", f"{files}/x", "--predict-covariates", f"{files}/c")
    assert len(np.load(out + ".theta.npy")) == 2
    got = spark.read.option("sep", "\t").option("header", True).csv(out + ".prediction.tsv")
    assert got.count() == 60 and "y_pred" in got.columns


def test_merge_sparse_relax(spark, files):
    out = run(spark, files, "merge", "--component-sizes", "6,6,6", "--weak-below", "100")
    assert len(json.load(open(out + ".spec.json"))["components"]) == 1
    out = run(spark, files, "sparse", "--rounds", "1", "--screen", "8", "--candidates", "8", "--active", "8")
    assert "h2" in json.load(open(out + ".summary.json"))
    out = run(spark, files, "relax", "--rounds", "1")
    assert spark.read.parquet(out + ".theta").count() == 36


def test_kernels_from_files(spark, files):
    r = np.random.default_rng(5)
    for k, width in enumerate((10, 8)):
        a = r.normal(size=(width, width))
        np.save(files / f"w{k}.npy", np.eye(width) + 0.05 * (a + a.T))
        (files / f"w{k}.json").write_text(json.dumps({"effective_rank": width / 2}))
    np.savetxt(files / "ones.txt", np.eye(18))
    blocks = f"{files}/w0.npy,{files}/w1.npy"
    out = run(spark, files, "reml", "--weights", blocks, "--effects", "--predict-genotypes", f"{files}/x", "--predict-covariates", f"{files}/c")
    assert len(np.load(out + ".theta.npy")) == 2
    predicted = spark.read.option("sep", "\t").option("header", True).csv(out + ".prediction.tsv")
    assert predicted.count() == 60 and predicted.selectExpr("stddev(cast(random_effect as double))").first()[0] > 0
    assert len(np.load(run(spark, files, "reml", "--weights", blocks, "--weight-scale", "rank") + ".theta.npy")) == 2
    assert len(np.load(run(spark, files, "reml", "--weights", blocks, "--weights", f"{files}/ones.txt") + ".theta.npy")) == 3
    q = r.dirichlet((1, 1), 60)
    np.savetxt(files / "q.2.Q", q)
    out = run(spark, files, "reml", "--ancestry", f"{files}/q.2.Q")
    summary = json.load(open(out + ".ancestry_summary.json"))
    assert len(np.load(out + ".theta.npy")) == 4 and 0 <= summary["weighted_h2"] <= 1
    more = ("--more-genotypes", f"{files}/x", "--more-genotypes", f"{files}/x", "--component-sizes", "10,8", "--effects")
    assert len(np.load(run(spark, files, "reml", *more) + ".theta.npy")) == 5
    with pytest.raises(ValueError):
        run(spark, files, "reml", "--ancestry", f"{files}/q.2.Q", "--weights", blocks)


@pytest.mark.parametrize(
    "words",
    [
        "gwas --components s --component-sizes 1",
        "reml --weights w --ancestry q",
        "reml --weights w --component-sizes 1",
        "reml --ancestry q --more-genotypes g",
        "gwas --effects",
        "merge --weights w",
        "sparse --ancestry q",
        "reml --weight-scale rank",
        "reml --predict-genotypes p",
        "reml --effects --predict-covariates c",
        "reml --effects --predict-genotypes p --covariates c",
        "reml --effects --predict-genotypes p --ancestry q",
        "sparse --active 300",
        "reml --rounds 3",
        "gwas --method exact",
        "merge --groups 3",
        "relax --effective-samples 5",
        "reml --replicates 3",
        "sparse --method stochastic --replicates 3",
        "relax --start-weights w --groups 3",
    ],
)
def test_options_that_exclude_each_other(words):
    with pytest.raises(ValueError):
        cli.check(cli.parser().parse_args([*words.split(), "--genotypes", "x", "--phenotypes", "p", "--out", "o"]))


def test_options_that_go_together():
    for words in ("reml --effects --predict-genotypes p", "sparse --rounds 2 --still-rounds 2", "relax --start-weights w", "reml --method stochastic --replicates 4", "merge --effective-samples 9", "reml --weights w --weight-scale rank --effects"):
        a = cli.parser().parse_args([*words.split(), "--genotypes", "x", "--phenotypes", "p", "--out", "o", "--tolerances", "0.1,0.01"])
        cli.check(a)
        assert cli.options(a).tolerances == (0.1, 0.01)


def test_replicates_and_start_weights(spark, files):
    out = run(spark, files, "reml", "--method", "stochastic", "--replicates", "2", "--probes", "8", "--basis", "18", "--tolerances", "0.01", "--iterations", "3")
    found = json.load(open(out + ".replicates.json"))
    assert found["count"] == 2 and len(found["mean"]) == 2 and min(found["monte_carlo_se"]) >= 0
    path = f"{files}/start"
    spark.range(18).selectExpr("id as variant_idx", "explode(array(0, 1, 2)) as group_idx").selectExpr("variant_idx", "cast(group_idx as int) group_idx", "1.0D / 3 + (variant_idx % 3 = group_idx) * 0.0D w".replace("(variant_idx % 3 = group_idx)", "cast(variant_idx % 3 = group_idx as double)")).write.parquet(path)
    out = run(spark, files, "relax", "--rounds", "1", "--start-weights", path)
    assert spark.read.parquet(out + ".theta").count() == 54


def test_components_are_checked(spark, files):
    for text, message in (("[[0, 18]]", "names variant 18"), ("[[0, 0]]", "claimed 2"), ("[[0, 1], [1]]", "claimed 2"), ("[[-1]]", "names variant -1")):
        path = files / "bad.json"
        path.write_text(json.dumps([{"variant_indices": own} for own in json.loads(text)]))
        with pytest.raises(ValueError, match=message):
            run(spark, files, "gwas", "--components", str(path))
