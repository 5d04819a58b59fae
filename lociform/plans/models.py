"""The five analyses: variance components with effects and prediction, sparse selection, association, merging, soft grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import independent_columns, spd_solve
from ..operators import align, screen
from ..operators import geno as G
from ..sources import bed
from .kernels import DenseKernel, Kernel, SoftKernel, SparkKernel, blocks, component_blocks, standardised
from .krylov import rademacher
from .lasso import LassoOptions, profile, select
from .reml import Fit, Options, Problem, Whole, merge_z
from . import span
from .span import VARIANTS, Span, SpanKernel


@dataclass
class Data:
    """Aligned inputs: genotypes of the samples that stay, numbered from 0; response and fixed effects as arrays of n rows."""

    spark: SparkSession
    geno: DataFrame
    variants: DataFrame
    samples: DataFrame
    y: np.ndarray | None
    x: np.ndarray | None
    components: DataFrame  # component_idx, variant_idx
    raw: DataFrame | None = None  # packed blocks of a BED file over the same samples, ``WIDTH`` variants each
    rows: DataFrame | None = None  # sample_idx, y, x where there are too many for arrays: solvers then take a span

    WIDTH = 256

    def __post_init__(self):
        self.n = len(self.y) if self.rows is None else self.rows.count()
        self.geno = self.geno.persist()
        rows = G.variant_stats(self.geno, self.variants, self.n) if self.raw is None else bed.variant_rows(self.raw)
        self.stats = rows.persist()
        self.cmap = G.component_map(self.components).persist()

    def close(self) -> None:
        """Gives back what is kept."""
        for table in (self.geno, self.stats, self.cmap):
            table.unpersist()

    @classmethod
    def of(cls, geno: DataFrame, variants: DataFrame, aligned: DataFrame, components: DataFrame) -> Data:
        """From ``aligned(sample_idx, iid, y, x)``, whose positions may have gaps.

        Up to ``span.BEYOND`` rows, or with more variants than a span takes, n rows go to the driver; others stay a table.
        """
        if aligned.count() > span.BEYOND and variants.limit(VARIANTS + 1).count() <= VARIANTS:
            placed = align.ordered(aligned.select(F.col("sample_idx").alias("old"), "iid", "y", "x"), "old").withColumnRenamed("number", "sample_idx").persist()
            own = geno.join(placed.select(F.col("old").alias("sample_idx"), F.col("sample_idx").alias("new")), "sample_idx").select(F.col("new").alias("sample_idx"), "variant_idx", "dosage")
            return cls(aligned.sparkSession, own, variants, placed.select("sample_idx", "iid"), None, None, components, rows=placed.select("sample_idx", "y", "x"))
        rows = aligned.select("sample_idx", "iid", "y", "x").orderBy("sample_idx").collect()
        spark = aligned.sparkSession
        place = spark.createDataFrame([(r["sample_idx"], k, r["iid"]) for k, r in enumerate(rows)], aligned.select(F.col("sample_idx").alias("old"), F.col("sample_idx").alias("sample_idx"), "iid").schema)
        own = geno.join(place.select(F.col("old").alias("sample_idx"), F.col("sample_idx").alias("new")), "sample_idx").select(F.col("new").alias("sample_idx"), "variant_idx", "dosage")
        return cls(spark, own, variants, place.select("sample_idx", "iid"), np.array([r["y"] for r in rows], float), np.array([r["x"] for r in rows], float), components)

    @classmethod
    def of_bed(cls, spark: SparkSession, path: str, people: DataFrame, variants: DataFrame, aligned: DataFrame, components: DataFrame) -> Data:
        """From a BED file of ``people(sample_idx, iid)``: the reader keeps the samples of ``aligned`` and decodes no others.

        Statistics and kernels come from the file's blocks; cells are read only
        where an analysis asks for them.
        """
        rows = aligned.select("sample_idx", "iid", "y", "x").orderBy("sample_idx").collect()
        kept = spark.createDataFrame([(r["iid"], k) for k, r in enumerate(rows)], T.StructType([aligned.schema["iid"], T.StructField("rank", T.LongType())]))
        align.subsequence(people, kept)
        n = people.count()
        keep = np.zeros(n, bool)
        keep[[r["sample_idx"] for r in rows]] = True
        own = kept.select(F.col("rank").alias("sample_idx"), "iid")
        y, x = np.array([r["y"] for r in rows], float), np.array([r["x"] for r in rows], float)
        return cls(spark, bed.read_bed(spark, path, n, keep), variants, own, y, x, components, bed.read_blocks(spark, path, n, keep, cls.WIDTH))

    def kernel(self, width: int = 256) -> SparkKernel:
        if self.raw is not None:
            return SparkKernel.of_blocks(self.raw, self.n, self.cmap, self.WIDTH)
        return SparkKernel.build(self.geno, self.stats, self.cmap, self.n, width)

    def problem(self, options: Options | None = None, kernel=None, more: tuple[tuple[int, int], ...] = ()) -> Problem:
        """A problem on coordinates of a span, whose kernel ``kernel(span)`` makes; ``more`` random signs lie in it too."""
        o = options or Options()
        fit = self.rows.agg(F.avg("y").alias("mean"), (F.stddev_pop("y") + 1e-6).alias("scale"), F.max(F.size("x")).alias("width")).first()
        vectors = self.rows.select("sample_idx", F.concat("x", F.array((F.col("y") - fit["mean"]) / fit["scale"])).alias("v"))
        random = ((o.seed, o.probes), (o.seed + 1, o.slq_probes)) if o.method == "stochastic" else ()
        own = Span(self.geno, self.stats, vectors, fit["width"] + 1, self.n, random + more)
        whole = Whole(self.n, fit["mean"], fit["scale"], *own.signs[: len(random)])
        return Problem(own.vectors[:, -1], own.vectors[:, :-1], kernel(own) if kernel else SpanKernel.build(own, self.stats, self.cmap), None, o, whole)

    def vector(self, v: np.ndarray) -> DataFrame:
        """Columns of an n x c array as ``sample_idx``, ``col``, ``v``."""
        n, c = v.shape
        import pandas as pd

        return self.spark.createDataFrame(pd.DataFrame({"sample_idx": np.repeat(np.arange(n), c), "col": np.tile(np.arange(c, dtype=np.int32), n), "v": v.ravel()}))

    def columns(self, indices: list[int]) -> np.ndarray:
        """Standardised columns n x k in the order asked for; repeats are kept.

        From a file only the blocks that hold them are read and decoded.
        """
        out = np.zeros((self.n, len(indices)))
        place: dict[int, list[int]] = {}
        for k, i in enumerate(indices):
            place.setdefault(int(i), []).append(k)
        if self.raw is not None:
            asked, n = sorted(place), self.n
            blocks = self.raw.filter(F.col("block_id").isin(sorted({i // self.WIDTH for i in asked}))).select("variants", "mean", "inv_sd", "packed")

            def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        at = np.flatnonzero(np.isin(row["variants"], asked))
                        z = standardised(row["packed"], np.array(row["mean"]), np.array(row["inv_sd"]), n)[at]
                        yield pa.record_batch([pa.array(np.array(row["variants"], np.int64)[at]), pa.array([x.tobytes() for x in z], pa.binary())], names=["variant_idx", "z"])

            for r in blocks.mapInArrow(pick, "variant_idx long, z binary").toArrow().to_pylist() if asked else ():
                out[:, place[r["variant_idx"]]] = np.frombuffer(r["z"], float)[:, None]
            return out
        wanted = self.spark.createDataFrame([(k, int(i)) for k, i in enumerate(indices)], "position int, variant_idx long")
        rows = G.columns_of(self.geno, self.stats, wanted, self.n).select("sample_idx", "position", "z").toArrow()
        out[rows["sample_idx"].to_numpy(), rows["position"].to_numpy()] = rows["z"].to_numpy()
        return out


# --- variance components -----------------------------------------------------


@dataclass
class Effects:
    fixed: np.ndarray
    alpha: np.ndarray  # P y
    random: np.ndarray  # components x n
    snps: DataFrame  # component_idx, local_idx, variant_idx, beta


class Model:
    """Fit of variance components, then effects and predictions."""

    def __init__(self, data: Data, options: Options | None = None, kernel: Kernel | None = None, residual: np.ndarray | None = None):
        self.data = data
        if data.rows is not None:
            self.problem = data.problem(options)
            self.source = self.problem.source
            return
        self.source = kernel or data.kernel()
        self.problem = Problem(data.y, data.x, self.source, residual, options)

    def fit(self) -> Fit:
        self.result = self.problem.fit()
        return self.result

    def rows(self, v: np.ndarray) -> DataFrame:
        """``sample_idx``, ``col``, ``v`` of columns as the problem holds them: arrays of n rows, or coordinates."""
        return self.source.span.long(v) if self.data.rows is not None else self.data.vector(v)

    def effects(self) -> Effects:
        """Fixed effects, P y, each component's random effect, and effects of variants, which stay a table.

        P y and random effects are what ``rows`` takes.
        """
        theta, p = self.result.theta, self.problem
        alpha, beta = p.projected_response(theta)
        random = theta[: p.g, None] * p.kernel.stacked(alpha[:, None])[:, :, 0]
        return Effects(beta, alpha, random, self.source.effects(alpha, theta))

    def predict(self, effects: Effects, geno: DataFrame, samples: DataFrame, x: np.ndarray | None = None) -> DataFrame:
        """Predictions for other samples under the training standardisation, which must know every variant with an effect.

        Fixed effects come from the column ``x`` of ``samples``, or from an array of their rows in order.
        """
        check_geometry(effects.snps, self.data.stats, self.source.cmap() if isinstance(self.source, SparkKernel) else self.data.cmap)
        b = effects.snps.select("variant_idx", F.lit(0).alias("col"), F.col("beta").alias("b"))
        random = G.zb(geno, self.data.stats, b, samples).select("sample_idx", F.col("value").alias("random_effect"))
        if x is None:
            fixed = samples.select("sample_idx", sum((F.col("x")[k] * float(v) for k, v in enumerate(effects.fixed)), F.lit(0.0)).alias("fixed_effect"))
        else:
            fixed = self.data.spark.createDataFrame(pa.table({"sample_idx": np.arange(len(x)), "fixed_effect": x @ effects.fixed}))
        return screen.predict(random.join(fixed, "sample_idx"), self.result.y_mean, self.result.y_scale)


def check_geometry(snps: DataFrame, stats: DataFrame, cmap: DataFrame) -> None:
    """Raises where effects and training differ: every valid variant of every component has one effect, and no other has any."""
    known = cmap.join(stats.filter("inv_sd > 0").select("variant_idx"), "variant_idx", "left_semi").select("component_idx", "variant_idx", "local_idx")
    own = snps.groupBy("component_idx", "variant_idx").agg(F.count("*").alias("n"), F.min("local_idx").alias("at"), F.max(F.col("beta").isNull() | F.isnan("beta")).alias("odd"))
    both = known.join(own, ["component_idx", "variant_idx"], "full")
    wrong = both.filter(F.col("local_idx").isNull() | F.col("n").isNull() | (F.col("n") > 1) | (F.col("at") != F.col("local_idx")) | F.col("odd")).orderBy("component_idx", "variant_idx").limit(1).collect()
    if wrong:
        raise ValueError(f"effects and training differ at variant {wrong[0]['variant_idx']} of component {wrong[0]['component_idx']}")


# --- merging of weak components ----------------------------------------------


@dataclass
class Merged:
    first: Fit
    z: np.ndarray
    se: np.ndarray
    components: DataFrame
    second: Fit | None


def merge(data: Data, options: Options | None = None, cutoff: float = screen.WEAK_Z, n_eff: float | None = None) -> Merged:
    """Fits, merges components whose z-score is low into one, and fits again if that left fewer."""
    first = Model(data, options).fit()
    se, z = merge_z(first, n_eff or data.n)
    rows = data.spark.createDataFrame([(k, float(first.theta[k]), float(se[k])) for k in range(len(z))], "component_idx int, theta double, se double")
    targets = screen.merge_weak(rows, cutoff)
    merged = data.cmap.join(F.broadcast(targets), "component_idx").select(F.col("target").cast("int").alias("component_idx"), "variant_idx")
    if G.same_coverage(data.cmap, merged).limit(1).count():
        raise RuntimeError("merging changed the variants covered")
    fewer = targets.select("target").distinct().count() < len(z)
    second = Model(replace(data, components=merged), options).fit() if fewer else None
    return Merged(first, z, se, merged, second)


# --- sparse selection --------------------------------------------------------


@dataclass
class SparseOptions:
    outer: int = 8
    screen: int = 1500
    candidates: int = 200
    active: int = 100
    kkt_tol: float = 1e-4
    kkt_add: int = 200
    kkt_rounds: int = 25
    theta_tol: float = 1e-2
    still_rounds: int = 1  # rounds in which support and components stand still before the search ends
    pcg_tol: float = 2e-3
    lasso: LassoOptions = field(default_factory=LassoOptions)


@dataclass
class Sparse:
    support: list[int]
    beta: np.ndarray
    fit: Fit
    h2: float
    h2_gls: float
    history: list[dict]
    gls: np.ndarray  # effects of the support by generalised least squares


def _chive(problem: Problem, theta: np.ndarray, z: np.ndarray, beta: np.ndarray) -> float:
    """Share of variance of the chosen columns (``screen.chive``, not below 0) and the genetic components together."""
    fitted = z @ beta
    fixed = max(float(fitted @ fitted + 2 * fitted @ (problem.y - fitted)) / problem.n, 0.0) if z.shape[1] else 0.0
    part = theta * problem.atoms
    genetic = part[: problem.g].sum() + fixed
    return float(genetic / (genetic + part[problem.g :].sum()))


def generalised(design: np.ndarray, solved: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Effects by generalised least squares from a design and its solves with the covariance."""
    return spd_solve(design.T @ solved, solved.T @ y)


def sparse(data: Data, options: Options | None = None, so: SparseOptions | None = None) -> Sparse:
    """Alternates screening, LASSO under the current covariance with a global optimality certificate, and refits.

    The response is standardised once, so all steps share the scale of theta.
    """
    so = so or SparseOptions()
    if data.rows is None:
        problem, columns = Problem(data.y, data.x, data.kernel(), None, options), data.columns
    else:
        problem = data.problem(options)
        z_all = problem.source.span.z
        place = {int(v): k for k, v in enumerate(problem.source.span.ids)}
        columns = lambda chosen: np.stack([z_all[:, place[i]] for i in chosen], 1) if chosen else np.zeros((len(problem.y), 0))
    theta, y, x = problem.start_theta(), problem.y, problem.x
    support: list[int] = []
    history: list[dict] = []
    fit: Fit | None = None
    beta = np.zeros(0)
    settled, still = False, 0
    m = data.variants.count()

    def solve(b: np.ndarray) -> np.ndarray:
        return problem.solve(theta, b, so.pcg_tol)

    def scores(u: np.ndarray) -> DataFrame:
        if data.rows is not None:
            return problem.source.scores(u[:, None]).select("variant_idx", "score")
        return G.xtv(data.geno, data.stats, data.vector(u[:, None])).select("variant_idx", "score")

    for outer in range(so.outer):
        h = solve(np.concatenate([x, y[:, None]], 1))
        hx, hy = h[:, :-1], h[:, -1]
        u = hy - hx @ spd_solve(x.T @ hx, x.T @ hy)
        top = screen.top_k(scores(u), so.screen)
        previous = data.spark.createDataFrame([(int(i),) for i in support], "variant_idx long")
        chosen = [r[0] for r in screen.assemble(previous, top, so.candidates).collect()]
        for _ in range(so.kkt_rounds):
            z = columns(chosen)
            gram, q, rss = profile(z, solve(z), x, hx, y, hy, so.lasso.ridge)
            got = select(gram, q, rss, data.n, len(chosen), so.lasso)
            active = np.flatnonzero(got.beta)
            if len(active) > so.active:
                raise RuntimeError(f"{len(active)} variants are active; the most allowed is {so.active}")
            r = y - z @ got.beta
            hr = solve(r[:, None])[:, 0]
            ur = hr - hx @ spd_solve(x.T @ hx, x.T @ hr)
            bad = screen.kkt_violators(scores(ur), data.spark.createDataFrame([(int(i),) for i in chosen], "variant_idx long"), got.penalty, so.kkt_tol, so.kkt_tol)
            more = [row["variant_idx"] for row in screen.top_k(bad, so.kkt_add).collect()]
            if not more:
                break
            chosen = sorted({*chosen, *more})
        else:
            raise RuntimeError("no certificate of optimality")
        new = [chosen[k] for k in active]
        beta = got.beta[active]
        same = fit is not None and new == support
        if same and settled:  # a refit would give the components that are there
            still += 1
            history.append({"outer": outer, "support": new, "penalty": got.penalty, "moved": 0.0, "m": m, "refit": False})
            if still >= so.still_rounds:
                break
            continue
        zs = z[:, active]
        keep = independent_columns(x, zs)
        refit = Problem(data.y if data.rows is None else y, np.concatenate([x, zs[:, keep]], 1), problem.kernel, None, options, problem.whole).fit()
        moved = float((np.abs(refit.theta - theta) / np.maximum(np.abs(theta), 1e-8)).max())
        history.append({"outer": outer, "support": new, "penalty": got.penalty, "moved": moved, "m": m, "refit": True})
        theta, support, fit, settled = refit.theta, new, refit, moved < so.theta_tol
        still = int(same and settled)
        if same and (still >= so.still_rounds or not new):
            break
    zs = columns(support) if support else np.zeros((len(y), 0))
    design = np.concatenate([x, zs], 1)
    gls = generalised(design, solve(design), y)[x.shape[1] :]
    return Sparse(support, beta, fit, _chive(problem, theta, zs, beta), _chive(problem, theta, zs, gls), history, gls)


# --- soft grouping -----------------------------------------------------------


@dataclass
class Relaxed:
    theta: np.ndarray  # variants x groups
    variants: list[int]
    fit: Fit
    history: list[dict]


#: Standardised values (8 bytes each) that soft grouping holds on the driver, at most.
DENSE = 1 << 26


def fits_dense(data: Data, options: Options | None = None) -> bool:
    """Whether ``relax`` takes the data."""
    return data.rows is not None or data.n <= (options or Options()).exact_up_to and data.n * data.variants.count() <= DENSE


def relax(data: Data, start: np.ndarray, rate: float = 1e-3, outers: int = 5, trials: int = 3, probes: int = 32, options: Options | None = None) -> Relaxed:
    """Learns each variant's weights over groups by exponentiated gradients on the likelihood.

    Exact and dense on the driver: for sample counts up to ``exact_up_to`` and
    ``DENSE`` standardised values.
    """
    if not fits_dense(data, options):
        raise ValueError("too many samples or variants for dense matrices; use relax_streamed")
    if data.rows is None:
        ids = [r[0] for r in data.stats.filter("inv_sd > 0").select("variant_idx").orderBy("variant_idx").collect()]
        z, y, x, whole = data.columns(ids), data.y, data.x, None
    else:  # on coordinates of a span, where traces need no probes
        base = data.problem(replace(options or Options(), method="exact"))
        z, y, x, whole = base.source.span.z, base.y, base.x, base.whole
        ids = base.source.span.ids.tolist()
    theta = start / start.sum(1, keepdims=True)

    def fit_at(w: np.ndarray) -> tuple[Fit, Problem]:
        total = w.sum(0)
        if (total <= 0).any():
            raise ValueError("a group has no weight")
        p = Problem(y, x, DenseKernel([(z * w[:, k]) @ z.T / total[k] for k in range(w.shape[1])]), None, options, whole)
        return p.fit(), p

    fit, problem = fit_at(theta)
    history = [{"outer": 0, "loglik": fit.loglik}]
    signs = rademacher(data.n, probes, 0) if whole is None else None
    for outer in range(1, outers + 1):
        h = np.einsum("g,gij->ij", fit.theta[:-1], problem.kernel.k) + fit.theta[-1] * np.eye(len(z))
        hi = np.linalg.inv(h)
        hx = hi @ x
        p = hi - hx @ np.linalg.solve(x.T @ hx, hx.T)
        py = p @ problem.y
        zpz = (z * (p @ z)).sum(0) if signs is None else ((z.T @ signs) * (z.T @ (p @ signs))).mean(1)
        quad = np.array([py @ k @ py for k in problem.kernel.k])
        trace = np.array([np.sum(p * k) for k in problem.kernel.k])
        grad = fit.theta[:-1] * (((z.T @ py) ** 2 - zpz)[:, None] - (quad - trace)) / (2 * theta.sum(0)) / data.n
        step, taken = rate, False
        for _ in range(trials):
            raw = theta * np.exp(step * (grad - grad.max(1, keepdims=True)))
            new, problem_new = fit_at(raw / raw.sum(1, keepdims=True))
            if new.loglik >= fit.loglik:
                theta, fit, problem, taken = raw / raw.sum(1, keepdims=True), new, problem_new, True
                break
            step /= 2
        history.append({"outer": outer, "loglik": fit.loglik, "taken": taken, "step": step})
        if not taken:
            break
    return Relaxed(theta, ids, fit, history)


@dataclass
class RelaxedTable:
    weights: DataFrame  # variant_idx, group_idx, w
    fit: Fit
    history: list[dict]


def _kept(df: DataFrame) -> DataFrame:
    """Cuts lineage where the cluster names a folder for it, and keeps the rows otherwise."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def weight_gradient(weights: DataFrame, theta: np.ndarray, problem: Problem, signs: np.ndarray) -> DataFrame:
    """``grad`` (n times the likelihood's) of each variant's weight in each group, with traces by the given probes."""
    kernel, x, k, probes = problem.kernel, problem.x, problem.x.shape[1], signs.shape[1]
    right = np.concatenate([problem.y[:, None], signs], 1)
    h = problem.solve(theta, np.concatenate([x, right], 1), problem.o.tolerances[-1])
    p = h[:, k:] - h[:, :k] @ spd_solve(x.T @ h[:, :k], h[:, :k].T @ right)
    products = kernel.stacked(p)
    quad = np.einsum("n,gn->g", p[:, 0], products[:, :, 0])
    trace = np.einsum("nr,gnr->g", signs, products[:, :, 1:]) / probes
    scores = kernel.scores(np.concatenate([p, signs], 1))
    projected = F.col("col") <= probes
    pair = F.when(projected, F.col("col")).otherwise(F.col("col") - probes)  # a probe and its projection meet
    by = scores.groupBy("variant_idx", pair.alias("pair")).agg(F.max(F.when(projected, F.col("score"))).alias("a"), F.max(F.when(~projected, F.col("score"))).alias("b"))
    by = by.groupBy("variant_idx").agg(F.max(F.when(F.col("pair") == 0, F.col("a"))).alias("zpy"), (F.sum(F.when(F.col("pair") > 0, F.col("a") * F.col("b"))) / probes).alias("zpz"))
    spark = weights.sparkSession
    facts = spark.createDataFrame([(g, float(theta[g]), float(quad[g]), float(trace[g])) for g in range(kernel.size)], "group_idx int, tau double, ypkpy double, trpk double")
    parts = weights.join(by, "variant_idx").join(F.broadcast(facts), "group_idx")  # a row for each group
    return screen.soft_gradient(parts.join(F.broadcast(screen.group_totals(weights)), "group_idx"))


def relax_streamed(data: Data, start: DataFrame, groups: int, rate: float = 1e-3, outers: int = 5, trials: int = 3, probes: int = 32, options: Options | None = None) -> RelaxedTable:
    """``relax`` for any number of samples: products over packed blocks, weights ``start(variant_idx, group_idx, w)`` and
    gradients stay tables, and traces are taken by the probes that every outer round shares."""
    o = replace(options or Options(), method="stochastic")
    valid = data.stats.filter("inv_sd > 0").select("variant_idx")
    own = Window.partitionBy("variant_idx")
    weights = _kept(start.join(valid, "variant_idx").select("variant_idx", "group_idx", (F.col("w") / F.sum("w").over(own)).alias("w")))
    if data.raw is not None:
        table = component_blocks(data.raw, None, data.WIDTH).persist()
    else:
        table = blocks(data.geno, data.stats, G.component_map(data.stats.select(F.lit(0).alias("component_idx"), "variant_idx")), data.n).persist()
    signs = rademacher(data.n, probes, o.seed)

    def fit_at(w: DataFrame) -> tuple[Fit, Problem]:
        p = Problem(data.y, data.x, SoftKernel.build(table, data.stats, w, data.n, groups), None, o)
        return p.fit(), p

    fit, problem = fit_at(weights)
    history: list[dict] = [{"outer": 0, "loglik": fit.loglik}]
    for outer in range(1, outers + 1):
        grad = weight_gradient(weights, fit.theta, problem, signs).persist()
        step, taken = rate, False
        for _ in range(trials):
            new = _kept(screen.eg_update(weights, grad, step / data.n))
            got, problem_new = fit_at(new)
            if got.loglik >= fit.loglik:
                problem.kernel.close()
                weights, fit, problem, taken = new, got, problem_new, True
                break
            problem_new.kernel.close()
            step /= 2
        history.append({"outer": outer, "loglik": fit.loglik, "taken": taken, "step": step})
        grad.unpersist()
        if not taken:
            break
    problem.kernel.close()
    table.unpersist()
    return RelaxedTable(weights, fit, history)
