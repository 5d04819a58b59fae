"""Genotypes as a sparse long table, and kernel products as joins and aggregations.

``geno(sample_idx, variant_idx, dosage)`` holds the cells that are not zero; a
null dosage is missing.  Standardised values are ``z = (g - mean) * inv_sd``,
and 0 where missing.  Absent cells are never materialised: each product is a
sum over present cells plus a rank-one correction.

Vectors are long tables too: ``v(sample_idx, col, v)`` over samples and
``b(variant_idx, col, b)`` over variants, one ``col`` for each right-hand side,
so that many right-hand sides share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

VAR_FLOOR = 1e-6


def variant_stats(geno: DataFrame, variants: DataFrame, n: int | Column) -> DataFrame:
    """``variant_idx``, ``cnt``, ``mean``, ``var``, ``inv_sd``, ``het``, ``hom``, ``miss`` for every variant."""
    n = F.lit(n) if isinstance(n, int) else n
    sums = geno.groupBy("variant_idx").agg(
        F.count_if(F.col("dosage").isNull()).alias("miss"),
        F.count_if(F.col("dosage") == 1).alias("het"),
        F.count_if(F.col("dosage") == 2).alias("hom"),
        F.sum(F.col("dosage").cast("double")).alias("s1"),
        F.sum((F.col("dosage") * F.col("dosage")).cast("double")).alias("s2"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = variants.select("variant_idx").join(sums, "variant_idx", "left")
    out = out.select("variant_idx", (n - zero("miss")).cast("long").alias("cnt"), *(zero(c).cast("long").alias(c) for c in ("het", "hom", "miss")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s1", "s2")))
    mean = F.when(F.col("cnt") > 0, F.col("s1") / F.col("cnt")).otherwise(0.0)
    out = out.withColumn("mean", mean)
    out = out.withColumn("var", F.when(F.col("cnt") > 0, F.col("s2") / F.col("cnt") - F.col("mean") * F.col("mean")).otherwise(0.0))
    inv = F.when((F.col("cnt") > 0) & (F.col("var") > 0), 1 / F.sqrt(F.greatest("var", F.lit(VAR_FLOOR)))).otherwise(0.0)
    return out.withColumn("inv_sd", inv).drop("s1", "s2")


def component_map(components: DataFrame) -> DataFrame:
    """``component_idx``, ``local_idx``, ``variant_idx`` from (component_idx, variant_idx): sorted inside a component."""
    from pyspark.sql import Window as W

    return components.distinct().withColumn("local_idx", F.row_number().over(W.partitionBy("component_idx").orderBy("variant_idx")) - 1).select("component_idx", F.col("local_idx").cast("long").alias("local_idx"), "variant_idx")


def block_ranges(sizes: list[int], m: int) -> list[tuple[int, int, int]]:
    """(component, first, end) of contiguous components; sizes are positive and add up to ``m``."""
    if any(s <= 0 for s in sizes) or sum(sizes) != m:
        raise ValueError(f"block sizes must be positive and add up to {m}")
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    return [(k, e - s, e) for k, (s, e) in enumerate(zip(sizes, ends))]


def overlapping(components: DataFrame) -> DataFrame:
    """Variants that more than one component claims, or one claims twice."""
    return components.groupBy("variant_idx").agg(F.count("*").alias("claims")).filter("claims > 1")


def check_components(components: DataFrame, m: int) -> None:
    """Raises on a claim outside ``m`` variants, and on a variant that is claimed twice, by one component or by several."""
    outside = components.filter((F.col("variant_idx") < 0) | (F.col("variant_idx") >= m) | F.col("variant_idx").isNull()).orderBy("component_idx", "variant_idx").limit(1).collect()
    if outside:
        raise ValueError(f"component {outside[0]['component_idx']} names variant {outside[0]['variant_idx']} of {m}")
    twice = overlapping(components).orderBy("variant_idx").limit(1).collect()
    if twice:
        raise ValueError(f"components overlap: variant {twice[0]['variant_idx']} is claimed {twice[0]['claims']} times")


def same_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows by which two component tables differ in the variants they cover, as multisets."""
    a, b = before.select("variant_idx"), after.select("variant_idx")
    return a.exceptAll(b).withColumn("side", F.lit("before")).union(b.exceptAll(a).withColumn("side", F.lit("after")))


def component_stats(stats: DataFrame, cmap: DataFrame, n: int) -> DataFrame:
    """``component_idx``, ``m``, ``m_eff``, ``mean_diag`` (trace over n)."""
    valid = F.col("inv_sd") > 0
    rows = cmap.join(stats.select("variant_idx", "cnt", "inv_sd"), "variant_idx")
    out = rows.groupBy("component_idx").agg(F.count("*").alias("m"), F.count_if(valid).alias("m_eff"), F.sum(F.when(valid, F.col("cnt")).otherwise(0)).alias("cells"))
    return out.select("component_idx", "m", "m_eff", F.when(F.col("m_eff") > 0, F.col("cells") / (F.lit(float(n)) * F.col("m_eff"))).otherwise(0.0).alias("mean_diag"))


def _present(geno: DataFrame, stats: DataFrame) -> DataFrame:
    """Present cells of valid variants with ``h = g`` (the mean where missing)."""
    own = stats.filter("inv_sd > 0").select("variant_idx", "mean", "inv_sd")
    return geno.join(own, "variant_idx").withColumn("h", F.coalesce(F.col("dosage").cast("double"), F.col("mean")))


def packed(rows: DataFrame, key: str, value: str, columns: list, *more: Column) -> DataFrame:
    """A row for each ``key`` with all its right-hand sides as an array ``v`` in the order of ``columns``; absent ones are 0."""
    each = [F.coalesce(F.sum(F.when(F.col("col").eqNullSafe(_literal(c)), F.col(value))), F.lit(0.0)) for c in columns]
    return rows.groupBy(key).agg(F.array(*each).alias("v"), *more)


def _literal(c):
    return F.struct(*(F.lit(x).alias(n) for n, x in c.asDict().items())) if isinstance(c, Row) else F.lit(c)


def right_hand_sides(v: DataFrame) -> tuple[list, int]:
    """The right-hand sides of ``v``, which are few, and how many numbers they hold: one job."""
    rows = v.groupBy("col").agg(F.count("*").alias("n")).collect()
    return sorted((r["col"] for r in rows), key=str), sum(r["n"] for r in rows)


#: Samples or variants times right-hand sides up to which a side is broadcast (8 bytes each).
BROADCAST = 1 << 20


def _small(rows: DataFrame, numbers: int) -> DataFrame:
    """``rows``, broadcast if they hold few numbers, which the caller has counted."""
    return F.broadcast(rows) if numbers <= BROADCAST else rows


def _unpacked(rows: DataFrame, columns: list, kind: str) -> DataFrame:
    """One row for each right-hand side again, ``col`` and ``value`` from the array ``v``."""
    each = F.array(*(F.struct(_literal(c).cast(kind).alias("col"), F.col("v")[k].alias("value")) for k, c in enumerate(columns)))
    return rows.withColumn("each", F.explode(each)).select(*(c for c in rows.columns if c != "v"), "each.col", "each.value")


def _kind(v: DataFrame) -> str:
    return v.schema["col"].dataType.simpleString()


def gathered(geno: DataFrame, stats: DataFrame, wide: DataFrame, width: int, numbers: int) -> DataFrame:
    """``variant_idx``, ``mean``, ``inv_sd``, ``v``: scores of every valid variant side by side, from ``wide(sample_idx, v)``.

    A sample's right-hand sides lie in one array, so each cell is joined and
    shuffled once however many there are; their totals, which stand for absent
    cells, are a row of the same plan.
    """
    total = wide.groupBy().agg(F.array(*(F.coalesce(F.sum(F.col("v")[k]), F.lit(0.0)) for k in range(width))).alias("total"))
    gv = [F.sum(F.col("dosage") * F.col("v")[k]) for k in range(width)]
    mv = [F.sum(F.when(F.col("dosage").isNull(), F.col("v")[k])) for k in range(width)]
    cells = geno.join(_small(wide, numbers), "sample_idx").groupBy("variant_idx").agg(F.array(*gv).alias("gv"), F.array(*mv).alias("mv"))
    out = stats.filter("inv_sd > 0").select("variant_idx", "mean", "inv_sd").join(cells, "variant_idx", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0.0))
    each = [F.col("inv_sd") * (zero("gv", k) - F.col("mean") * (F.col("total")[k] - zero("mv", k))) for k in range(width)]
    return out.select("variant_idx", "mean", "inv_sd", F.array(*each).alias("v"))


def _spread(geno: DataFrame, wide: DataFrame, width: int, samples: DataFrame, numbers: int) -> DataFrame:
    """``sample_idx``, ``v``: rows of dosages times ``wide(variant_idx, mean, v)``, whose ``v`` are coefficients over the scale.

    The constant that absent cells give is a row of the same plan, so what lies
    behind ``wide`` is shuffled once for both of its uses.
    """
    shift = wide.groupBy().agg(F.array(*(F.coalesce(F.sum(F.col("mean") * F.col("v")[k]), F.lit(0.0)) for k in range(width))).alias("shift"))
    dose = F.coalesce(F.col("dosage").cast("double"), F.col("mean"))
    cells = geno.join(_small(wide, numbers), "variant_idx").groupBy("sample_idx").agg(F.array(*(F.sum(dose * F.col("v")[k]) for k in range(width))).alias("sums"))
    each = [F.coalesce(F.col("sums")[k], F.lit(0.0)) - F.col("shift")[k] for k in range(width)]
    return samples.select("sample_idx").join(cells, "sample_idx", "left").crossJoin(F.broadcast(shift)).select("sample_idx", F.array(*each).alias("v"))  # one row


def _scaled(wide: DataFrame, factors: list[Column], width: int) -> DataFrame:
    """``wide`` as coefficients over the scale: every factor times all right-hand sides, one factor after another."""
    return wide.select("variant_idx", "mean", F.array(*(F.col("inv_sd") * F.col("v")[k] * f for f in factors for k in range(width))).alias("v"))


def valid_count(stats: DataFrame) -> int:
    """How many variants have a scale: the divisor of the standard kernel, and what a side of variants holds."""
    return stats.filter("inv_sd > 0").count()


def xtv(geno: DataFrame, stats: DataFrame, v: DataFrame) -> DataFrame:
    """``variant_idx``, ``col``, ``score``: standardised columns times vectors, for every valid variant."""
    columns, numbers = right_hand_sides(v)
    if not columns:
        return stats.select("variant_idx", F.lit(None).cast(_kind(v)).alias("col"), F.lit(0.0).alias("score")).limit(0)
    wide = gathered(geno, stats, packed(v, "sample_idx", "v", columns), len(columns), numbers)
    return _unpacked(wide.select("variant_idx", "v"), columns, _kind(v)).withColumnRenamed("value", "score")


def zb(geno: DataFrame, stats: DataFrame, b: DataFrame, samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``sample_idx``, ``col``[, by], ``value``: standardised rows times coefficients, for every sample.

    ``b`` may carry further grouping columns, such as a component.  A variant's
    right-hand sides lie side by side, as in ``xtv``.
    """
    if by:  # one right-hand side for each group and column
        b = b.withColumn("col", F.struct("col", *by))
    columns, numbers = right_hand_sides(b)
    if not columns:
        out = samples.select("sample_idx", F.lit(None).cast(_kind(b)).alias("col"), F.lit(0.0).alias("value")).limit(0)
    else:
        scaled = b.join(stats.filter("inv_sd > 0").select("variant_idx", "mean", "inv_sd"), "variant_idx").withColumn("w", F.col("inv_sd") * F.col("b"))
        wide = packed(scaled, "variant_idx", "w", columns, F.max("mean").alias("mean"))
        out = _unpacked(_spread(geno, wide, len(columns), samples, numbers), columns, _kind(b))
    return out.select("sample_idx", "col.*", "value") if by else out


def _product(geno: DataFrame, stats: DataFrame, v: DataFrame, samples: DataFrame, weights: DataFrame | None, factors: list[Column], numbers: int) -> tuple[DataFrame, list]:
    """Z diag(f) Z' V for every factor f, a column over ``weights`` by variant: ``sample_idx`` and an array, factor by factor."""
    columns, given = right_hand_sides(v)
    wide = gathered(geno, stats, packed(v, "sample_idx", "v", columns), len(columns), given)
    if weights is not None:
        wide = wide.join(weights, "variant_idx")
    width = len(columns) * len(factors)
    return _spread(geno, _scaled(wide, factors, len(columns)), width, samples, numbers * width), columns


def kv(geno: DataFrame, stats: DataFrame, v: DataFrame, samples: DataFrame) -> DataFrame:
    """``K V`` with ``K = Z Z' / m_eff``."""
    m_eff = valid_count(stats)
    out, columns = _product(geno, stats, v, samples, None, [F.lit(1.0 / max(m_eff, 1))], m_eff)
    return _unpacked(out, columns, _kind(v))


def _by_factor(out: DataFrame, names: list, name: str, columns: list, kind: str) -> DataFrame:
    """A row for each factor's part of the arrays that ``_product`` gives."""
    width = len(columns)
    each = F.array(*(F.struct(F.lit(g).alias("g"), F.slice("v", k * width + 1, width).alias("v")) for k, g in enumerate(names)))
    parts = out.select("sample_idx", F.inline(each)).select(F.col("g").alias(name), "sample_idx", "v")
    return _unpacked(parts, columns, kind)


def stacked_kv(geno: DataFrame, stats: DataFrame, cmap: DataFrame, v: DataFrame, samples: DataFrame) -> DataFrame:
    """``K_g V`` of every component in one pass, keyed by ``component_idx``; a variant may lie in several."""
    rows = sorted(component_stats(stats, cmap, 1).select("component_idx", "m", "m_eff").collect())  # a row for each component
    own = cmap.groupBy("variant_idx").agg(F.collect_set("component_idx").alias("components"))
    factors = [F.when(F.array_contains("components", F.lit(r["component_idx"])), F.lit(1.0 / max(r["m_eff"], 1))).otherwise(F.lit(0.0)) for r in rows]
    out, columns = _product(geno, stats, v, samples, own, factors, sum(r["m"] for r in rows))
    return _by_factor(out, [r["component_idx"] for r in rows], "component_idx", columns, _kind(v))


def weighted_hv(geno: DataFrame, stats: DataFrame, cmap: DataFrame, theta: DataFrame, theta_e: float, v: DataFrame, samples: DataFrame) -> DataFrame:
    """``H V = theta_e V + sum_g theta_g K_g V`` in one pass: coefficients are scaled by theta_g / m_eff_g."""
    parts = component_stats(stats, cmap, 1).join(theta, "component_idx").filter("m_eff > 0").select("component_idx", "m", (F.col("theta") / F.col("m_eff")).alias("scale")).collect()
    scale = geno.sparkSession.createDataFrame([(r["component_idx"], r["scale"]) for r in parts], "component_idx int, scale double")
    weight = cmap.join(F.broadcast(scale), "component_idx").groupBy("variant_idx").agg(F.sum("scale").alias("scale"))  # a row for each component
    out, columns = _product(geno, stats, v, samples, weight, [F.col("scale")], sum(r["m"] for r in parts))
    return _unpacked(out, columns, _kind(v)).join(v, ["sample_idx", "col"]).select("sample_idx", "col", (F.col("value") + theta_e * F.col("v")).alias("value"))


def soft_kv(geno: DataFrame, stats: DataFrame, theta: DataFrame, v: DataFrame, samples: DataFrame) -> DataFrame:
    """``Z diag(theta_k) Z' V / sum theta_k`` for every group k of ``theta(variant_idx, group_idx, w)``."""
    rows = sorted(theta.groupBy("group_idx").agg(F.sum("w").alias("total"), F.count("*").alias("n")).collect())  # a row for each group
    sums = [F.coalesce(F.sum(F.when(F.col("group_idx") == r["group_idx"], F.col("w"))), F.lit(0.0)) / F.lit(r["total"]) for r in rows]
    own = theta.groupBy("variant_idx").agg(F.array(*sums).alias("share"))
    out, columns = _product(geno, stats, v, samples, own, [F.col("share")[k] for k in range(len(rows))], max((r["n"] for r in rows), default=0))
    return _by_factor(out, [r["group_idx"] for r in rows], "group_idx", columns, _kind(v)).select("sample_idx", "col", "group_idx", "value")


def admixed_kv(geno: DataFrame, stats: DataFrame, q: DataFrame, v: DataFrame, samples: DataFrame) -> DataFrame:
    """``D^(1/2) K D^(1/2) V`` of every ancestry of ``q(sample_idx, ancestry, q)``, fused into one pass over more columns."""
    wide = v.join(q, "sample_idx").select("sample_idx", F.struct("col", "ancestry").alias("col"), (F.col("v") * F.sqrt("q")).alias("v"))
    out = kv(geno, stats, wide, samples).select("sample_idx", "col.*", "value")
    return out.join(q, ["sample_idx", "ancestry"]).select("ancestry", "sample_idx", "col", (F.col("value") * F.sqrt("q")).alias("value"))


def residual_per_ancestry(q: DataFrame, v: DataFrame) -> DataFrame:
    """``diag(q_a) V`` for every ancestry."""
    return v.join(q, "sample_idx").select("ancestry", "sample_idx", "col", (F.col("q") * F.col("v")).alias("value"))


def block_w_kv(geno: DataFrame, stats: DataFrame, w: DataFrame, v: DataFrame, samples: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """``sum_b Z_b W_b Z_b' V / c`` with ``w(block_idx, i, j, w)`` over variant ids; ``scale`` is 1 / c."""
    scores = xtv(geno, stats, v).withColumnRenamed("variant_idx", "j")
    b = w.join(scores, "j").groupBy(F.col("i").alias("variant_idx"), "col").agg(F.sum(F.col("w") * F.col("score")).alias("b"))
    return zb(geno, stats, b, samples).withColumn("value", F.col("value") * scale)


def identity_w(stats: DataFrame) -> DataFrame:
    """The identity as a weight table."""
    return stats.select(F.lit(0).alias("block_idx"), F.col("variant_idx").alias("i"), F.col("variant_idx").alias("j"), F.lit(1.0).alias("w"))


def w_trace(geno: DataFrame, stats: DataFrame, w: DataFrame, n: int) -> DataFrame:
    """``block_idx``, ``trace``: tr(Z_b W_b Z_b') / n, from the Gram of variants that share a block entry."""
    z = dense_z(geno, stats, n)
    left = z.select(F.col("variant_idx").alias("i"), "sample_idx", F.col("z").alias("zi"))
    right = z.select(F.col("variant_idx").alias("j"), "sample_idx", F.col("z").alias("zj"))
    gram = w.join(left, "i").join(right, ["j", "sample_idx"])
    return gram.groupBy("block_idx").agg((F.sum(F.col("w") * F.col("zi") * F.col("zj")) / n).alias("trace"))


def dense_z(geno: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """All standardised cells of valid variants: for small tables and per-block work only."""
    own = stats.filter("inv_sd > 0").select("variant_idx", "mean", "inv_sd")
    grid = own.withColumn("sample_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    cells = geno.select("variant_idx", "sample_idx", "dosage", F.lit(True).alias("present"))
    out = grid.join(cells, ["variant_idx", "sample_idx"], "left")
    g = F.when(F.col("present").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("dosage").cast("double"), F.col("mean")))
    return out.select("sample_idx", "variant_idx", ((g - F.col("mean")) * F.col("inv_sd")).alias("z"))


def exact_diag(geno: DataFrame, stats: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample_idx``, ``diag``: sum of squared standardised values over m_eff; absent cells by a constant."""
    cells = _present(geno, stats)
    zz = (F.col("h") - F.col("mean")) * F.col("inv_sd")
    absent = F.col("mean") * F.col("inv_sd")
    extra = cells.groupBy("sample_idx").agg(F.sum(zz * zz - absent * absent).alias("extra"))
    total = stats.filter("inv_sd > 0").agg(F.sum(absent * absent).alias("total"), F.count("*").alias("m_eff"))
    out = samples.select("sample_idx").join(extra, "sample_idx", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("sample_idx", ((F.coalesce("extra", F.lit(0.0)) + F.col("total")) / F.col("m_eff")).alias("diag"))


def projected_core(geno: DataFrame, stats: DataFrame, u: DataFrame) -> DataFrame:
    """``p``, ``q``, ``value``: U'KU = (Z'U)'(Z'U) / m_eff; columns of ``u`` meet at the same variant only."""
    s = xtv(geno, stats, u)
    pair = s.select("variant_idx", F.col("col").alias("p"), F.col("score").alias("sp")).join(s.select("variant_idx", F.col("col").alias("q"), F.col("score").alias("sq")), "variant_idx")
    m_eff = stats.agg(F.count_if(F.col("inv_sd") > 0).alias("m_eff"))
    return pair.groupBy("p", "q").agg(F.sum(F.col("sp") * F.col("sq")).alias("s")).crossJoin(F.broadcast(m_eff)).select("p", "q", (F.col("s") / F.col("m_eff")).alias("value"))  # one row


def columns_of(geno: DataFrame, stats: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Standardised columns of the wanted variants ``wanted(position, variant_idx)``; repeats and order are kept."""
    z = dense_z(geno.join(wanted.select("variant_idx").distinct(), "variant_idx", "left_semi"), stats.join(wanted.select("variant_idx").distinct(), "variant_idx", "left_semi"), n)
    return wanted.join(z, "variant_idx").select("position", "variant_idx", "sample_idx", "z")


#: Samples in one packed piece of a variant, a multiple of four.
PIECE = 1 << 16


def pack_2bit(geno: DataFrame, samples: DataFrame, variants: DataFrame) -> DataFrame:
    """``variant_idx``, ``first``, ``packed``, ``n``: present cells, null where missing, as the bytes that ``unpack_2bit`` reads.

    A row holds ``n`` samples from ``first`` on, at most ``PIECE``, so none grows with the samples.
    Only bytes with a present cell are rows; the bytes between them are filled in
    as the text of a piece is put together, so the grid is never made.
    """
    code = F.when(F.col("dosage").isNull(), 1).when(F.col("dosage") == 2, 0).when(F.col("dosage") == 1, 2).otherwise(3)
    # An absent cell is 3, so a present one takes what it lacks to 3 away from a byte of 255.
    octet = (255 - F.sum((3 - code) * F.pow(F.lit(4), F.col("sample_idx") % 4))).cast("long")
    first = (F.floor(F.col("sample_idx") / PIECE) * PIECE).cast("long").alias("first")
    octets = geno.groupBy("variant_idx", first, F.floor(F.col("sample_idx") % PIECE / 4).alias("at")).agg(octet.alias("octet"))
    lists = octets.groupBy("variant_idx", "first").agg(F.sort_array(F.collect_list(F.struct("at", "octet"))).alias("list"))
    firsts = samples.agg(F.count("*").alias("all")).select("all", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("all") - 1, F.lit(0)), F.lit(PIECE).cast("long"))).alias("first"))
    rows = variants.select("variant_idx").crossJoin(F.broadcast(firsts.select("first", F.least(F.col("all") - F.col("first"), F.lit(PIECE)).alias("n"))))  # a row for each 65536 samples
    rows = rows.join(lists, ["variant_idx", "first"], "left")
    rows = rows.withColumn("list", F.coalesce("list", F.array().cast("array<struct<at:bigint,octet:bigint>>")))
    before = F.concat(F.array(F.lit(-1).cast("long")), F.transform("list", lambda x: x["at"]))
    filler = lambda k: F.repeat(F.lit("FF"), k.cast("int"))
    # One entry more than there are bytes: the last fills up to the end.
    pieces = F.zip_with("list", before, lambda x, p: F.concat(filler(F.coalesce(x["at"], F.ceil(F.col("n") / 4)) - p - 1), F.coalesce(F.lpad(F.hex(x["octet"]), 2, "0"), F.lit(""))))
    return rows.select("variant_idx", "first", F.unhex(F.array_join(pieces, "")).alias("packed"), "n")


def unpack_2bit(packed: DataFrame) -> DataFrame:
    """``variant_idx``, ``sample_idx``, ``dosage`` from bytes of four codes, low bits first: 0 is two copies, 1 missing, 2 one, 3 none.

    Without a column ``first``, bytes begin at sample 0.
    """
    packed = packed if "first" in packed.columns else packed.withColumn("first", F.lit(0).cast("long"))
    octet = F.conv(F.hex(F.substring("packed", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    rows = packed.filter("n > 0").select("variant_idx", "first", "n", "packed", F.explode(F.sequence(F.lit(0), F.octet_length("packed") - 1)).alias("at")).select("variant_idx", "first", "n", "at", octet.alias("octet"))
    rows = rows.select("variant_idx", "first", "n", F.posexplode(F.array(*(F.shiftright("octet", 2 * k).bitwiseAND(F.lit(3)) for k in range(4)))).alias("k", "code"), "at")
    dosage = F.when(F.col("code") == 0, 2).when(F.col("code") == 2, 1).when(F.col("code") == 3, 0)
    inside = F.col("at") * 4 + F.col("k")
    return rows.filter(inside < F.col("n")).select("variant_idx", (F.col("first") + inside).cast("long").alias("sample_idx"), dosage.cast("byte").alias("dosage"))
