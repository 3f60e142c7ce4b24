"""Alignment models trained by expectation-maximisation in long format.

Each iteration is joins on keys, windows inside a pair and grouped sums; what is
carried from one to the next is a parameter table, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numeric import gaussian_log, squared_distance
from threadloom.sources.shared import keep, release, stored

PAIR = "pair_index"
#: Fixed value: the floor of a probability.
FLOOR = 1e-11
#: Targets of all patterns that are broadcast at most (about 50 bytes each).
CELLS = 1 << 19


def cooccurrences(src: DataFrame, trg: DataFrame) -> DataFrame:
    """For each pair every (source position, target position)."""
    t = trg.select(PAIR, F.col("pos").alias("tpos"), "concept")
    return src.select(PAIR, F.col("pos").alias("spos"), "token").join(t, PAIR)


def uniform_translation(co: DataFrame) -> DataFrame:
    """p(token|concept) uniform over the tokens that meet the concept."""
    d = co.select("concept", "token").distinct()
    return d.withColumn("p", 1 / F.count(F.lit(1)).over(Window.partitionBy("concept")))


def counted_translation(co: DataFrame) -> DataFrame:
    """p(token|concept) in proportion to co-occurrence counts."""
    c = co.groupBy("concept", "token").agg(F.count(F.lit(1)).alias("n"))
    return c.select("concept", "token", (F.col("n") / F.sum("n").over(Window.partitionBy("concept"))).alias("p"))


def length_model(src: DataFrame, trg: DataFrame, laplace: bool = False) -> DataFrame:
    """q(source length | target length); ``laplace`` adds one to every
    cell below the largest lengths (these excluded, as the bound is exclusive)."""
    lf = src.groupBy(PAIR).agg(F.count(F.lit(1)).alias("lf"))
    lt = trg.groupBy(PAIR).agg(F.count(F.lit(1)).alias("lt"))
    c = lt.join(lf, PAIR).groupBy("lt", "lf").agg(F.count(F.lit(1)).alias("n"))
    if laplace:
        top = c.agg(F.max("lt").alias("a"), F.max("lf").alias("b"))
        grid = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("lt"), "b").select("lt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("lf"))
        c = grid.withColumn("n", F.lit(1).cast("long")).unionByName(c).groupBy("lt", "lf").agg(F.sum("n").alias("n"))
    return c.select("lt", "lf", (F.col("n") / F.sum("n").over(Window.partitionBy("lt"))).alias("p"))


def posteriors(co: DataFrame, params: DataFrame) -> DataFrame:
    """p(target position | source position), normalised over the targets."""
    j = co.join(params, ["concept", "token"], "left").na.fill({"p": 0.0})
    return j.withColumn("post", F.col("p") / F.sum("p").over(Window.partitionBy(PAIR, "spos")))


def translation_update(post: DataFrame, floor: float | None = None) -> DataFrame:
    """Expected counts normalised per concept; ``floor`` is applied after
    normalising and not renormalised."""
    c = post.groupBy("concept", "token").agg(F.sum("post").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("concept"))
    return c.select("concept", "token", (F.greatest(p, F.lit(floor)) if floor else p).alias("p"))


def positions(src: DataFrame, trg: DataFrame) -> DataFrame:
    """A row per source position: ``pair_index, spos, token``, ``targets`` (the
    concepts of its pair by position, which count from 0) and ``lf`` (the number
    of the pair's source positions). Pairs without targets are left out."""
    t = trg.groupBy(PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept"))), lambda x: x["concept"]).alias("targets"))
    return src.select(PAIR, F.col("pos").alias("spos"), "token", F.count(F.lit(1)).over(Window.partitionBy(PAIR)).alias("lf")).join(t, PAIR)


def patterns(at: DataFrame, *by: str) -> DataFrame:
    """Source positions with the same token, targets and ``by`` behave alike in
    the translation models: one row for all of them with their number ``n`` and an
    ``id``. Never more rows than positions; counts combine before the shuffle."""
    p = at.groupBy("token", "targets", *by).agg(F.count(F.lit(1)).alias("n"))
    return stored(p.withColumn("id", F.monotonically_increasing_id()))


def pattern_pairs(pats: DataFrame) -> DataFrame:
    """``cooccurrences`` of patterns: ``id`` is the pair, ``n`` its weight."""
    return pats.select(F.col("id").alias(PAIR), F.lit(0).alias("spos"), *[c for c in pats.columns if c not in ("id", "targets")], F.posexplode("targets").alias("tpos", "concept"))


def at_patterns(at: DataFrame, pats: DataFrame, of: DataFrame, *by: str) -> DataFrame:
    """What ``of`` says of each pattern (``pair_index`` is the id), at all of the
    positions. Patterns of at most ``CELLS`` targets in all are broadcast, so that
    positions are neither shuffled by pattern, of which some are frequent, nor
    sorted; more are joined as Spark sees fit."""
    said = pats.select("id", "token", "targets", *by).join(of.withColumnRenamed(PAIR, "id"), "id").drop("id")
    small = (pats.agg(F.sum(F.size("targets"))).first()[0] or 0) <= CELLS
    return at.join(F.broadcast(said) if small else said, ["token", "targets", *by])


def pattern_counts(pats: DataFrame) -> DataFrame:
    """A03 from patterns: p(token|concept) by co-occurrence counts."""
    c = pattern_pairs(pats).groupBy("concept", "token").agg(F.sum("n").alias("n"))
    return c.select("concept", "token", (F.col("n") / F.sum("n").over(Window.partitionBy("concept"))).alias("p"))


def ibm1(src: DataFrame, trg: DataFrame, iterations: int = 5, tolerance: float | None = None) -> DataFrame:
    """Translation table ``concept, token, p``. Stops early once the average
    log-likelihood changes by less than ``tolerance`` (relative)."""
    at = positions(src, trg)
    return ibm1_patterns(patterns(at) if tolerance is None else patterns(at, "lf"), iterations, tolerance)


def ibm1_patterns(pats: DataFrame, iterations: int = 5, tolerance: float | None = None) -> DataFrame:
    """``ibm1`` over ``patterns`` (by ``lf`` too if ``tolerance`` is given)."""
    co = pattern_pairs(pats)
    params, last = uniform_translation(co), None
    for _ in range(iterations):
        params = stored(translation_update(posteriors(co, params).withColumn("post", F.col("post") * F.col("n"))))
        if tolerance is not None:
            now = ibm1_pattern_likelihood(pats, params).first()[0]
            if last is not None and abs(now - last) <= tolerance * abs(last):
                break
            last = now
    return params


def ibm1_likelihood(src: DataFrame, trg: DataFrame, params: DataFrame) -> DataFrame:
    """Average over pairs of log q(lf|lt) - lf log(lt + 1) + the sum over
    source positions of the log of the summed translation probabilities."""
    return ibm1_pattern_likelihood(patterns(positions(src, trg), "lf"), params)


def ibm1_pattern_likelihood(pats: DataFrame, params: DataFrame) -> DataFrame:
    """The same over ``patterns`` by ``lf``: both sums weigh a pattern by the
    number of its positions; a pair has ``lf`` of them."""
    s = pattern_pairs(pats).join(params, ["concept", "token"], "left").na.fill({"p": 0.0}).groupBy(PAIR).agg(F.sum("p").alias("s"), F.first("n").alias("n"))
    tokens = s.agg(F.sum(F.col("n") * F.log(F.greatest("s", F.lit(FLOOR)))).alias("tokens"))
    cells = pats.groupBy(F.size("targets").alias("lt"), "lf").agg((F.sum("n") / F.col("lf")).alias("n"))
    q = F.col("n") / F.sum("n").over(Window.partitionBy("lt"))
    cells = cells.withColumn("q", q).agg(F.sum(F.col("n") * (F.log("q") - F.col("lf") * F.log(F.col("lt") + 1))).alias("lengths"), F.sum("n").alias("pairs"))
    return tokens.crossJoin(cells).select(((F.col("tokens") + F.col("lengths")) / F.col("pairs")).alias("avg_ll"))


def best_targets(co: DataFrame, params: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """For every source position the target with the largest probability,
    the lower position on ties. With ``prior`` the alignment prior counts too;
    lengths it doesn't know back off to 1/lt."""
    j = co.join(params, ["concept", "token"], "left").na.fill({"p": 0.0})
    if prior is not None:
        j = _with_prior(j, prior)
        j = j.withColumn("p", F.col("p") * F.col("a"))
    return j.groupBy(PAIR, "spos").agg(F.max_by("tpos", F.struct("p", -F.col("tpos"))).alias("alignment"), F.max("p").alias("score"))


def top_translations(params: DataFrame, k: int = 1) -> DataFrame:
    w = Window.partitionBy("concept").orderBy(F.desc(F.round("p", 9)), "token")
    return params.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_prior(j: DataFrame, prior: DataFrame) -> DataFrame:
    w = Window.partitionBy(PAIR)
    sized = j.withColumns({"lt": F.max("tpos").over(w) + 1, "lf": F.max("spos").over(w) + 1})
    return sized.join(prior, ["lt", "lf", "spos", "tpos"], "left").withColumn("a", F.coalesce("a", 1 / F.col("lt")))


def sized(at: DataFrame) -> DataFrame:
    """Patterns of IBM-2: by position and by the lengths of the pair."""
    return patterns(at.withColumn("lt", F.size("targets")), "spos", "lt", "lf")


def sized_pairs(pats: DataFrame) -> DataFrame:
    return pats.select(F.col("id").alias(PAIR), "token", "spos", "lt", "lf", "n", F.posexplode("targets").alias("tpos", "concept"))


def ibm2(src: DataFrame, trg: DataFrame, iterations: int = 5, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(translation table, alignment prior ``lt, lf, spos, tpos, a``). Source
    positions count from 0, as targets do.

    A06: the prior of a target position given the source position and both
    lengths; it starts uniform, the lengths include NULL."""
    return ibm2_patterns(sized(positions(src, trg)), iterations, floor)


def ibm2_patterns(pats: DataFrame, iterations: int = 5, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """``ibm2`` over ``sized`` patterns."""
    co, key = sized_pairs(pats), ["lt", "lf", "spos", "tpos"]
    params = uniform_translation(co)
    prior = co.select(key).distinct().withColumn("a", 1 / F.col("lt"))
    for _ in range(iterations):
        j = co.join(params, ["concept", "token"]).join(prior, key)
        s = F.col("p") * F.col("a")
        post = stored(j.withColumn("post", F.col("n") * s / F.sum(s).over(Window.partitionBy(PAIR))))
        params = stored(translation_update(post, floor))
        c = post.groupBy(key).agg(F.sum("post").alias("c"))
        prior = stored(c.select(*key, (F.col("c") / F.sum("c").over(Window.partitionBy("lt", "lf", "spos"))).alias("a")))
        release(post)
    return params, prior


def first_vectors(frames: DataFrame, trg: DataFrame, m: int) -> DataFrame:
    """Deterministic start of clustering: for each concept the ``m`` frames of
    lowest (pair, position) among the pairs that hold the concept."""
    j = frames.join(trg.select(PAIR, "concept"), PAIR)
    w = Window.partitionBy("concept").orderBy(PAIR, "pos")
    # a bare bound on row_number: each task keeps m rows a concept before the shuffle
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m).select("concept", (F.col("_r") - 1).alias("m"), F.col("vec").alias("mean"))


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / float(1 << 32)


def _distances(cands: str | Column, vec: Column) -> Column:
    return F.transform(cands, lambda c: F.round(squared_distance(vec, c), 9))


def _nearest(vec: Column, cands: Column) -> Column:
    return F.array_min(_distances(cands, vec))


def kmeans_seeds(frames: DataFrame, trg: DataFrame, m: int, passes: int = 2, factor: float = 2.0, seed: int = 0) -> DataFrame:
    """M06 start by distance-proportional oversampling: ``concept, m, mean``.

    Each concept starts from one drawn frame of the pairs that hold it. In each
    pass every frame becomes a candidate with probability ``factor * m * d / D``:
    ``d`` its squared distance to the nearest candidate, ``D`` the concept's sum
    of these; about ``factor * m`` a pass are taken. Candidates weigh as many
    frames as are nearest to them; of these the heaviest is the first seed, and
    each further one maximises weight times distance to the nearest seed.
    Concepts with fewer different frames have fewer seeds.

    Nothing is sorted. A pass reads the frames against their concept's list of
    candidates, about ``1 + passes * factor * m`` vectors; sums and counts
    combine before the shuffle. Draws follow from concept, pair, position, pass
    and ``seed``: repeats are equal and don't depend on the partitioning. Ties:
    lower (pair, position).
    """
    j = keep(frames.select(PAIR, "pos", "vec").join(trg.select(PAIR, "concept").distinct(), PAIR))
    draw = lambda n: drawn(F.lit(f"{seed}:{n}"), F.col("concept"), F.col(PAIR), F.col("pos"))
    first = j.groupBy("concept").agg(F.min_by(F.struct(PAIR, "pos", "vec"), F.struct(draw(0), PAIR, "pos")).alias("c"))
    cands = keep(first.select("concept", F.array("c").alias("cands")))
    vectors = F.transform("cands", lambda c: c["vec"])
    for n in range(1, passes + 1):
        near = j.join(cands.select("concept", vectors.alias("v")), "concept").select("concept", PAIR, "pos", "vec", _nearest(F.col("vec"), F.col("v")).alias("d"))
        whole = near.groupBy("concept").agg(F.sum("d").alias("whole"))
        taken = near.join(whole, "concept").where((F.col("whole") > 0) & (draw(n) < factor * m * F.col("d") / F.col("whole")))
        more = taken.groupBy("concept").agg(F.collect_list(F.struct(PAIR, "pos", "vec")).alias("more"))
        both = F.concat("cands", F.coalesce("more", F.array().cast(dict(cands.dtypes)["cands"])))
        cands = keep(cands.join(more, "concept", "left").select("concept", F.array_sort(both).alias("cands")))
    at = j.join(cands.select("concept", vectors.alias("v")), "concept")
    weights = at.select("concept", _distances("v", F.col("vec")).alias("d")).select("concept", F.array_position("d", F.array_min("d")).alias("i")).groupBy("concept", "i").agg(F.count(F.lit(1)).alias("w"))
    weights = weights.groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("w"))
    rows = cands.join(weights, "concept").select("concept", vectors.alias("v"), F.transform("cands", lambda _, i: F.coalesce(F.element_at("w", i + 1), F.lit(0)).cast("double")).alias("w"))
    score, out = F.col("w"), []
    for n in range(m):
        # the first place of the largest score; 0 once every candidate is a seed's copy
        rows = rows.withColumn("_s", score).withColumn(f"_p{n}", F.when(F.array_max("_s") > 0, F.array_position("_s", F.array_max("_s"))))
        seed_at = F.get("v", (F.col(f"_p{n}") - 1).cast("int"))
        near = _distances("v", seed_at)
        rows = rows.withColumn("_d", near if n == 0 else F.zip_with("_d", near, lambda a, b: F.least(a, b)))
        score = F.zip_with("w", "_d", lambda w, d: w * d)
        out.append(F.when(F.col(f"_p{n}").isNotNull(), F.struct(F.lit(n).alias("m"), seed_at.alias("mean"))))
    return rows.select("concept", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("s")).select("concept", "s.m", "s.mean")


def mean_vectors(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(Weighted) mean of ``vec`` per group, dimension by dimension: partial sums
    combine before the shuffle."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = df.select(*by, w.alias("_w"), F.posexplode("vec").alias("_d", "_x"))
    s = e.groupBy(*by, "_d").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"))
    return s.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", (F.col("_s") / F.col("_n")).alias("x")))), lambda t: t["x"]).alias("mean"))


def kmeans_assign(frames: DataFrame, trg: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each frame goes to the nearest centroid of the concepts of its pair;
    ties to the lower target position, then mixture."""
    j = frames.join(trg.select(PAIR, F.col("pos").alias("tpos"), "concept"), PAIR).join(centroids, "concept")
    d = F.round(squared_distance(F.col("vec"), F.col("mean")), 9)
    return j.withColumn("d", d).groupBy(PAIR, "pos").agg(F.min_by(F.struct("concept", "m", "tpos", "d", "vec"), F.struct("d", "tpos", "m")).alias("b")).select(PAIR, "pos", "b.*")


def kmeans_cost(frames: DataFrame, trg: DataFrame, centroids: DataFrame) -> DataFrame:
    """Sum of squared distances to the nearest centroid, per concept: every frame
    counts for each concept of its pair."""
    lists = centroids.groupBy("concept").agg(F.collect_list("mean").alias("v"))
    j = frames.join(trg.select(PAIR, "concept").distinct(), PAIR).join(lists, "concept")
    return j.groupBy("concept").agg(F.sum(_nearest(F.col("vec"), F.col("v"))).alias("cost"))


def kmeans(frames: DataFrame, trg: DataFrame, m: int = 1, iterations: int = 2, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids ``concept, m, mean``, assignments). A centroid without
    frames becomes the zero vector. Stops when no assignment changes. ``start``:
    first centroids (``kmeans_seeds``), else the frames of lowest ids."""
    cent = keep(first_vectors(frames, trg, m) if start is None else start)
    last = None
    for _ in range(iterations):
        a = keep(kmeans_assign(frames, trg, cent))
        mark = a.agg(F.sum(F.xxhash64(PAIR, "pos", "concept", "m") % 1000003)).first()
        new = mean_vectors(a, ["concept", "m"]).withColumnRenamed("mean", "new")
        cent = keep(cent.join(new, ["concept", "m"], "left").select("concept", "m", F.coalesce("new", F.transform("mean", lambda x: F.lit(0.0))).alias("mean")))
        if mark == last:
            break
        last = mark
    return cent, kmeans_assign(frames, trg, cent)


def gmm_posteriors(frames: DataFrame, trg: DataFrame, gmm: DataFrame) -> DataFrame:
    """M04 E-step: responsibilities of (target, mixture) for each frame, jointly
    normalised. ``gmm``: ``concept, m, logw, mean, var``."""
    j = frames.join(trg.select(PAIR, F.col("pos").alias("tpos"), "concept"), PAIR).join(gmm, "concept")
    j = j.withColumn("l", F.col("logw") + gaussian_log(F.col("vec"), F.col("mean"), F.col("var")))
    top = F.max("l").over(Window.partitionBy(PAIR, "pos"))
    j = j.withColumn("e", F.exp(F.col("l") - top)).withColumn("top", top)
    return j.withColumn("post", F.col("e") / F.sum("e").over(Window.partitionBy(PAIR, "pos")))


def gmm(frames: DataFrame, trg: DataFrame, dim: int, m: int = 1, iterations: int = 1, variance: float = 0.02, full: bool = False) -> DataFrame:
    """M04 (means only, fixed variance) and M05 (``full``: variances and weights
    too): per-concept mixtures of diagonal Gaussians."""
    g = first_vectors(frames, trg, m).select("concept", "m", F.lit(0.0).alias("logw"), "mean", F.array_repeat(F.lit(variance), dim).alias("var"))
    for _ in range(iterations):
        p = keep(gmm_posteriors(frames, trg, g).select("concept", "m", "vec", "post"))
        new = mean_vectors(p, ["concept", "m"], "post")
        if not full:
            g = keep(new.select("concept", "m", F.lit(0.0).alias("logw"), "mean", F.array_repeat(F.lit(variance), dim).alias("var")))
            continue
        dev = p.join(new, ["concept", "m"]).select("concept", "m", "post", F.zip_with("vec", "mean", lambda x, c: (x - c) * (x - c)).alias("vec"))
        var = mean_vectors(dev, ["concept", "m"], "post").select("concept", "m", F.transform("mean", lambda x: F.greatest(x, F.lit(1e-6))).alias("var"))
        weight = p.groupBy("concept", "m").agg(F.sum("post").alias("w"))
        weight = weight.select("concept", "m", F.log(F.col("w") / F.sum("w").over(Window.partitionBy("concept"))).alias("logw"))
        g = keep(new.join(var, ["concept", "m"]).join(weight, ["concept", "m"]).select("concept", "m", "logw", "mean", "var"))
    return g


def gmm_likelihood(frames: DataFrame, trg: DataFrame, g: DataFrame) -> DataFrame:
    """A07 for mixtures: mean over frames of the log of the summed densities."""
    p = gmm_posteriors(frames, trg, g)
    at = p.groupBy(PAIR, "pos").agg((F.log(F.sum("e")) + F.max("top")).alias("ll"))
    return at.agg(F.avg("ll").alias("avg_ll"))


def fit_segment_model(df: DataFrame, phone: str, slot: str, value: str, least: int = 1) -> DataFrame:
    """Gaussian per (phone, slot) of labelled segments; phones with fewer
    than ``least`` rows are pooled as ``'<rare>'``."""
    n = df.groupBy(phone).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(n, phone).withColumn("phone", F.when(F.col("_n") >= least, F.col(phone)).otherwise(F.lit("<rare>")))
    return d.groupBy("phone", F.col(slot).alias("slot")).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
