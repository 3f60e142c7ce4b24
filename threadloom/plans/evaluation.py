"""Queries of aggregations and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import metrics as M
from threadloom.operators import retrieval as R
from threadloom.operators.em import counted_translation, cooccurrences, fit_segment_model, length_model, uniform_translation

from . import corpora as C
from .corpora import SQL_EV, SQL_SRC, SQL_TRG, SQL_VEC
from .registry import query
from .relational import PAIR, SQL_COS, SQL_IOU, SQL_MEANS, SQL_RUNS, both_runs, cosine_sides

Spark = SparkSession
SQL_PAIRS = "WITH " + SQL_SRC + ", " + SQL_TRG


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


SQL_LEN = SQL_PAIRS + ", f AS (SELECT pair_index, count(*) AS lf FROM src GROUP BY 1), t AS (SELECT pair_index, count(*) AS lt FROM trg GROUP BY 1), c AS (SELECT lt, lf, count(*) AS n FROM f JOIN t USING (pair_index) GROUP BY 1, 2)"


@query(SQL_LEN + " SELECT lt, lf, round(n / sum(n) OVER (PARTITION BY lt), 6) AS p FROM c")
def a01_length_model(spark: Spark, d: str) -> DataFrame:
    return rounded(length_model(C.src_tokens(spark, d), C.trg_tokens(spark, d)), "p")


@query(SQL_LEN + """, g AS (SELECT CAST(a AS BIGINT) AS lt, CAST(b AS BIGINT) AS lf, 1 AS n FROM (SELECT max(lt) AS x, max(lf) AS y FROM c), range(50) r(a), range(50) s(b) WHERE a < x AND b < y UNION ALL FROM c), u AS (SELECT lt, lf, sum(n) AS n FROM g GROUP BY 1, 2)
SELECT lt, lf, round(n / sum(n) OVER (PARTITION BY lt), 6) AS p FROM u""")
def a02_length_model_laplace(spark: Spark, d: str) -> DataFrame:
    return rounded(length_model(C.src_tokens(spark, d), C.trg_tokens(spark, d), laplace=True), "p")


@query(SQL_PAIRS + ", c AS (SELECT DISTINCT concept, token FROM src JOIN trg USING (pair_index)) SELECT concept, token, round(1 / count(*) OVER (PARTITION BY concept), 6) AS p FROM c")
def a03_uniform_translation(spark: Spark, d: str) -> DataFrame:
    return rounded(uniform_translation(cooccurrences(C.src_tokens(spark, d), C.trg_tokens(spark, d))), "p")


@query(SQL_PAIRS + ", c AS (SELECT concept, token, count(*) AS n FROM src JOIN trg USING (pair_index) GROUP BY 1, 2) SELECT concept, token, round(n / sum(n) OVER (PARTITION BY concept), 6) AS p FROM c")
def a03_counted_translation(spark: Spark, d: str) -> DataFrame:
    return rounded(counted_translation(cooccurrences(C.src_tokens(spark, d), C.trg_tokens(spark, d))), "p")


@query("WITH " + SQL_EV + ", c AS (SELECT pred, gold, count(*) AS n FROM ev GROUP BY 1, 2) SELECT pred, gold, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c")
def a08_confusion(spark: Spark, d: str) -> DataFrame:
    return rounded(M.confusion(C.event_tokens(spark, d)), "share")


@query("WITH " + SQL_EV + ", c AS (SELECT pred, gold, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT gold, max(n) / sum(n) AS b FROM c GROUP BY 1) SELECT round(sum(b) / (max(gold) + 1), 6) AS purity FROM s")
def a09_purity(spark: Spark, d: str) -> DataFrame:
    return rounded(M.purity(C.event_tokens(spark, d), "pred", "gold"), "purity")


@query("WITH " + SQL_EV + "SELECT round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END), 6) AS accuracy FROM ev WHERE pos < 2000")
def a10_accuracy(spark: Spark, d: str) -> DataFrame:
    return rounded(M.accuracy(C.event_tokens(spark, d)), "accuracy")


SQL_LOCAL = SQL_EV + """, v AS (SELECT pair_index, greatest(max(pred), max(gold)) + 1 AS v FROM ev GROUP BY 1), g AS (SELECT pair_index, sum(x) AS r FROM (SELECT pair_index, gold, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS x FROM ev GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT pair_index, sum(x) AS p FROM (SELECT pair_index, pred, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS x FROM ev GROUP BY 1, 2) GROUP BY 1), l AS (SELECT pair_index, r / v AS recall, p / v AS precision FROM v JOIN g USING (pair_index) JOIN p USING (pair_index))"""


@query("WITH " + SQL_LOCAL + ", m AS (SELECT avg(recall) AS r, avg(precision) AS p FROM l) SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(2 * p * r / (p + r), 6) AS f1 FROM m")
def a11_local_prf(spark: Spark, d: str) -> DataFrame:
    return rounded(M.local_prf(C.event_tokens(spark, d)), "recall", "precision", "f1")


@query("WITH " + SQL_EV + """, r AS (SELECT gold AS c, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS r FROM ev GROUP BY 1), p AS (SELECT pred AS c, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS p FROM ev GROUP BY 1), m AS (SELECT avg(coalesce(r, 0)) AS r, avg(coalesce(p, 0)) AS p FROM r FULL JOIN p USING (c))
SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(2 * p * r / (p + r), 6) AS f1 FROM m""")
def a12_concept_prf(spark: Spark, d: str) -> DataFrame:
    return rounded(M.concept_prf(C.event_tokens(spark, d)), "recall", "precision", "f1")


@query(SQL_RUNS + f""", b AS (SELECT p.pair_index, p.start, coalesce(max({SQL_IOU}), 0) AS iou FROM runs p LEFT JOIN gruns g ON p.pair_index = g.pair_index AND p.start < g."end" AND g.start < p."end" GROUP BY 1, 2) SELECT round(avg(iou), 6) AS iou FROM b""")
def a13_word_iou(spark: Spark, d: str) -> DataFrame:
    return rounded(M.word_iou(*both_runs(spark, d)), "iou")


def sql_segmentation(tolerance: int) -> str:
    return SQL_RUNS + f""", a AS (SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY pair_index) AS l FROM runs) WHERE "end" < l), b AS (SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY pair_index) AS l FROM gruns) WHERE "end" < l),
m AS (SELECT p.pair_index, count(*) AS m FROM a p JOIN b g ON p.pair_index = g.pair_index AND (abs(p."end" - g."end") <= {tolerance} OR {SQL_IOU} > 0.5) GROUP BY 1),
n AS (SELECT pair_index, np, ng, coalesce(m, 0) AS m FROM (SELECT pair_index, count(*) AS np FROM runs GROUP BY 1) JOIN (SELECT pair_index, count(*) AS ng FROM gruns GROUP BY 1) USING (pair_index) LEFT JOIN m USING (pair_index)),
s AS (SELECT avg(m / ng) AS r, avg(m / np) AS p FROM n) SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""


@query(sql_segmentation(1))
def a14_segmentation_prf(spark: Spark, d: str) -> DataFrame:
    return rounded(M.segmentation_prf(*both_runs(spark, d), tolerance=1), "recall", "precision", "f1")


@query(sql_segmentation(3))
def a14_segmentation_prf_wide(spark: Spark, d: str) -> DataFrame:
    return rounded(M.segmentation_prf(*both_runs(spark, d), tolerance=3), "recall", "precision", "f1")


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def a15_class_distribution(spark: Spark, d: str) -> DataFrame:
    return rounded(M.class_distribution(C.table(spark, d, "documents"), "lang"), "share")


@query(SQL_RUNS + ' SELECT "end" - start AS length, count(*) AS n FROM runs GROUP BY 1')
def a16_length_histogram(spark: Spark, d: str) -> DataFrame:
    return M.length_histogram(both_runs(spark, d)[0])


@query(SQL_RUNS + ' SELECT round(avg("end" - start), 6) AS true_mean, round(avg("end" - start) + 1, 6) AS index_mean FROM runs')
def a16_mean_length(spark: Spark, d: str) -> DataFrame:
    r = both_runs(spark, d)[0]
    return rounded(M.mean_length(r).withColumnRenamed("mean_length", "true_mean").crossJoin(M.mean_length(r, compat=True).withColumnRenamed("mean_length", "index_mean")), "true_mean", "index_mean")


@query("WITH " + SQL_COS + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id DESC) AS r FROM s), f AS (SELECT query_id, min(r) AS rank FROM k WHERE ql = il GROUP BY 1) SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10 FROM f")
def a17_recall_at_k(spark: Spark, d: str) -> DataFrame:
    return rounded(M.recall_at(R.cosine_ranks(*cosine_sides(spark, d))), "recall_1", "recall_5", "recall_10")


@query(SQL_RUNS + """, c AS (SELECT g.pair_index, start, "end", ev.pred AS v, count(*) AS n FROM gruns g JOIN ev ON ev.pair_index = g.pair_index AND pos >= start AND pos < "end" GROUP BY 1, 2, 3, 4) SELECT pair_index, start, "end", arg_max(v, (n, -v)) AS mode FROM c GROUP BY 1, 2, 3""")
def a18_span_mode(spark: Spark, d: str) -> DataFrame:
    return M.span_mode(both_runs(spark, d)[1].drop("gold"), C.event_tokens(spark, d), "pred")


@query("SELECT source, CAST(least(count(*), 100) AS BIGINT) AS n FROM documents GROUP BY 1")
def a19_capped_counts(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "documents").groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(100)).alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def a20_mean_std(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("""WITH c AS (SELECT event_type, floor(value) AS threshold, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(threshold AS BIGINT) AS threshold, round(sum(p) OVER w / sum(p) OVER (PARTITION BY event_type), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (PARTITION BY event_type), 6) AS fpr FROM c WINDOW w AS (PARTITION BY event_type ORDER BY threshold DESC)""")
def a21_roc(spark: Spark, d: str) -> DataFrame:
    e = C.table(spark, d, "events").withColumns({"score": F.floor("value"), "hit": F.col("event_id") % 3 == 0})
    return rounded(M.roc_points(e, "score", "hit", ["event_type"]), "tpr", "fpr")


@query("WITH " + SQL_EV + "SELECT gold, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM ev GROUP BY 1")
def a22_class_accuracy(spark: Spark, d: str) -> DataFrame:
    return rounded(M.class_accuracy(C.event_tokens(spark, d)), "accuracy")


@query("WITH " + SQL_EV + """, g AS (SELECT gold AS c, count(*) AS support, count(*) FILTER (pred = gold) AS tp FROM ev GROUP BY 1), p AS (SELECT pred AS c, count(*) AS found FROM ev GROUP BY 1)
SELECT c, support, round(CASE WHEN tp > 0 THEN 2 * tp / (support + coalesce(found, 0)) ELSE 0 END, 6) AS f1 FROM g LEFT JOIN p USING (c)""")
def a23_class_f1(spark: Spark, d: str) -> DataFrame:
    return rounded(M.class_f1(C.event_tokens(spark, d)), "f1")


@query("WITH " + SQL_EV + "SELECT round(avg(CASE WHEN gold = 0 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM ev")
def a24_constant_baseline(spark: Spark, d: str) -> DataFrame:
    return rounded(M.accuracy(C.event_tokens(spark, d).withColumn("pred", F.lit(0).cast("long")), max_len=1 << 30), "accuracy")


@query(SQL_PAIRS + "SELECT concept, string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT DISTINCT concept, token FROM src JOIN trg USING (pair_index, pos)) GROUP BY 1")
def a25_token_clusters(spark: Spark, d: str) -> DataFrame:
    c = M.token_clusters(C.src_tokens(spark, d).join(C.trg_tokens(spark, d), [PAIR, "pos"]), "concept", "token")
    return c.withColumn("tokens", F.array_join("tokens", " "))


@query("WITH " + SQL_SRC + """, s AS (SELECT pair_index, string_agg(chr(CAST(64 + CAST(replace(token, 'Brand#', '') AS INT) AS INT)), '' ORDER BY pos) AS a, string_agg(chr(CAST(64 + CAST(replace(token, 'Brand#', '') AS INT) AS INT)), '' ORDER BY token, pos) AS b FROM src GROUP BY 1)
SELECT CAST(sum(levenshtein(a, b)) AS BIGINT) AS dist, CAST(sum(length(a)) AS BIGINT) AS ref_tokens, round(sum(levenshtein(a, b)) / sum(length(a)), 6) AS rate FROM s""")
def a26_word_error_rate(spark: Spark, d: str) -> DataFrame:
    tok = lambda by: F.transform(F.sort_array(F.collect_list(by)), lambda x: x["token"])
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(tok(F.struct("pos", "token")).alias("a"), tok(F.struct("token", "pos")).alias("b"))
    return M.word_error_totals(s, "a", "b").select("dist", "ref_tokens", F.round(F.col("dist") / F.col("ref_tokens"), 6).alias("rate"))


@query("WITH " + SQL_VEC + ", e AS (SELECT unnest(range(64)) AS i, unnest(vec) AS x FROM vec), m AS (SELECT i, avg(x) AS m FROM e GROUP BY 1), v AS (SELECT sum((x - m) * (x - m)) / (3.0 * count(*)) AS v FROM e JOIN m USING (i)) SELECT CAST(i AS BIGINT) AS i, round(m, 6) AS mean, round(v, 6) AS variance FROM m, v")
def a27_pooled_prior(spark: Spark, d: str) -> DataFrame:
    """Global mean per dimension, pooled variance over all with c = 3."""
    e = C.vectors(spark, d).select(F.posexplode("vec").alias("i", "x"))
    m = e.groupBy("i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("_v"), F.count(F.lit(1)).alias("_n"))
    v = m.agg((F.sum(F.col("_v") * F.col("_n")) / (3.0 * F.sum("_n"))).alias("variance"))
    return rounded(m.select("i", "mean").crossJoin(F.broadcast(v)), "mean", "variance")


@query(SQL_RUNS + """, b AS (SELECT pair_index, start, "end" FROM runs), g AS (SELECT pair_index, start, "end" FROM gruns), h AS (SELECT count(*) AS hit FROM b JOIN g USING (pair_index, start, "end"))
SELECT hit, (SELECT count(*) FROM b) AS n_pred, (SELECT count(*) FROM g) AS n_gold FROM h""")
def a29_token_scores(spark: Spark, d: str) -> DataFrame:
    """Segments found with both ends exactly right, and totals."""
    p, g = (r.select(PAIR, "start", "end") for r in both_runs(spark, d))
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(p.join(g, [PAIR, "start", "end"]), "hit").crossJoin(n(p, "n_pred")).crossJoin(n(g, "n_gold"))


SQL_TEXTS = SQL_RUNS + """, ft AS (SELECT r.pair_index, r.start, r."end", r.pred AS cls, string_agg(ev.token, ' ' ORDER BY ev.pos) AS text FROM runs r JOIN ev ON ev.pair_index = r.pair_index AND ev.pos >= r.start AND ev.pos < r."end" GROUP BY 1, 2, 3, 4),
gt AS (SELECT r.pair_index, r.start, r."end", string_agg(ev.token, ' ' ORDER BY ev.pos) AS text FROM gruns r JOIN ev ON ev.pair_index = r.pair_index AND ev.pos >= r.start AND ev.pos < r."end" GROUP BY 1, 2, 3)"""
SQL_PRF = "SELECT round(hit / found, 9) AS precision, round(hit / gold, 9) AS recall, round(2 * (hit / found) * (hit / gold) / (hit / found + hit / gold), 9) AS f1 FROM n"


def _texts(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Discovered runs with their class, gold runs, both with the tokens they hold."""
    ev, (p, g) = C.event_tokens(spark, d), both_runs(spark, d)
    return M.transcribed(p.select(PAIR, "start", "end", F.col("pred").alias("cls")), ev), M.transcribed(g.select(PAIR, "start", "end"), ev)


@query(SQL_TEXTS + """, o AS (SELECT *, row_number() OVER (ORDER BY pair_index, start) AS i FROM ft), c AS (SELECT count(*) AS found, count(*) FILTER (a.text = b.text) AS hit FROM o a JOIN o b ON a.cls = b.cls AND a.i < b.i),
n AS (SELECT hit, found, (SELECT count(*) FROM o a JOIN o b ON a.text = b.text AND a.i < b.i) AS gold FROM c) """ + SQL_PRF)
def a29_grouping(spark: Spark, d: str) -> DataFrame:
    return rounded(M.grouping_prf(_texts(spark, d)[0]), "precision", "recall", "f1", n=9)


@query(SQL_RUNS + """, f AS (SELECT pair_index, start AS e FROM runs UNION SELECT pair_index, "end" FROM runs), g AS (SELECT pair_index, start AS e FROM gruns UNION SELECT pair_index, "end" FROM gruns),
n AS (SELECT (SELECT count(*) FROM f JOIN g USING (pair_index, e)) AS hit, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold) """ + SQL_PRF)
def a29_boundary(spark: Spark, d: str) -> DataFrame:
    return rounded(M.edge_prf(*both_runs(spark, d)), "precision", "recall", "f1", n=9)


@query(SQL_TEXTS + """, f AS (SELECT DISTINCT text FROM ft), g AS (SELECT DISTINCT text FROM gt), n AS (SELECT (SELECT count(*) FROM f JOIN g USING (text)) AS hit, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold) """ + SQL_PRF)
def a29_type(spark: Spark, d: str) -> DataFrame:
    return rounded(M.type_prf(*_texts(spark, d)), "precision", "recall", "f1", n=9)


@query("SELECT p_brand AS phone, CAST(l_linenumber AS BIGINT) AS slot, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var FROM (SELECT CASE WHEN n >= 100 THEN p_brand ELSE '<rare>' END AS p_brand, l_linenumber, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY 1, 2")
def m25_segment_model(spark: Spark, d: str) -> DataFrame:
    g = fit_segment_model(C.lines(spark, d), "p_brand", "l_linenumber", "l_quantity", least=100)
    return rounded(g, "mean", "var")


@query("WITH " + SQL_MEANS + ", s AS (SELECT vec_id, e.label, mv.label AS cls, sum(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v)) AS l FROM e JOIN mv ON e.i = mv.i GROUP BY 1, 2, 3), b AS (SELECT vec_id, label, arg_max(cls, round(l, 6)) AS best FROM s GROUP BY 1, 2) SELECT label, round(avg(CASE WHEN best = label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b GROUP BY 1")
def m25_segment_predict(spark: Spark, d: str) -> DataFrame:
    from threadloom.functions.numeric import gaussian_log

    from .relational import class_gaussians

    v = C.vectors(spark, d).select("vec_id", "label", "vec").crossJoin(F.broadcast(class_gaussians(spark, d)))
    s = v.select("vec_id", "label", "cls", F.round(gaussian_log(F.col("vec"), F.col("mean"), F.col("var")), 6).alias("l"))
    b = s.groupBy("vec_id", "label").agg(F.max_by("cls", "l").alias("best"))
    return b.groupBy("label").agg(F.round(F.avg((F.col("best") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("WITH " + SQL_EV + "SELECT round(sum(-ln(greatest(value / (value + 10), 1e-30)) * CASE WHEN pred <> 0 THEN 1 ELSE 0 END) / sum(CASE WHEN pred <> 0 THEN 1 ELSE 0 END), 6) AS loss FROM ev")
def a28_masked_cross_entropy(spark: Spark, d: str) -> DataFrame:
    e = C.event_tokens(spark, d).withColumns({"p": F.col("value") / (F.col("value") + 10), "m": (F.col("pred") != 0).cast("int")})
    return rounded(M.masked_cross_entropy(e, "p", "m"), "loss")


@query("WITH " + SQL_EV + "SELECT round(avg(greatest(w - value / 100 + 1, 0)), 6) AS loss FROM (SELECT value, lead(value) OVER (PARTITION BY pair_index ORDER BY pos) / 100 AS w FROM ev) WHERE w IS NOT NULL")
def a28_margin_rank_loss(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy(PAIR).orderBy("pos")
    e = C.event_tokens(spark, d).select((F.col("value") / 100).alias("t"), (F.lead("value").over(w) / 100).alias("w")).where("w is not null")
    return rounded(M.margin_rank_loss(e, "t", "w"), "loss")


@query(SQL_RUNS + """ SELECT round((SELECT sum("end" - start) FROM runs WHERE pred > 0) / (SELECT count(*) FROM ev), 6) AS coverage""")
def a29_coverage(spark: Spark, d: str) -> DataFrame:
    n = C.event_tokens(spark, d).groupBy(PAIR).agg(F.count(F.lit(1)).alias("n"))
    return rounded(M.coverage(both_runs(spark, d)[0].where("pred > 0"), n), "coverage")


@query("WITH " + SQL_SRC + """, s AS (SELECT pair_index, string_agg(chr(CAST(64 + CAST(replace(token, 'Brand#', '') AS INT) AS INT)), '' ORDER BY pos) AS a FROM src GROUP BY 1) SELECT round(avg(levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a))), 6) AS ned FROM s x JOIN s y ON y.pair_index = x.pair_index + 1""")
def a29_normalised_edit_distance(spark: Spark, d: str) -> DataFrame:
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("a"))
    return rounded(M.normalised_edit_distance(s.join(s.select((F.col(PAIR) - 1).alias(PAIR), F.col("a").alias("b")), PAIR), "a", "b"), "ned")
