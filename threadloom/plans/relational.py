"""Queries of encoders, filters, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import numeric as N
from threadloom.operators import cepstra
from threadloom.operators import encode as E
from threadloom.operators import retrieval as R
from threadloom.operators import segments as S

from . import corpora as C
from .corpora import SQL_EV, SQL_SRC, SQL_TRG, SQL_TXT, SQL_VEC, SQL_WORDS
from .registry import query

Spark = SparkSession
PAIR = "pair_index"

SQL_PRED_RUNS = """chg AS (SELECT *, CASE WHEN pred IS DISTINCT FROM lag(pred) OVER w OR pos = 0 THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY pair_index ORDER BY pos)),
seg AS (SELECT *, CAST(sum(c) OVER (PARTITION BY pair_index ORDER BY pos) - 1 AS BIGINT) AS seg FROM chg),
runs AS (SELECT pair_index, seg, min(pos) AS start, max(pos) + 1 AS "end", min(pred) AS pred FROM seg GROUP BY 1, 2)"""


# vocabulary and encoding


@query("WITH " + SQL_WORDS + """, f AS (SELECT token, min((pair_index, pos)) AS seen FROM words GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY seen) - 1 AS BIGINT) AS token_id FROM f""")
def p01_vocab_first_seen(spark: Spark, d: str) -> DataFrame:
    return E.vocabulary(C.text_words(spark, d))


@query("WITH " + SQL_SRC + "SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS token_id FROM (SELECT DISTINCT token FROM src)")
def p01_vocab_sorted(spark: Spark, d: str) -> DataFrame:
    return E.vocabulary(C.src_tokens(spark, d), order="sorted")


@query("WITH " + SQL_EV + "SELECT event_id, CAST(k AS BIGINT) AS k, CAST(CASE WHEN k = gold THEN 1 ELSE 0 END AS BIGINT) AS hot FROM ev, range(5) r(k)")
def p02_one_hot(spark: Spark, d: str) -> DataFrame:
    return C.event_tokens(spark, d).select("event_id", F.posexplode(E.one_hot(F.col("gold"), 5)).alias("k", "hot"))


@query("WITH " + SQL_VEC + "SELECT vec_id, round(list_aggregate(list_transform(vec, lambda x: x * x), 'sum') / list_aggregate(list_transform(vec, lambda x: x * x), 'sum'), 6) AS norm, round(vec[1] / sqrt(list_aggregate(list_transform(vec, lambda x: x * x), 'sum')), 6) AS first FROM vec")
def p03_l2_normalise(spark: Spark, d: str) -> DataFrame:
    v = C.vectors(spark, d).select("vec_id", N.l2_normalise(F.col("vec")).alias("v"))
    return v.select("vec_id", F.round(N.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.get("v", 0), 6).alias("first"))


@query("WITH " + SQL_TRG + "SELECT pair_index, pos + 1 AS pos, concept FROM trg UNION ALL SELECT DISTINCT pair_index, CAST(0 AS BIGINT), 'NULL' FROM trg")
def p04_prepend_null(spark: Spark, d: str) -> DataFrame:
    return E.prepend_null(C.trg_tokens(spark, d))


@query("WITH " + SQL_EV + """SELECT pair_index, pos, round(coalesce(lag(value) OVER w, 0), 6) AS a, round(value, 6) AS b, round(coalesce(lead(value) OVER w, 0), 6) AS c
FROM ev WINDOW w AS (PARTITION BY pair_index ORDER BY pos)""")
def p05_stack_context(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d).select(PAIR, "pos", F.array("value").alias("vec"))
    v = E.stack_context(ev, "vec", 1, 1)
    return v.select(PAIR, "pos", *[F.round(F.get("vec", i), 6).alias(c) for i, c in enumerate("abc")])


@query("WITH " + SQL_EV + "SELECT pair_index, count(*) AS n FROM ev WHERE pos < 20 GROUP BY 1")
def p06_truncate(spark: Spark, d: str) -> DataFrame:
    """The operator keeps the first N frames of a pair; here N = 20."""
    seq = C.event_tokens(spark, d).groupBy(PAIR).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return seq.select(PAIR, F.size(F.slice("v", 1, 20)).alias("n"))


@query("WITH " + SQL_EV + "SELECT pair_index, pos, round(value - 0.97 * coalesce(lag(value) OVER (PARTITION BY pair_index ORDER BY pos), 0), 6) AS value FROM ev")
def p07_preemphasis(spark: Spark, d: str) -> DataFrame:
    return E.preemphasis(C.event_tokens(spark, d).select(PAIR, "pos", "value"), "value").withColumn("value", F.round("value", 6))

#: Small frames for signals of 320 samples: five vectors of 64 values.
SIGNAL = cepstra.Settings(rate=3200, window=80, hop=32, n_mels=12, n_cepstra=6)


def sql_cepstra() -> str:
    """``ce``: cepstra c of frame f, then slopes ``d1`` and ``d2``."""
    hz = "(700 * (pow(10, (i * 2595 * log10(1 + 1600 / 700.0) / 13) / 2595) - 1))"
    slope = lambda src: f"SELECT pair_index, f, c, sum(w * v) / 10 AS v FROM (SELECT a.pair_index, a.f, a.c, o AS w, b.v FROM {src} a JOIN (SELECT pair_index, max(f) AS top FROM {src} GROUP BY 1) USING (pair_index), (SELECT unnest([-2, -1, 1, 2]) AS o) JOIN {src} b ON b.pair_index = a.pair_index AND b.c = a.c AND b.f = least(greatest(a.f + o, 0), top)) GROUP BY 1, 2, 3"
    return "WITH " + SQL_VEC + f""", sg AS (SELECT pair_index, pos * 64 + i AS t, vec[i + 1] AS v, max(pos) OVER (PARTITION BY pair_index) * 64 + 64 AS size FROM vec, (SELECT unnest(range(64)) AS i)),
em AS (SELECT pair_index, t, size, v - 0.97 * coalesce(lag(v) OVER (PARTITION BY pair_index ORDER BY t), 0) AS v FROM sg),
fr AS (SELECT pair_index, f, t - 32 * f AS n, v * (0.54 - 0.46 * cos(2 * pi() * (t - 32 * f) / 79)) AS v FROM em, (SELECT unnest(range(8)) AS f) WHERE t >= 32 * f AND t < 32 * f + 80 AND (32 * f + 80 <= size OR f = 0)),
po AS (SELECT pair_index, f, b, (pow(sum(v * cos(2 * pi() * b * n / 128)), 2) + pow(sum(v * sin(2 * pi() * b * n / 128)), 2)) / 128 AS p FROM fr, (SELECT unnest(range(65)) AS b) GROUP BY 1, 2, 3),
hz AS (SELECT i, {hz} AS h FROM (SELECT unnest(range(14)) AS i)),
ml AS (SELECT b, m.i - 1 AS k, greatest(0, least((b * 25.0 - l.h) / (m.h - l.h), (r.h - b * 25.0) / (r.h - m.h))) AS w FROM (SELECT unnest(range(65)) AS b), hz m JOIN hz l ON l.i = m.i - 1 JOIN hz r ON r.i = m.i + 1),
lm AS (SELECT pair_index, f, k, ln(greatest(sum(p * w), 1e-10)) AS l FROM po JOIN ml USING (b) GROUP BY 1, 2, 3),
ce AS (SELECT pair_index, f, c, sum(l * cos(pi() * c * (2 * k + 1) / 24)) * sqrt(2 / 12.0) * CASE c WHEN 0 THEN sqrt(0.5) ELSE 1 END AS v FROM lm, (SELECT unnest(range(6)) AS c) GROUP BY 1, 2, 3),
d1 AS ({slope("ce")}), d2 AS ({slope("d1")})"""


@query(sql_cepstra() + " SELECT pair_index, CAST(f AS BIGINT) AS pos, CAST(c + 6 * o AS BIGINT) AS i, round(v, 5) AS x FROM (SELECT *, 0 AS o FROM ce UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2)")
def p08_cepstra(spark: Spark, d: str) -> DataFrame:
    """Cepstra with slopes of signals: the vectors of a pair in a row."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda t: t["vec"]))
    made = cepstra.cepstra(C.vectors(spark, d).groupBy(PAIR).agg(whole.alias("signal")), "signal", SIGNAL)
    cells = made.select(PAIR, F.posexplode("frames").alias("pos", "v")).select(PAIR, "pos", F.posexplode("v").alias("i", "x"))
    return cells.withColumn("x", F.round("x", 5))


@query("""WITH s AS (SELECT p_brand AS b, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, count(*) AS n, round(sum(((l_quantity - m) / sqrt(greatest(v, 1e-12))) ^ 2) / count(*), 6) AS variance FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON b = p_brand GROUP BY 1""")
def p09_cmvn(spark: Spark, d: str) -> DataFrame:
    x = E.normalise_by(C.lines(spark, d).select("p_brand", "l_quantity"), "l_quantity", ["p_brand"])
    return x.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")) / F.count(F.lit(1)), 6).alias("variance"))


@query("WITH " + SQL_EV + """, s AS (SELECT pair_index, avg(value) AS m, var_pop(value) AS v FROM ev GROUP BY 1)
SELECT pair_index, pos, round((value - m) / sqrt(greatest(v, 1e-12)), 5) AS value FROM ev JOIN s USING (pair_index)""")
def p10_utterance_norm(spark: Spark, d: str) -> DataFrame:
    return E.normalise_by(C.event_tokens(spark, d).select(PAIR, "pos", "value"), "value", [PAIR]).select(PAIR, "pos", F.round("value", 5).alias("value"))


@query("WITH " + SQL_SRC + """, s AS (SELECT pair_index, list(token ORDER BY pos) AS t, count(*) AS n FROM src GROUP BY 1)
SELECT pair_index, array_to_string(list_concat(t, ['-', '-', '-', '-', '-', '-'])[1:6], ' ') AS right_pad,
array_to_string(list_concat(list_concat(['-', '-', '-'][1:greatest(6 - n, 0) // 2], t), ['-', '-', '-', '-', '-', '-'])[1:6], ' ') AS centred FROM s""")
def p11_pad(spark: Spark, d: str) -> DataFrame:
    t = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(t.alias("t"))
    return s.select(PAIR, F.array_join(N.pad(F.col("t"), 6, zero="-"), " ").alias("right_pad"), F.array_join(N.pad(F.col("t"), 6, True, "-"), " ").alias("centred"))


@query("WITH " + SQL_VEC + """SELECT vec_id, CAST(i AS BIGINT) AS i, round(list_avg(vec[i * 8 + 1 : i * 8 + 8]), 6) AS block,
round(vec[CAST(floor(i * 9.0) AS INT) + 1], 6) AS point FROM vec, range(8) r(i)""")
def p12_embed_segment(spark: Spark, d: str) -> DataFrame:
    v = C.vectors(spark, d)
    both = F.arrays_zip(N.block_mean(F.col("vec"), 8).alias("block"), N.interpolate(F.col("vec"), 8).alias("point"))
    return v.select("vec_id", F.posexplode(both).alias("i", "x")).select("vec_id", "i", F.round("x.block", 6).alias("block"), F.round("x.point", 6).alias("point"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]$', '') AS stripped FROM part")
def p13_strip_stress(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "part").select("p_partkey", E.strip_stress(F.col("p_brand")).alias("stripped"))


@query("WITH " + SQL_WORDS + """, lex AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n]+')) AS word FROM benchmark)
SELECT pair_index, count(*) FILTER (word IS NULL) AS unknown, count(*) AS n FROM words LEFT JOIN lex ON token = word GROUP BY 1""")
def p14_lexicon(spark: Spark, d: str) -> DataFrame:
    words = C.table(spark, d, "benchmark").select(F.explode(F.split("text", "[ \\t\\n]+")).alias("word")).distinct()
    lex = words.select("word", F.split("word", "").alias("phones"))
    j = E.lexicon_lookup(C.text_words(spark, d), lex)
    return j.groupBy(PAIR).agg(F.sum((F.get("phones", 0) == "UNK").cast("long")).alias("unknown"), F.count(F.lit(1)).alias("n"))


@query("WITH " + SQL_VEC + """, c AS (SELECT pair_index, label, round(vec[1], 6) AS sim, pos FROM vec)
SELECT pair_index, arg_max(label, (sim, -pos)) AS concept FROM c GROUP BY 1 HAVING max(sim) >= 0""")
def p15_concept_by_similarity(spark: Spark, d: str) -> DataFrame:
    """Best concept of each noun from a similarity table, if above a threshold."""
    c = C.vectors(spark, d).select(PAIR, "label", F.round(F.get("vec", 0), 6).alias("sim"), "pos")
    return c.groupBy(PAIR).agg(F.max_by("label", F.struct("sim", -F.col("pos"))).alias("concept"), F.max("sim").alias("top")).where("top >= 0").drop("top")


@query("WITH " + SQL_EV + """, w AS (SELECT *, token || ' ' || lead(token) OVER (PARTITION BY pair_index ORDER BY pos) AS two FROM ev),
syn(concept, form) AS (VALUES ('buy', 'purchase'), ('look', 'view'), ('look', 'click'), ('join', 'signup purchase'), ('fail', 'error error'))
SELECT pair_index, concept, min(pos) AS pos FROM w JOIN syn ON token = form OR two = form GROUP BY 1, 2""")
def p16_first_occurrence(spark: Spark, d: str) -> DataFrame:
    syn = spark.sql("SELECT * FROM VALUES ('buy', 'purchase'), ('look', 'view'), ('look', 'click'), ('join', 'signup purchase'), ('fail', 'error error') AS t(concept, form)")
    return E.first_occurrence(C.event_tokens(spark, d), F.broadcast(syn))


@query("WITH " + SQL_TXT + """, s AS (SELECT pair_index, array_to_string(list_filter(string_split_regex(source, '[ \\t\\n]+'), lambda x: x <> ''), ' ') AS j FROM txt)
SELECT pair_index, CAST(CASE WHEN strpos(j, 'the ') = 0 THEN -1 ELSE length(j[1:strpos(j, 'the ') - 1]) - length(replace(j[1:strpos(j, 'the ') - 1], ' ', '')) END AS BIGINT) AS at FROM s""")
def p18_phrase_start(spark: Spark, d: str) -> DataFrame:
    t = C.text_pairs(spark, d)
    return t.select(PAIR, E.phrase_start(C.split_words(F.col("source")), F.lit("the ")).alias("at"))


@query("WITH " + SQL_EV + ", " + SQL_PRED_RUNS + ", g AS (SELECT s.pair_index, s.seg, string_agg(token, ' ' ORDER BY pos) AS phrase FROM seg s GROUP BY 1, 2) SELECT pair_index, seg, phrase FROM g")
def p19_group_phrases(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    runs = S.run_segments(ev, "pred")
    j = runs.join(ev.select(F.col(PAIR).alias("k"), "pos", "token"), (F.col(PAIR) == F.col("k")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return j.groupBy(PAIR, "seg").agg(F.array_join(words, " ").alias("phrase"))


@query("SELECT event_id, CAST(trunc(value * 16000) AS BIGINT) AS sample, CAST(floor(trunc(value * 16000) / 160) AS BIGINT) AS frame FROM events")
def p20_time_units(spark: Spark, d: str) -> DataFrame:
    s = E.to_samples(F.col("value"), 16000)
    return C.table(spark, d, "events").select("event_id", s.alias("sample"), E.to_frames(s, 160).alias("frame"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS suffix FROM customer")
def p21_numeric_suffix(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "customer").select("c_custkey", E.numeric_suffix(F.col("c_name"), "[^0-9]+").alias("suffix"))


@query("WITH " + SQL_EV + "SELECT event_id, token || ' -> ' || CAST(pred AS VARCHAR) AS line FROM ev")
def p22_pretty(spark: Spark, d: str) -> DataFrame:
    return C.event_tokens(spark, d).select("event_id", E.pretty_alignment(F.col("token"), F.col("pred").cast("string")).alias("line"))


@query("WITH " + SQL_VEC + """, l AS (SELECT *, list_max(vec) AS m FROM vec), o AS (SELECT vec_id, m + ln(list_sum(list_transform(vec, lambda x: exp(x - m)))) AS lse FROM l)
SELECT vec_id, round(lse, 6) AS lse, round(exp(vec[1] - lse), 6) AS softmax_first FROM o JOIN vec USING (vec_id)""")
def p23_logsumexp(spark: Spark, d: str) -> DataFrame:
    v = F.col("vec")
    return C.vectors(spark, d).select("vec_id", F.round(N.logsumexp(v), 6).alias("lse"), F.round(F.get(N.softmax(v), 0), 6).alias("softmax_first"))


@query("WITH " + SQL_VEC + """, p AS (SELECT a.vec_id, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + z[2]) AS s FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))), 6) AS log_dot FROM p""")
def p24_log_dot(spark: Spark, d: str) -> DataFrame:
    v = C.vectors(spark, d).select("vec_id", "vec")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return v.join(n, "vec_id").select("vec_id", F.round(N.log_dot(F.col("vec"), F.col("other")), 6).alias("log_dot"))


SQL_MEANS = SQL_VEC + """, e AS (SELECT vec_id, label, CAST(unnest(range(64)) AS BIGINT) AS i, unnest(vec) AS x FROM vec), mv AS (SELECT label, i, avg(x) AS m, greatest(var_pop(x), 1e-6) AS v FROM e GROUP BY 1, 2)"""


def class_gaussians(spark: Spark, d: str) -> DataFrame:
    e = C.vectors(spark, d).select("label", F.posexplode("vec").alias("i", "x"))
    g = e.groupBy("label", "i").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(1e-6)).alias("v"))
    s = g.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m", "v"))).alias("s"))
    return s.select(F.col("label").alias("cls"), F.transform("s", lambda x: x["m"]).alias("mean"), F.transform("s", lambda x: x["v"]).alias("var"))


@query("WITH " + SQL_MEANS + "SELECT vec_id, mv.label AS cls, round(sum(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v)), 4) AS log_density FROM e JOIN mv ON e.i = mv.i GROUP BY 1, 2")
def p25_gaussian(spark: Spark, d: str) -> DataFrame:
    v = C.vectors(spark, d).select("vec_id", "vec").crossJoin(F.broadcast(class_gaussians(spark, d)))  # a row per class
    return v.select("vec_id", "cls", F.round(N.gaussian_log(F.col("vec"), F.col("mean"), F.col("var")), 4).alias("log_density"))


@query("WITH " + SQL_MEANS + """, g AS (SELECT vec_id, mv.label AS cls, sum(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v)) AS l FROM e JOIN mv ON e.i = mv.i GROUP BY 1, 2)
SELECT vec_id, round(max(l) + ln(sum(exp(l - mx))) - ln(10), 4) AS log_mixture FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM g) GROUP BY vec_id""")
def p26_mixture(spark: Spark, d: str) -> DataFrame:
    v = C.vectors(spark, d).select("vec_id", "vec").crossJoin(F.broadcast(class_gaussians(spark, d)))
    s = v.groupBy("vec_id").agg(F.collect_list(N.gaussian_log(F.col("vec"), F.col("mean"), F.col("var"))).alias("l"))
    return s.select("vec_id", F.round(N.logsumexp(F.col("l")) - F.log(F.lit(10.0)), 4).alias("log_mixture"))


@query("WITH " + SQL_MEANS + """SELECT a.label AS p, b.label AS q, round(0.5 * sum(a.v / b.v - 1 - ln(a.v / b.v) + (a.m - b.m) * (a.m - b.m) / b.v), 5) AS kl FROM mv a JOIN mv b USING (i) GROUP BY 1, 2""")
def p27_kl(spark: Spark, d: str) -> DataFrame:
    g = class_gaussians(spark, d)
    o = g.select(F.col("cls").alias("q"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    return g.crossJoin(F.broadcast(o)).select(F.col("cls").alias("p"), "q", F.round(N.kl_gaussian(F.col("mean"), F.col("var"), F.col("m1"), F.col("v1")), 5).alias("kl"))


@query("WITH " + SQL_SRC + """, c AS (SELECT token, count(*) AS n FROM src GROUP BY 1), k AS (SELECT token, row_number() OVER (ORDER BY token) AS i, n / (sum(n) OVER () * 0.3) AS v FROM c)
SELECT token, round(v * coalesce(exp(sum(ln(1 - v)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 6) AS weight FROM k""")
def p28_stick_breaking(spark: Spark, d: str) -> DataFrame:
    c = C.src_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.sort_array(F.collect_list(F.struct("token", "n"))).alias("s"), F.sum("n").alias("t"))  # the brands
    v = F.transform("s", lambda x: x["n"] / (F.col("t") * 0.3))
    z = F.arrays_zip(F.transform("s", lambda x: x["token"]).alias("token"), N.stick_breaking(v).alias("w"))
    return s.select(F.inline(z)).select("token", F.round("w", 6).alias("weight"))


@query("WITH " + SQL_VEC + "SELECT label, round(sum(x), 4) AS total, round(sum(ln(abs(x) + 1)), 4) AS log_total, round(sum(x * x), 4) AS squares FROM (SELECT label, unnest(vec) AS x FROM vec) GROUP BY 1")
def p31_sums(spark: Spark, d: str) -> DataFrame:
    e = C.vectors(spark, d).select("label", F.explode("vec").alias("x"))
    return e.groupBy("label").agg(F.round(F.sum("x"), 4).alias("total"), F.round(F.sum(F.log(F.abs("x") + 1)), 4).alias("log_total"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("squares"))


@query("WITH " + SQL_VEC + """, z AS (SELECT vec_id, [vec[1] + 2 * vec[2] + 0.1, vec[3] - vec[4] - 0.2, 0.5 * vec[5]] AS s FROM vec)
SELECT vec_id, CAST(k AS BIGINT) AS k, round(exp(s[k + 1]) / (exp(s[1]) + exp(s[2]) + exp(s[3])), 6) AS p, round(greatest(s[k + 1], 0), 6) AS hidden FROM z, range(3) r(k)""")
def p32_softmax_layer(spark: Spark, d: str) -> DataFrame:
    weights = [[1, 2, 0, 0, 0, 0.1], [0, 0, 1, -1, 0, -0.2], [0, 0, 0, 0, 0.5, 0]]
    z = N.linear(F.slice("vec", 1, 5), weights)
    both = N.let(z, lambda s: F.arrays_zip(N.softmax(s).alias("p"), N.relu(s).alias("h")))
    return C.vectors(spark, d).select("vec_id", F.posexplode(both).alias("k", "x")).select("vec_id", "k", F.round("x.p", 6).alias("p"), F.round("x.h", 6).alias("hidden"))


@query("WITH " + SQL_SRC + """, s AS (SELECT pair_index, string_agg(chr(CAST(64 + CAST(replace(token, 'Brand#', '') AS INT) AS INT)), '' ORDER BY pos) AS a, string_agg(chr(CAST(64 + CAST(replace(token, 'Brand#', '') AS INT) AS INT)), '' ORDER BY token, pos) AS b FROM src GROUP BY 1)
SELECT pair_index, levenshtein(a, b) AS dist FROM s""")
def p33_edit_distance(spark: Spark, d: str) -> DataFrame:
    tok = lambda by: F.transform(F.sort_array(F.collect_list(by)), lambda x: x["token"])
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(tok(F.struct("pos", "token")).alias("a"), tok(F.struct("token", "pos")).alias("b"))
    return s.select(PAIR, N.edit_counts(F.col("a"), F.col("b"))["dist"].alias("dist"))


@query("WITH " + SQL_VEC + """, f AS (SELECT vec_id, CAST(i AS BIGINT) AS t, vec[i * 4 + 1 : i * 4 + 4] AS x FROM vec, range(16) r(i)), b AS (SELECT vec_id, t, list_position(x, list_max(x)) - 1 AS k FROM f),
c AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS p FROM b) SELECT vec_id, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY t) AS path FROM c WHERE (p IS NULL OR p <> k) AND k <> 0 GROUP BY 1""")
def p34_ctc_greedy(spark: Spark, d: str) -> DataFrame:
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vec", i * 4 + 1, 4))
    v = C.vectors(spark, d).select("vec_id", N.ctc_greedy(frames).alias("p")).where(F.size("p") > 0)
    return v.select("vec_id", F.array_join(F.col("p").cast("array<string>"), " ").alias("path"))


@query("WITH " + SQL_EV + ", c AS (SELECT *, lag(pred) OVER (PARTITION BY pair_index ORDER BY pos) AS p FROM ev) SELECT pair_index, string_agg(CAST(pred AS VARCHAR), ' ' ORDER BY pos) AS merged FROM c WHERE p IS NULL OR p <> pred GROUP BY 1")
def p35_merge_repeats(spark: Spark, d: str) -> DataFrame:
    s = C.event_tokens(spark, d).groupBy(PAIR).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pred"))), lambda x: x["pred"]).alias("v"))
    return s.select(PAIR, F.array_join(N.merge_repeats(F.col("v")).cast("array<string>"), " ").alias("merged"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS s, l_quantity + 10 AS e, 20.0 AS s2, 35.0 AS e2 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(CASE WHEN least(e, e2) - greatest(s, s2) <= 0 THEN 0 ELSE (least(e, e2) - greatest(s, s2)) / (greatest(e, e2) - least(s, s2)) END, 6) AS iou FROM a""")
def p36_iou(spark: Spark, d: str) -> DataFrame:
    li = C.table(spark, d, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(N.iou(q, q + 10, F.lit(20.0), F.lit(35.0)), 6).alias("iou"))


@query("""SELECT p_partkey, lower(p_type) AS low, replace(p_name, ' ', '_') AS joined, length(trim(p_name)) AS n, starts_with(p_name, 'small') AS pre, ends_with(p_name, 'ring') AS suf, strpos(p_name, 'e') AS at, len(string_split(p_name, ' ')) AS words FROM part""")
def p37_strings(spark: Spark, d: str) -> DataFrame:
    n = F.col("p_name")
    return C.table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("low"), F.replace(n, F.lit(" "), F.lit("_")).alias("joined"), F.length(F.trim(n)).alias("n"), n.startswith("small").alias("pre"), n.endswith("ring").alias("suf"), F.locate("e", n).alias("at"), F.size(F.split(n, " ")).alias("words"))


@query("""SELECT event_id, round(ln(value), 6) AS l, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS r, round(pow(value, 1.5), 4) AS p, CAST(floor(value) AS BIGINT) AS f, round(least(greatest(value, 1), 100), 6) AS c, CAST(sign(value - 10) AS DOUBLE) AS s, CAST(trunc(-value) AS BIGINT) AS t FROM events""")
def p38_math(spark: Spark, d: str) -> DataFrame:
    """Logarithms of 0 and below are -Infinity and NaN, as in numpy (Spark's are
    null); results are rounded in binary, as the SQL states."""
    v = F.col("value")
    log = F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(N.round_binary(F.log(v), 6))
    r = N.round_binary
    return C.table(spark, d, "events").select("event_id", log.alias("l"), r(F.exp(-v / 100), 6).alias("e"), r(F.sqrt(v), 6).alias("r"), r(F.pow(v, F.lit(1.5)), 4).alias("p"), F.floor(v).alias("f"), r(F.least(F.greatest(v, F.lit(1.0)), F.lit(100.0)), 6).alias("c"), F.signum(v - 10).alias("s"), (-v).cast("long").alias("t"))


@query("WITH " + SQL_SRC + """, s AS (SELECT pair_index, list(token ORDER BY pos) AS t FROM src GROUP BY 1)
SELECT pair_index, array_to_string(list_reverse(t), ',') AS rev, array_to_string(list_sort(list_distinct(t)), ',') AS uniq, CAST(len(list_concat(t, t)) AS BIGINT) AS twice, list_contains(t, 'Brand#1') AS has, array_to_string(t[1:2], ',') AS head FROM s""")
def p39_arrays(spark: Spark, d: str) -> DataFrame:
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("t"))
    j = lambda c: F.array_join(c, ",")
    return s.select(PAIR, j(F.reverse("t")).alias("rev"), j(F.array_sort(F.array_distinct("t"))).alias("uniq"), F.size(F.concat("t", "t")).alias("twice"), F.array_contains("t", "Brand#1").alias("has"), j(F.slice("t", 1, 2)).alias("head"))


@query("WITH " + SQL_EV + """, c AS (SELECT pair_index, token, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT pair_index, CAST(coalesce(max(n) FILTER (token = 'view'), 0) AS BIGINT) AS views, arg_max(token, (n, token)) AS top, count(*) AS kinds FROM c GROUP BY 1""")
def p40_maps(spark: Spark, d: str) -> DataFrame:
    c = C.event_tokens(spark, d).groupBy(PAIR, "token").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy(PAIR).agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("m"))
    top = F.element_at(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("t")))), -1)["t"]
    return m.select(PAIR, F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"), top.alias("top"), F.size(F.map_keys("m")).alias("kinds"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p41_json(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# filters and splits


@query("WITH " + SQL_EV + "SELECT pair_index, CAST(row_number() OVER (PARTITION BY pair_index ORDER BY pos) - 1 AS BIGINT) AS pos, token, pred - 1 AS alignment FROM ev WHERE pred <> 0")
def f01_remove_nulls(spark: Spark, d: str) -> DataFrame:
    return E.drop_null_aligned(C.event_tokens(spark, d).withColumnRenamed("pred", "alignment"))


@query("WITH " + SQL_TRG + ", top AS (SELECT concept FROM trg GROUP BY 1 ORDER BY count(*) DESC, concept LIMIT 3) SELECT pair_index, CAST(row_number() OVER (PARTITION BY pair_index ORDER BY pos) - 1 AS BIGINT) AS pos, concept FROM trg WHERE concept IN (FROM top)")
def f02_top_k_concepts(spark: Spark, d: str) -> DataFrame:
    return E.keep_top_concepts(C.trg_tokens(spark, d), 3)


@query("WITH " + SQL_WORDS + "SELECT pair_index, count(*) AS n FROM words WHERE token NOT IN ('the', 'of', '|') GROUP BY 1")
def f03_drop_tokens(spark: Spark, d: str) -> DataFrame:
    return C.text_words(spark, d).where(~F.col("token").isin("the", "of", "|")).groupBy(PAIR).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def f04_drop_class(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "documents").where("lang <> 'en'").select("doc_id", "lang")


@query("WITH " + SQL_WORDS + "SELECT token, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 5")
def f05_min_frequency(spark: Spark, d: str) -> DataFrame:
    return E.at_least(C.text_words(spark, d), "token", 5)


@query("WITH " + SQL_SRC + "SELECT pair_index, count(*) AS n FROM src GROUP BY 1 HAVING count(*) <= 5")
def f06_drop_long(spark: Spark, d: str) -> DataFrame:
    return C.src_tokens(spark, d).groupBy(PAIR).agg(F.count(F.lit(1)).alias("n")).where("n <= 5")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def f07_split_by_ids(spark: Spark, d: str) -> DataFrame:
    a, b = E.split_by_ids(C.table(spark, d, "documents").select("doc_id"), C.table(spark, d, "labels"), "doc_id")
    return a.withColumn("labelled", F.lit(True)).unionByName(b.withColumn("labelled", F.lit(False)))


@query("SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 >= 1 AS is_train FROM orders")
def f08_hash_split(spark: Spark, d: str) -> DataFrame:
    return E.hash_split(C.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 1)


@query("WITH " + SQL_EV + ", " + SQL_PRED_RUNS + """, h AS (SELECT r.pair_index, start, "end", avg(CASE WHEN gold > 0 THEN 1.0 ELSE 0 END) AS share, max(gold) AS concept FROM runs r JOIN ev ON ev.pair_index = r.pair_index AND pos >= start AND pos < "end" GROUP BY 1, 2, 3)
SELECT pair_index, start, "end", round(share, 6) AS share, concept FROM h WHERE share > 0.5""")
def f09_majority_segments(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    return S.majority_segments(S.run_segments(ev, "pred"), ev, value="gold").withColumn("share", F.round("share", 6))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 25")
def f10_cap_per_class(spark: Spark, d: str) -> DataFrame:
    return E.cap_per_class(C.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 25)


# joins


@query("WITH " + SQL_SRC + ", " + SQL_TRG + "SELECT s.pair_index, s.pos, token, concept FROM src s JOIN trg t ON s.pair_index = t.pair_index AND s.pos = t.pos")
def j01_zip(spark: Spark, d: str) -> DataFrame:
    return C.src_tokens(spark, d).join(C.trg_tokens(spark, d), [PAIR, "pos"])


@query("WITH " + SQL_SRC + ", " + SQL_TRG + "SELECT concept, token, count(*) AS n FROM src JOIN trg USING (pair_index) GROUP BY 1, 2")
def j02_within_pair_product(spark: Spark, d: str) -> DataFrame:
    from threadloom.operators.em import cooccurrences

    return cooccurrences(C.src_tokens(spark, d), C.trg_tokens(spark, d)).groupBy("concept", "token").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + SQL_SRC + ", " + SQL_TRG + """, c AS (SELECT concept, token, count(*) AS n FROM src JOIN trg USING (pair_index) GROUP BY 1, 2), p AS (SELECT concept, token, n / sum(n) OVER (PARTITION BY concept) AS p FROM c)
SELECT s.pair_index, s.pos, round(coalesce(p.p, 1e-11), 9) AS p FROM src s LEFT JOIN p ON p.token = s.token AND p.concept = 'ECONOMY'""")
def j03_hash_lookup(spark: Spark, d: str) -> DataFrame:
    from threadloom.operators.em import cooccurrences, counted_translation

    src = C.src_tokens(spark, d)
    t = counted_translation(cooccurrences(src, C.trg_tokens(spark, d))).where("concept = 'ECONOMY'").select("token", "p")
    return src.join(t, "token", "left").select(PAIR, "pos", F.round(F.coalesce("p", F.lit(1e-11)), 9).alias("p"))


SQL_COS = SQL_VEC + """, q AS (SELECT * FROM vec WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, q.label AS ql, v.label AS il, round(list_sum(list_transform(list_zip(q.vec, v.vec), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(q.vec, lambda x: x * x)) * list_sum(list_transform(v.vec, lambda x: x * x))), 6) AS score FROM q JOIN vec v ON v.vec_id <> q.vec_id)"""


def cosine_sides(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (every fiftieth vector), and all vectors."""
    v = C.vectors(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qv"), F.col("label").alias("ql"))
    return q, v.select(F.col("vec_id").alias("item_id"), F.col("vec").alias("iv"), F.col("label").alias("il"))


@query("WITH " + SQL_COS + "SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id DESC) AS rank FROM s) WHERE rank <= 5")
def j04_score_top_k(spark: Spark, d: str) -> DataFrame:
    return R.cosine_best(*cosine_sides(spark, d), 5).select("query_id", "item_id", "rank")


SQL_GOLD_RUNS = """gchg AS (SELECT *, CASE WHEN gold IS DISTINCT FROM lag(gold) OVER w OR pos = 0 THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY pair_index ORDER BY pos)),
gseg AS (SELECT *, CAST(sum(c) OVER (PARTITION BY pair_index ORDER BY pos) - 1 AS BIGINT) AS seg FROM gchg),
gruns AS (SELECT pair_index, seg, min(pos) AS start, max(pos) + 1 AS "end", min(gold) AS gold FROM gseg GROUP BY 1, 2)"""
SQL_RUNS = "WITH " + SQL_EV + ", " + SQL_PRED_RUNS + ", " + SQL_GOLD_RUNS
SQL_IOU = """CASE WHEN least(p."end", g."end") - greatest(p.start, g.start) <= 0 THEN 0.0 ELSE (least(p."end", g."end") - greatest(p.start, g.start)) / CAST(greatest(p."end", g."end") - least(p.start, g.start) AS DOUBLE) END"""


def both_runs(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    ev = C.event_tokens(spark, d)
    return S.run_segments(ev, "pred"), S.run_segments(ev, "gold")


@query(SQL_RUNS + f""" SELECT p.pair_index, p.start, p."end", round(coalesce(max({SQL_IOU}), 0), 6) AS iou FROM runs p LEFT JOIN gruns g ON p.pair_index = g.pair_index AND p.start < g."end" AND g.start < p."end" GROUP BY 1, 2, 3""")
def j05_best_iou(spark: Spark, d: str) -> DataFrame:
    return S.best_iou(*both_runs(spark, d)).withColumn("iou", F.round("iou", 6))


@query(SQL_RUNS + f""", a AS (SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY pair_index) AS l FROM runs) WHERE "end" < l), b AS (SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY pair_index) AS l FROM gruns) WHERE "end" < l)
SELECT p.pair_index AS p_key, p.start AS p_start, p."end" AS p_end, g.pair_index AS g_key, g.start AS g_start, g."end" AS g_end FROM a p JOIN b g ON p.pair_index = g.pair_index AND (abs(p."end" - g."end") <= 1 OR {SQL_IOU} > 0.5)""")
def j06_boundary_band(spark: Spark, d: str) -> DataFrame:
    return S.matched_boundaries(*both_runs(spark, d), tolerance=1)


@query("WITH " + SQL_EV + """, o AS (SELECT pair_index, pos AS f, pred AS value, pos * 10 AS os, pos * 10 + 10 AS oe FROM ev), mx AS (SELECT pair_index, max(oe) AS m FROM o GROUP BY 1),
n AS (SELECT pair_index, CAST(unnest(range(0, (m + 15) // 16)) AS BIGINT) AS frame FROM mx)
SELECT n.pair_index, frame, arg_max(value, (least(oe, frame * 16 + 16), f)) AS value FROM n JOIN o ON o.pair_index = n.pair_index AND os < frame * 16 + 16 AND frame * 16 < oe GROUP BY 1, 2""")
def j07_resample(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    old = ev.select(PAIR, F.col("pos").alias("frame"), (F.col("pos") * 10).alias("s"), (F.col("pos") * 10 + 10).alias("e"))
    n = old.groupBy(PAIR).agg(F.max("e").alias("m")).select(PAIR, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") + 15) / 16) - 1)).alias("frame"))
    new = n.select(PAIR, "frame", (F.col("frame") * 16).alias("s"), (F.col("frame") * 16 + 16).alias("e"))
    return S.resample(ev.select(PAIR, F.col("pos").alias("frame"), F.col("pred").alias("value")), old, new)


@query("""WITH b AS (SELECT lang, doc_id AS l_id, list_distinct(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '')) AS lt FROM documents WHERE doc_id % 100 = 0),
j AS (SELECT l_id, d.doc_id AS r_id, lt, list_distinct(list_filter(string_split_regex(d.text, '[ \\t\\n]+'), lambda x: x <> '')) AS rt FROM b JOIN documents d ON d.lang = b.lang AND d.doc_id <> l_id),
s AS (SELECT l_id, r_id, len(list_intersect(lt, rt)) AS i, round(len(list_intersect(lt, rt)) / len(list_distinct(list_concat(lt, rt))), 9) AS sim FROM j)
SELECT l_id, arg_max(r_id, (sim, -r_id)) AS r_id, max(sim) AS sim FROM s WHERE i > 0 GROUP BY 1""")
def j08_jaccard_best(spark: Spark, d: str) -> DataFrame:
    """The stated query set (ids divisible by 100) against all documents of the language."""
    docs = C.table(spark, d, "documents").select("doc_id", "lang", C.split_words(F.col("text")).alias("t"))
    left = docs.where("doc_id % 100 = 0").select("lang", F.col("doc_id").alias("l_id"), F.col("t").alias("l_tokens"))
    right = docs.select("lang", F.col("doc_id").alias("r_id"), F.col("t").alias("r_tokens"))
    return R.jaccard_best(left, right, "lang")


@query("WITH " + SQL_EV + """, a AS (SELECT pair_index, token, pos, row_number() OVER (PARTITION BY pair_index, token ORDER BY pos) AS k FROM ev), b AS (SELECT pair_index, token, pos, row_number() OVER (PARTITION BY pair_index, token ORDER BY pos) AS k FROM ev WHERE pred <> 0)
SELECT a.pair_index, a.token, a.pos AS l_pos, b.pos AS r_pos FROM a JOIN b ON a.pair_index = b.pair_index AND a.token = b.token AND a.k = b.k""")
def j09_occurrence_match(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    return R.occurrence_match(ev, ev.where("pred <> 0"))


@query("SELECT p.page_id, d.doc_id FROM pages p JOIN documents d ON CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) = d.doc_id WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''")
def j10_id_lookup(spark: Spark, d: str) -> DataFrame:
    p = C.table(spark, d, "pages").withColumn("ref", F.regexp_extract("url", "/([0-9]+)", 1)).where("ref <> ''").select("page_id", F.col("ref").cast("long").alias("doc_id"))
    return p.join(C.table(spark, d, "documents").select("doc_id"), "doc_id").select("page_id", "doc_id")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def j11_semi(spark: Spark, d: str) -> DataFrame:
    c = C.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.table(spark, d, "orders").join(c, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j12_left_default(spark: Spark, d: str) -> DataFrame:
    o = C.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return C.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill({"n": 0})


# windows


@query("WITH " + SQL_EV + ", " + SQL_PRED_RUNS + ' SELECT pair_index, seg, start, "end", pred FROM runs')
def w01_runs(spark: Spark, d: str) -> DataFrame:
    return S.run_segments(C.event_tokens(spark, d), "pred")


@query("WITH " + SQL_EV + """SELECT pair_index, pos + 1 AS k, CAST(floor(sum(greatest(CAST(floor(value) AS BIGINT), 10)) OVER (PARTITION BY pair_index ORDER BY pos) / 10) AS BIGINT) AS frame FROM ev UNION ALL SELECT DISTINCT pair_index, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ev""")
def w02_landmarks(spark: Spark, d: str) -> DataFrame:
    return S.landmarks(C.event_tokens(spark, d), F.floor("value"), 10)


@query("WITH " + SQL_EV + """, c AS (SELECT pred AS i, lead(pred) OVER (PARTITION BY pair_index ORDER BY pos) AS j FROM ev), n AS (SELECT i, j, count(*) AS n FROM c WHERE j IS NOT NULL GROUP BY 1, 2), t AS (SELECT j - i AS jump, sum(n) AS n FROM n GROUP BY 1)
SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CAST(n AS BIGINT) AS n FROM range(5) a(i), range(5) b(j), t WHERE jump = b.j - a.i""")
def w03_tied_jumps(spark: Spark, d: str) -> DataFrame:
    from threadloom.operators.hmm import tie_jumps

    w = Window.partitionBy(PAIR).orderBy("pos")
    c = C.event_tokens(spark, d).select(F.col("pred").alias("i"), F.lead("pred").over(w).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(5).select(F.col("id").alias("i")).crossJoin(spark.range(5).select(F.col("id").alias("j")))
    return tie_jumps(grid.join(c, ["i", "j"], "left").na.fill({"n": 0}).withColumn("m", F.lit(5)), "n").select("i", "j", "n")


@query("WITH " + SQL_EV + """SELECT pair_index, pos, round(v * coalesce(exp(sum(ln(1 - v)) OVER (PARTITION BY pair_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 6) AS w FROM (SELECT pair_index, pos, value / (value + 500) AS v FROM ev)""")
def w04_stick_break_window(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy(PAIR).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    v = C.event_tokens(spark, d).withColumn("v", F.col("value") / (F.col("value") + 500))
    return v.select(PAIR, "pos", F.round(F.col("v") * F.coalesce(F.exp(F.sum(F.log(1 - F.col("v"))).over(w)), F.lit(1.0)), 6).alias("w"))


@query("WITH " + SQL_EV + ", c AS (SELECT pair_index, pos, pred, lag(pred) OVER (PARTITION BY pair_index ORDER BY pos) AS p FROM ev) SELECT pair_index, pos, pred FROM c WHERE (p IS NULL OR p <> pred) AND pred <> 0")
def w05_collapse(spark: Spark, d: str) -> DataFrame:
    return S.collapse_repeats(C.event_tokens(spark, d).select(PAIR, "pos", "pred"), "pred", drop=0)


@query("WITH " + SQL_SRC + """, c AS (SELECT token, count(*) AS n FROM src GROUP BY 1), s AS (SELECT token, sum(n) OVER (ORDER BY token) / sum(n) OVER () AS cum FROM c), u AS (SELECT CAST(i AS BIGINT) AS draw, CAST('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(200) r(i))
SELECT draw, min(token) AS token FROM u JOIN s ON cum > u GROUP BY 1""")
def w06_inverse_cdf(spark: Spark, d: str) -> DataFrame:
    from threadloom.operators.sampling import draw, hash_uniform

    c = C.src_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("weight"))
    u = spark.range(200).select(F.col("id").alias("draw"), hash_uniform(F.col("id")).alias("u"))
    return draw(c, u, "token").select("draw", "token")


@query("WITH " + SQL_EV + """, b AS (SELECT * FROM ev WHERE token = 'error') SELECT pair_index, coalesce(lag(pos) OVER (PARTITION BY pair_index ORDER BY pos), 0) AS start, pos + 1 AS "end" FROM b""")
def w07_boundary_spans(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d).withColumn("boundary", (F.col("token") == "error").cast("int"))
    return S.boundaries_to_spans(ev)


@query("WITH " + SQL_EV + ", " + SQL_PRED_RUNS + ' SELECT pair_index, "end" AS frame FROM runs UNION SELECT pair_index, CAST(0 AS BIGINT) FROM runs')
def w07_span_landmarks(spark: Spark, d: str) -> DataFrame:
    return S.span_landmarks(S.run_segments(C.event_tokens(spark, d), "pred"))


# sort, limit, sets


@query("SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) DESC, c_custkey) AS rank FROM customer")
def t01_order_by_suffix(spark: Spark, d: str) -> DataFrame:
    """Every row's place in the order of numeric suffixes, ranked by ranges."""
    c = C.table(spark, d, "customer").select("c_custkey", (-E.numeric_suffix(F.col("c_name"), "[^0-9]+")).alias("s"))
    return E.ranked(c, ["s", "c_custkey"], "rank").select("c_custkey", (F.col("rank") + 1).alias("rank"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t03_top_classes(spark: Spark, d: str) -> DataFrame:
    return E.top_classes(C.table(spark, d, "documents"), "source", 10)


@query("WITH " + SQL_VEC + "SELECT vec_id, CAST(list_position(vec, list_max(vec)) - 1 AS BIGINT) AS arg_max, CAST(list_position(vec, list_min(vec)) - 1 AS BIGINT) AS arg_min FROM vec")
def t04_argmax(spark: Spark, d: str) -> DataFrame:
    return C.vectors(spark, d).select("vec_id", (F.array_position("vec", F.array_max("vec")) - 1).alias("arg_max"), (F.array_position("vec", F.array_min("vec")) - 1).alias("arg_min"))


@query("WITH s AS (SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY 1 HAVING count(*) >= 10), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, l_suppkey) AS b, row_number() OVER (ORDER BY a, l_suppkey) AS w FROM s) SELECT l_suppkey, n, a FROM r WHERE b <= 10 OR w <= 10")
def t05_best_and_worst(spark: Spark, d: str) -> DataFrame:
    s = C.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("a")).where("n >= 10")
    return s.orderBy(F.desc("a"), "l_suppkey").limit(10).unionByName(s.orderBy("a", "l_suppkey").limit(10)).distinct()


@query("WITH " + SQL_TXT + " SELECT pair_index, md5('7:' || pair_index) AS r FROM txt")
def t06_shuffle(spark: Spark, d: str) -> DataFrame:
    """A seeded random order of the pairs."""
    from threadloom.operators.sampling import shuffled

    return shuffled(C.text_pairs(spark, d).select(PAIR), PAIR, seed=7)


@query("WITH " + SQL_SRC + ", " + SQL_TRG + "SELECT token AS item FROM src UNION SELECT concept FROM trg")
def u01_union(spark: Spark, d: str) -> DataFrame:
    return C.src_tokens(spark, d).select(F.col("token").alias("item")).union(C.trg_tokens(spark, d).select("concept")).distinct()


@query("WITH " + SQL_SRC + ", s AS (SELECT pair_index, list_distinct(list(token)) AS t FROM src GROUP BY 1) SELECT a.pair_index, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM s a JOIN s b ON b.pair_index = a.pair_index + 1")
def u02_jaccard(spark: Spark, d: str) -> DataFrame:
    s = C.src_tokens(spark, d).groupBy(PAIR).agg(F.collect_set("token").alias("t"))
    o = s.select((F.col(PAIR) - 1).alias(PAIR), F.col("t").alias("o"))
    return s.join(o, PAIR).select(PAIR, F.round(F.size(F.array_intersect("t", "o")) / F.size(F.array_union("t", "o")), 6).alias("jaccard"))


@query("WITH " + SQL_TRG + "SELECT pair_index, string_agg(concept, ',' ORDER BY concept) AS concepts FROM trg GROUP BY 1")
def u03_sorted_distinct(spark: Spark, d: str) -> DataFrame:
    return C.lines(spark, d).groupBy(F.col("l_orderkey").alias(PAIR)).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("concepts"))


@query("SELECT n_name AS name, 'nation' AS part FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def u04_concatenate(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("part")).unionByName(C.table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("part")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u05_except(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id").join(C.table(spark, d, "labels"), "doc_id", "left_anti").distinct()
