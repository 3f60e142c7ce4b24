"""Queries of readers' parsing and of export formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import numeric as N
from threadloom.operators import em
from threadloom.operators import encode as E
from threadloom.operators import segments as S
from threadloom.sources import media, npz, records, sinks, splits, text
from threadloom.sources.shared import new_path

from . import corpora as C
from .corpora import SQL_EV, SQL_SRC, SQL_TRG, SQL_VEC
from .registry import query
from .relational import PAIR, SQL_RUNS

Spark = SparkSession
SQL_LINES = "ln AS (SELECT item_id AS i, text AS line FROM benchmark)"
SQL_SPLIT = "list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')"


def bench_lines(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "benchmark").select(F.col("item_id").alias("at"), F.col("text").alias("line"))


@query(f"WITH {SQL_LINES}, w AS (SELECT i // 3 AS pair_index, {SQL_SPLIT} AS w FROM ln WHERE i % 3 = 1) SELECT pair_index, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS token FROM w")
def s01_triples_source(spark: Spark, d: str) -> DataFrame:
    return text.triples(bench_lines(spark, d))[0]


@query(f"WITH {SQL_LINES}, w AS (SELECT i // 3 AS pair_index, list_concat(['NULL'], {SQL_SPLIT}) AS w FROM ln WHERE i % 3 = 0) SELECT pair_index, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS concept FROM w")
def s01_triples_targets(spark: Spark, d: str) -> DataFrame:
    return text.triples(bench_lines(spark, d))[1]


@query(f"WITH {SQL_LINES}, w AS (SELECT i AS pair_index, {SQL_SPLIT} AS w FROM ln) SELECT pair_index, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS token FROM w")
def s02_sentences(spark: Spark, d: str) -> DataFrame:
    return text.sentences(bench_lines(spark, d))


@query("SELECT event_id AS at, event_type AS word, round(value, 6) AS begin, round(value + 1.5, 6) AS \"end\" FROM events")
def s09_word_times(spark: Spark, d: str) -> DataFrame:
    e = C.table(spark, d, "events").select(F.col("event_id").alias("at"), F.concat_ws(" ", "event_type", F.col("value").cast("string"), (F.col("value") + 1.5).cast("string")).alias("line"))
    return text.word_times(e).withColumns({"begin": F.round("begin", 6), "end": F.round("end", 6)})


@query("SELECT p_partkey AS at, CAST(0 AS BIGINT) AS k, CAST(p_size AS VARCHAR) AS entity, lower(p_type) AS type, p_name AS phrase FROM part")
def s11_tagged_phrases(spark: Spark, d: str) -> DataFrame:
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("at"), F.format_string("A [/EN#%d/%s %s] here .", "p_size", F.lower("p_type"), "p_name").alias("line"))
    return text.tagged_phrases(p)


@query("SELECT p_partkey AS at, p_brand AS image_key, CAST(p_size AS BIGINT) AS x, CAST(1 AS BIGINT) AS y, CAST(p_size + 2 AS BIGINT) AS w, CAST(3 AS BIGINT) AS h, p_type AS concept FROM part WHERE p_type <> 'SMALL'")
def s13_region_labels(spark: Spark, d: str) -> DataFrame:
    p = C.table(spark, d, "part")
    boxes = p.select(F.col("p_partkey").alias("at"), F.format_string("%s %d 1 %d 3", "p_brand", "p_size", F.col("p_size") + 2).alias("line"))
    return text.region_labels(boxes, p.select(F.col("p_partkey").alias("at"), F.col("p_type").alias("line")), drop=("SMALL",))


SQL_BOTH = "WITH " + SQL_SRC + ", " + SQL_TRG + ", a AS (SELECT pair_index, string_agg(token, ' ' ORDER BY pos) AS src FROM src GROUP BY 1), b AS (SELECT pair_index, string_agg(concept, ' ' ORDER BY pos) AS trg FROM trg GROUP BY 1)"


@query(SQL_BOTH + " SELECT pair_index, src, trg FROM a JOIN b USING (pair_index)")
def s14_parallel_text(spark: Spark, d: str) -> DataFrame:
    return sinks.parallel_text(C.src_tokens(spark, d), C.trg_tokens(spark, d))


@query("WITH " + SQL_SRC + ", v AS (SELECT token, row_number() OVER (ORDER BY token) AS w FROM (SELECT DISTINCT token FROM src)) SELECT pair_index + 1 AS doc, w AS word FROM src JOIN v USING (token)")
def s15_index_triples(spark: Spark, d: str) -> DataFrame:
    s = C.src_tokens(spark, d)
    return sinks.index_triples(s, E.vocabulary(s, order="sorted"), "token")


@query(SQL_RUNS + ", j AS (SELECT ev.pair_index, pos, CASE WHEN r.start IS NOT NULL AND pos > 0 THEN ' ' ELSE '' END || CASE token WHEN 'click' THEN 'a' WHEN 'error' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'signup' THEN 'd' ELSE 'e' END AS cell FROM ev LEFT JOIN runs r ON r.pair_index = ev.pair_index AND r.start = pos) SELECT pair_index, string_agg(cell, '' ORDER BY pos) AS line FROM j GROUP BY 1")
def s16_letter_text(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    letters = F.broadcast(spark.sql("SELECT * FROM VALUES ('click', 'a'), ('error', 'b'), ('purchase', 'c'), ('signup', 'd'), ('view', 'e') AS t(token, letter)"))
    return sinks.letter_text(ev, letters, S.run_segments(ev, "pred"))


@query(SQL_BOTH + " SELECT pair_index, trg || chr(10) || src || chr(10) AS block FROM a JOIN b USING (pair_index)")
def s17_text_pairs(spark: Spark, d: str) -> DataFrame:
    return sinks.text_pair_blocks(C.src_tokens(spark, d), C.trg_tokens(spark, d))


@query(SQL_RUNS + """ SELECT 'pair_' || pair_index || ' ' || start || ' ' || "end" || ' ' || pred AS line FROM runs""")
def s18_word_units(spark: Spark, d: str) -> DataFrame:
    return sinks.word_units(S.run_segments(C.event_tokens(spark, d), "pred"), "pred")


@query(SQL_RUNS + """, t AS (SELECT *, max(seg) OVER (PARTITION BY pair_index) AS l FROM runs) SELECT 'pair_' || pair_index || ' ' || start || ' ' || "end" || ' ' || pred AS line FROM t WHERE seg < l OR "end" - start > 1""")
def s18_word_units_compat(spark: Spark, d: str) -> DataFrame:
    """Without a final unit of one position, as older exports have it."""
    return sinks.word_units(S.run_segments(C.event_tokens(spark, d), "pred", emit_trailing=False), "pred")


@query(SQL_RUNS + """ SELECT pred AS cls, 'Class ' || pred || ':' || chr(10) || string_agg('pair_' || pair_index || ' ' || start || ' ' || "end", chr(10) ORDER BY pair_index, start) || chr(10) AS block FROM runs GROUP BY pred""")
def s19_word_classes(spark: Spark, d: str) -> DataFrame:
    return sinks.word_classes(S.run_segments(C.event_tokens(spark, d), "pred"), "pred")


@query("WITH " + SQL_EV + ", r AS (SELECT pair_index, count(DISTINCT token) AS n FROM ev GROUP BY 1) SELECT pair_index AS index, pos, token AS caption, least(pred, n - 1) AS alignment FROM (SELECT *, row_number() OVER (PARTITION BY pair_index ORDER BY pos) - 1 AS p2 FROM ev) JOIN r USING (pair_index)")
def s21_merged_reports(spark: Spark, d: str) -> DataFrame:
    ev = C.event_tokens(spark, d)
    items = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    r = ev.groupBy(F.col(PAIR).alias("index")).agg(F.concat(items("token"), F.array(F.lit("</s>"))).alias("caption"), F.concat(F.array_sort(F.collect_set("token")), F.array(F.lit("</s>"))).alias("image_concepts"), F.concat(items("pred"), F.array(F.lit(0).cast("long"))).alias("alignment"))
    m = text.merged_reports(r)
    return m.select("index", F.posexplode(F.arrays_zip("caption", "alignment")).alias("pos", "x")).select("index", "pos", "x.caption", "x.alignment")


@query("SELECT event_id AS at, CAST(k AS BIGINT) AS rank, event_id * k AS item, round(value * k, 4) AS score FROM events, range(1, 3) r(k)")
def s22_retrieval_tuples(spark: Spark, d: str) -> DataFrame:
    e = C.table(spark, d, "events")
    line = F.concat(*[F.concat(F.lit("("), (F.col("event_id") * k).cast("string"), F.lit(", "), F.round(F.col("value") * k, 4).cast("string"), F.lit(") ")) for k in (1, 2)])
    return text.retrieval_tuples(e.select(F.col("event_id").alias("at"), line.alias("line")))


# Text files written from a table and read back in splits, with line numbers.


def _as_text(spark: Spark, rows: DataFrame, order: str, line: str) -> DataFrame:
    path = new_path(spark)
    rows.orderBy(order).select(line).write.text(path)
    return splits.numbered_lines(spark, path, across=True)


def _triple_lines(spark: Spark, d: str) -> DataFrame:
    """Records of three lines, in order of the pairs: targets, source, blank."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), " ")
    src = C.src_tokens(spark, d).groupBy(PAIR).agg(listed("token").alias("s"))
    trg = C.trg_tokens(spark, d).groupBy(PAIR).agg(listed("concept").alias("t"))
    rows = src.join(trg, PAIR).select(PAIR, F.concat_ws("\n", "t", "s", F.lit("")).alias("line"))
    return _as_text(spark, rows, PAIR, "line")


@query("WITH " + SQL_SRC + ", o AS (SELECT pair_index, row_number() OVER (ORDER BY pair_index) - 1 AS n FROM (SELECT DISTINCT pair_index FROM src)) SELECT n AS pair_index, pos, token FROM src JOIN o USING (pair_index)")
def s01_split_source(spark: Spark, d: str) -> DataFrame:
    return text.triples(_triple_lines(spark, d))[0]


@query("WITH " + SQL_SRC + ", " + SQL_TRG + ", o AS (SELECT pair_index, row_number() OVER (ORDER BY pair_index) - 1 AS n FROM (SELECT DISTINCT pair_index FROM src)) SELECT n AS pair_index, pos, concept FROM trg JOIN o USING (pair_index)")
def s01_split_targets(spark: Spark, d: str) -> DataFrame:
    return text.triples(_triple_lines(spark, d), null=False)[1]


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS at, event_type AS word, round(value, 6) AS begin, round(value + 1.5, 6) AS \"end\" FROM events")
def s09_split_word_times(spark: Spark, d: str) -> DataFrame:
    e = C.table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("value").cast("string"), (F.col("value") + 1.5).cast("string")).alias("line"))
    return text.word_times(_as_text(spark, e, "event_id", "line")).withColumns({"begin": F.round("begin", 6), "end": F.round("end", 6)})


@query("WITH o AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) SELECT 2 * n + b AS pair_index, k, CASE WHEN b = 0 THEN k * p_size ELSE p_size + k END AS frame FROM o, (SELECT unnest(range(2)) AS b), (SELECT CAST(unnest(range(3)) AS BIGINT) AS k)")
def s23_split_blocks(spark: Spark, d: str) -> DataFrame:
    """Two blocks of three numbers for every part, over lines of all files."""
    n = F.col("p_size")
    p = C.table(spark, d, "part").select("p_partkey", F.format_string("0\n%d\n%d\n\n%d\n%d %d\n", n, n * 2, n, n + 1, n + 2).alias("line"))
    lines = _as_text(spark, p, "p_partkey", "line").withColumn("file", F.lit(0))  # numbered across files: one text
    return splits.number_blocks(lines).drop("file")


# Round trips: written from a table, read back, compared with the table.


def _archives(spark: Spark, d: str) -> DataFrame:
    """An archive of each vector pair, as written and read again."""
    path = new_path(spark)
    npz.write_npz(C.vectors(spark, d).withColumn("key", F.format_string("arr_%d", PAIR))).write.parquet(path)
    return spark.read.parquet(path)


@query("WITH " + SQL_VEC + " SELECT CAST(pair_index AS BIGINT) AS pair_index, pos, round(list_sum(vec), 6) AS total, CAST(len(vec) AS BIGINT) AS dim FROM vec")
def s03_npz_matrices(spark: Spark, d: str) -> DataFrame:
    """Ragged matrices written to archives and read back."""
    return npz.npz_matrices(_archives(spark, d)).select(PAIR, "pos", F.round(N.total(F.col("vec")), 6).alias("total"), F.size("vec").alias("dim"))


@query("WITH " + SQL_VEC + ", c AS (SELECT pair_index, string_agg(DISTINCT CAST(label AS VARCHAR), ' ' ORDER BY CAST(label AS VARCHAR)) AS concepts FROM vec GROUP BY 1) SELECT CAST(pair_index AS BIGINT) AS pair_index, pos, round(list_sum(vec), 6) AS total, concepts FROM vec JOIN c USING (pair_index) WHERE pos < 3")
def s04_npz_with_concepts(spark: Spark, d: str) -> DataFrame:
    """Archives cut after three frames, with the concept line of each pair."""
    path = new_path(spark)
    labels = C.vectors(spark, d).groupBy(PAIR).agg(F.array_join(F.sort_array(F.collect_set(F.col("label").cast("string"))), " ").alias("line"))
    labels.select(F.concat_ws("\t", F.col(PAIR).cast("string"), "line").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).cast("long").alias(PAIR), F.get("p", F.lit(1)).alias("concepts"))
    return npz.npz_matrices(_archives(spark, d), longest=3).join(lines, PAIR).select(PAIR, "pos", F.round(N.total(F.col("vec")), 6).alias("total"), "concepts")


def _records(spark: Spark, d: str) -> DataFrame:
    """Events as alignment records."""
    e = C.event_tokens(spark, d).groupBy(PAIR).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "gold", "pred"))).alias("e"))
    pick = lambda c: F.transform("e", lambda x: x[c])
    return e.select(F.col(PAIR).alias("index"), F.lit(True).alias("is_phoneme"), F.lit(False).alias("is_audio"), pick("token").alias("caption"), F.array_distinct(pick("token")).alias("image_concepts"), F.transform("e", lambda x: x["gold"].cast("int")).alias("alignment"), F.transform("e", lambda x: F.array(x["pred"].cast("double"), F.lit(0.5))).alias("align_probs"))


@query("WITH " + SQL_EV + ' SELECT pair_index AS "index", pos, token, gold AS alignment, CAST(pred AS DOUBLE) AS p, true AS is_phoneme FROM ev')
def s05_alignment_json(spark: Spark, d: str) -> DataFrame:
    """Alignment records written as JSON and read back."""
    path = new_path(spark)
    sinks.write_alignments(_records(spark, d), path)
    a = text.alignments(spark, path, by_line=True)
    rows = a.select("index", "is_phoneme", F.posexplode(F.arrays_zip("caption", "alignment", "align_probs")).alias("pos", "z"))
    return rows.select("index", "pos", F.col("z.caption").alias("token"), F.col("z.alignment").alias("alignment"), F.get("z.align_probs", F.lit(0)).alias("p"), "is_phoneme")


def _kept(spark: Spark, df: DataFrame, key: str) -> DataFrame:
    """Written to the keyed_records source and read back."""
    path = new_path(spark)
    records.register(spark)
    df.write.format(records.FORMAT).option("key", key).mode("append").save(path)
    return spark.read.format(records.FORMAT).option("key", key).load(path)


@query("WITH " + SQL_EV + ' SELECT pair_index AS "index", pos, token, gold AS alignment, CAST(pred AS DOUBLE) AS p, true AS is_phoneme FROM ev')
def s05_keyed_records(spark: Spark, d: str) -> DataFrame:
    """S05, S08 by the data source with committed manifests."""
    rows = _kept(spark, _records(spark, d), "index").select("index", "is_phoneme", F.posexplode(F.arrays_zip("caption", "alignment", "align_probs")).alias("pos", "z"))
    return rows.select("index", "pos", F.col("z.caption").alias("token"), F.col("z.alignment").alias("alignment"), F.get("z.align_probs", F.lit(0)).alias("p"), "is_phoneme")


@query("WITH " + SQL_EV + " SELECT pair_index || ' ' || pos || ' ' || gold AS line FROM ev")
def s08_alignment_text(spark: Spark, d: str) -> DataFrame:
    path = new_path(spark)
    sinks.write_alignments(C.event_tokens(spark, d).select(PAIR, "pos", "gold"), path, form="text")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("WITH " + SQL_SRC + ", " + SQL_TRG + ", co AS (SELECT token, concept, count(*) AS n FROM src JOIN trg USING (pair_index) GROUP BY 1, 2) SELECT concept, token, round(n / sum(n) OVER (PARTITION BY concept), 9) AS p FROM co")
def s06_parameter_table(spark: Spark, d: str) -> DataFrame:
    """A translation table written as tab-separated text and read back."""
    path = new_path(spark)
    sinks.write_parameters(em.pattern_counts(em.patterns(C.order_positions(spark, d))), path)
    return text.parameters(spark, path, "concept string, token string, p double").withColumn("p", F.round("p", 9))


@query("WITH " + SQL_SRC + ", " + SQL_TRG + ", co AS (SELECT token, concept, count(*) AS n FROM src JOIN trg USING (pair_index) GROUP BY 1, 2) SELECT concept, token, round(n / sum(n) OVER (PARTITION BY concept), 9) AS p FROM co")
def s06_keyed_parameters(spark: Spark, d: str) -> DataFrame:
    """S06, S07 by the same data source, with ranges of concepts."""
    return _kept(spark, em.pattern_counts(em.patterns(C.order_positions(spark, d))), "concept").withColumn("p", F.round("p", 9))


@query("WITH " + SQL_EV + " SELECT CAST(pair_index AS VARCHAR) AS path, CAST(1000 AS BIGINT) AS rate, count(*) AS n, CAST(sum(gold * 100 - pred) AS DOUBLE) AS total FROM ev WHERE pos BETWEEN 2 AND 4 GROUP BY 1")
def s20_wav_slice(spark: Spark, d: str) -> DataFrame:
    """Samples written as WAV at 1000 Hz, read back from 2 to 5 ms."""
    x = F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("gold") * 100 - F.col("pred")).alias("v")))), lambda t: t["v"])
    files = npz.write_wav(C.event_tokens(spark, d).groupBy(F.col(PAIR).alias("path")).agg(x.alias("samples")), rate=1000)
    cut = npz.wav_samples(files, 2, 5).where(F.size("samples") > 0)
    return cut.select("path", "rate", F.size("samples").alias("n"), N.total(F.col("samples")).alias("total"))


@query("SELECT p_partkey AS doc, CAST(b AS BIGINT) AS pair_index, k, CASE WHEN b = 0 THEN k * p_size ELSE p_size + k END AS frame FROM part, (SELECT unnest(range(2)) AS b), (SELECT CAST(unnest(range(3)) AS BIGINT) AS k)")
def s23_segment_text(spark: Spark, d: str) -> DataFrame:
    """Blocks of frame numbers written as one text a row and read back."""
    path = new_path(spark)
    p = C.table(spark, d, "part")
    n = F.col("p_size")
    p.select(F.col("p_partkey").alias("doc"), F.format_string("0\n%d\n%d\n\n%d\n%d %d\n", n, n * 2, n, n + 1, n + 2).alias("value")).write.parquet(path)
    return text.blocks_of(spark.read.parquet(path), carry=("doc",)).select("doc", "pair_index", "k", "frame")


@query("WITH " + SQL_TRG + ", v AS (SELECT concept, row_number() OVER (ORDER BY concept) AS w FROM (SELECT DISTINCT concept FROM trg)) SELECT pair_index + 1 AS doc, w AS word FROM trg JOIN v USING (concept)")
def s15_index_concepts(spark: Spark, d: str) -> DataFrame:
    """The concept half of the index files."""
    t = C.trg_tokens(spark, d)
    return sinks.index_triples(t, E.vocabulary(t.select(PAIR, "pos", F.col("concept").alias("token")), order="sorted"), "concept")


@query("WITH " + SQL_SRC + " SELECT token AS line, row_number() OVER (ORDER BY token) AS word FROM (SELECT DISTINCT token FROM src)")
def s15_vocabulary_lines(spark: Spark, d: str) -> DataFrame:
    """The vocabulary file: line n names word n."""
    return E.vocabulary(C.src_tokens(spark, d), order="sorted").select(F.col("token").alias("line"), (F.col("token_id") + 1).alias("word"))


@query("SELECT event_id, round(-(1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5) + 1 / (x + 6) + 1 / (x + 7) + 1 / (x + 8) + 1 / (x + 9)) + ln(x + 10) - 1 / (2 * (x + 10)) - 1 / (12 * pow(x + 10, 2)) + 1 / (120 * pow(x + 10, 4)) - 1 / (252 * pow(x + 10, 6)), 7) AS y FROM (SELECT event_id, abs(value) + 0.5 AS x FROM events)")
def p29_digamma(spark: Spark, d: str) -> DataFrame:
    return C.table(spark, d, "events").select("event_id", F.round(N.digamma(F.abs("value") + 0.5), 7).alias("y"))


@query("WITH " + SQL_VEC + " SELECT CAST(pair_index AS VARCHAR) AS path, 'x' AS name, pos, round(list_sum(vec), 6) AS total, CAST(len(vec) AS BIGINT) AS dim FROM vec")
def s12_mat_matrices(spark: Spark, d: str) -> DataFrame:
    """A MAT file of each vector pair, written and read back."""
    m = C.vectors(spark, d).groupBy(F.col(PAIR).cast("string").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"]).alias("m"))

    def run(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([media.make_mat({"x": np.array(m)}) for m in b.column("m").to_pylist()], pa.binary())], ["path", "content"])

    files = m.mapInArrow(run, "path string, content binary")
    return media.mat_matrices(files).select("path", "name", "pos", F.round(N.total(F.col("vec")), 6).alias("total"), F.size("vec").alias("dim"))


@query("SELECT CAST(p_size AS VARCHAR) AS path, p_partkey AS id, p_type AS concept, p_retailprice AS score FROM part")
def s10_sqlite_rows(spark: Spark, d: str) -> DataFrame:
    """Annotations in a SQLite file for each size, written and read back."""
    p = C.table(spark, d, "part").select("p_size", F.col("p_partkey").alias("id"), F.col("p_type").alias("concept"), F.col("p_retailprice").alias("score"))
    return media.sqlite_rows(media.write_sqlite(p, "p_size", "notes"), "notes", {"id": "long", "concept": "string", "score": "double"})


@query("WITH " + SQL_EV + " SELECT pair_index, '<table><tr><th>token</th><th>gold</th><th>pred</th></tr>' || string_agg('<tr><td>' || token || '</td><td>' || gold || '</td><td>' || pred || '</td></tr>', '' ORDER BY pos) || '</table>' AS html FROM ev GROUP BY 1")
def s24_html_report(spark: Spark, d: str) -> DataFrame:
    return media.html_report(C.event_tokens(spark, d), ["token", "gold", "pred"])


@query("WITH " + SQL_VEC + """, bx AS (SELECT vec_id, vec, label % 6 AS x, label % 5 AS y, 3 + label % 4 AS w, 2 + label % 5 AS h FROM vec),
px AS (SELECT vec_id, i, x + CAST(floor((i % 4 + 0.5) * w / 4) AS BIGINT) AS c, y + CAST(floor((i // 4 + 0.5) * h / 4) AS BIGINT) AS r, vec FROM bx, (SELECT unnest(range(16)) AS i))
SELECT vec_id, CAST(i AS BIGINT) AS i, round((CASE WHEN c < 8 AND r < 8 THEN vec[r * 8 + c + 1] ELSE 0 END - 0.45) / 0.22, 6) AS v FROM px""")
def p17_image_crop(spark: Spark, d: str) -> DataFrame:
    """Vectors as 8 x 8 images, a box of each scaled to 4 x 4 and standardised;
    the first of the three colours."""
    v = C.vectors(spark, d)
    box = (F.col("label") % 6, F.col("label") % 5, 3 + F.col("label") % 4, 2 + F.col("label") % 5)
    rgb = N.grey_to_rgb(N.standardised(N.crop_image(F.col("vec"), 8, box, 4), 0.45, 0.22))
    return v.select("vec_id", F.posexplode(rgb).alias("k", "v")).where("k % 3 = 0").select("vec_id", F.floor(F.col("k") / 3).alias("i"), F.round("v", 6).alias("v"))
