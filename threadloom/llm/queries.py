"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import inline_table, read

#: Fixed values of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_groups

    return near_groups(read(spark, sf_dir, "documents"), threshold=85, width=3)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_trees, read_loss, read_turns, threads

    said = "\\### Assistant: </turn> ok"
    more = inline_table(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = threads(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    out = format_trees(rows)
    turns = read_turns(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("bigint").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_texts

    return encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import as_string, edit_probe, likeness

    out = edit_probe(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(read(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("row.*", "size", "block", "release", "deadline", "slot")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql(order: int = 4, least: int = 50, states: int = 4096) -> str:
    """Contexts by count, the two models level by level, their log ratio at the
    longest context of each character, and the threshold of the held-out URLs."""
    back = ", ".join(f"lag(c, {d}) OVER w AS b{d}" for d in range(1, order + 1))
    name = lambda d: " + ".join([str(64**d), *(f"b{j} * {64 ** (j - 1)}" for j in range(1, d + 1))])
    grams = " UNION ALL ".join(["SELECT rid, i, c, 0 AS d, 1 AS w FROM g", *(f"SELECT rid, i, c, {d}, {name(d)} FROM g WHERE b{d} IS NOT NULL" for d in range(1, order + 1))])
    levels = "".join(
        f""",
p{d} AS (SELECT t.ruled, t.w, t.c, CASE WHEN t.s IS NULL THEN q.p ELSE (t.n + t.t * q.p) / (t.s + t.t) END AS p FROM cells t JOIN p{d - 1} q ON q.ruled = t.ruled AND q.c = t.c AND q.w = {64 ** (d - 1)} + t.w % {64 ** (d - 1)} WHERE t.d = {d})"""
        for d in range(1, order + 1)
    )
    every = " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(order + 1))
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, strpos(url, '://') AS a FROM pages),
h AS (SELECT rid, page_id, coalesce(CASE WHEN a > 0 THEN translate(regexp_extract(substr(url, a + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
  coalesce(CASE WHEN a > 0 THEN regexp_extract(substr(url, a + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path,
  translate(coalesce(url, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text, coalesce(substr(md5(url), 1, 1) < '4', false) AS held FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
o AS (SELECT rid, i, unicode(substr(text, i, 1)) AS c FROM (SELECT rid, text, unnest(range(1, length(text) + 1)) AS i FROM v)),
k AS (SELECT rid, i, CASE WHEN c BETWEEN 33 AND 96 THEN c - 33 ELSE 63 END AS c FROM o),
g AS (SELECT rid, i, c, {back} FROM k WINDOW w AS (PARTITION BY rid ORDER BY i)),
grams AS ({grams}),
known AS (SELECT v.ruled, d, w, c FROM grams JOIN v USING (rid) WHERE ruled IS NOT NULL AND NOT held),
counts AS (SELECT d, w, count(*) AS n FROM known WHERE d > 0 GROUP BY d, w),
often AS (SELECT *, row_number() OVER (ORDER BY n DESC, w) AS place FROM counts WHERE n >= {least}),
kept AS (SELECT d, w FROM often WHERE n > coalesce((SELECT n FROM often WHERE place = {states + 1}), 0) UNION ALL SELECT 0, 1),
n AS (SELECT ruled, d, w, c, count(*) AS n FROM known JOIN kept USING (d, w) GROUP BY ALL),
t AS (SELECT ruled, d, w, sum(n) AS s, count(*) AS t FROM n GROUP BY ALL),
cells AS (SELECT x.ruled, kept.d, kept.w, c.c, t.s, t.t, coalesce(n.n, 0) AS n FROM kept, (VALUES ('block'), ('allow')) x(ruled), range(64) c(c)
  LEFT JOIN t ON t.ruled = x.ruled AND t.d = kept.d AND t.w = kept.w LEFT JOIN n ON n.ruled = x.ruled AND n.d = kept.d AND n.w = kept.w AND n.c = c.c),
p0 AS (SELECT ruled, w, c, CASE WHEN s IS NULL THEN 1 / 64 ELSE (n + t * (1 / 64)) / (s + t) END AS p FROM cells WHERE d = 0){levels},
p AS ({every}),
ratio AS (SELECT w, c, CAST(round(ln(b.p / a.p) * 10000) AS BIGINT) AS l FROM p b JOIN p a USING (w, c) WHERE b.ruled = 'block' AND a.ruled = 'allow'),
longest AS (SELECT rid, i, any_value(c) AS c, arg_max(w, d) AS w FROM grams JOIN kept USING (d, w) GROUP BY ALL),
s AS (SELECT v.rid, page_id, host, path, rule, ruled, held, coalesce(score, 0) AS score FROM v LEFT JOIN (SELECT rid, CAST(sum(l) AS DOUBLE) / (count(*) * 10000) AS score FROM longest JOIN ratio USING (w, c) GROUP BY 1) USING (rid)),
f AS (SELECT least(greatest(floor((score + 4) / 8 * 400), 0), 399) AS bin, ruled FROM s WHERE ruled IS NOT NULL AND held),
e AS (SELECT i, round((SELECT count(*) FROM f WHERE ruled = 'allow' AND bin < i) / (SELECT count(*) FROM f WHERE ruled = 'allow') + 1 - (SELECT count(*) FROM f WHERE ruled = 'block' AND bin < i) / (SELECT count(*) FROM f WHERE ruled = 'block'), 12) AS good FROM range(401) q(i)),
cut AS (SELECT -4.0 + 8.0 * arg_max(i, (good, -i)) / 400 AS cutoff FROM e),
parts AS (SELECT count(DISTINCT (ruled, held)) = 4 AS able FROM v WHERE ruled IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN able AND score >= cutoff THEN 'block' ELSE 'allow' END) AS verdict FROM s, cut, parts
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")), spans=True)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("offending"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_crf import fit, scan

    docs = read(spark, sf_dir, "documents")
    out = scan(docs, fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"), keep="max")


OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import grown, hash_tree_shards, tree_for

    tree = tree_for(8)
    return hash_tree_shards(read(spark, sf_dir, "documents"), tree, grown(tree, 8))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import align_texts

    return align_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(read(spark, sf_dir, "documents"), least=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON f.key = l.key GROUP BY rid
"""


def op13_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .changepoints import change_points

    return change_points(read(spark, sf_dir, "sale_lines").where(F.col("flag").isin("kept", "swapped")))


OP13_SQL = """
WITH RECURSIVE d AS (SELECT vendor_id, CAST(shipped_at AS DATE) - DATE '1970-01-01' AS day, sum(quantity) AS q
  FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
r AS (SELECT row_number() OVER () AS k, vendor_id, min(day) AS first, max(day) AS last FROM d GROUP BY vendor_id),
x AS (SELECT k, first, last - first + 1 AS n, u.i, coalesce(q, 0)::HUGEINT AS q FROM (SELECT *, unnest(range(first, last + 1)) AS i FROM r) u
  LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM u.vendor_id AND d.day = u.i),
c AS (SELECT *, sum(q) OVER w AS p, sum(q * q) OVER w AS pp FROM x WINDOW w AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, any_value(n) AS n, [0::HUGEINT] || list(p::HUGEINT ORDER BY i) AS p, [0::HUGEINT] || list(pp::HUGEINT ORDER BY i) AS pp FROM c GROUP BY k),
t AS (SELECT k, 0 AS e, n, p, pp, [{'cost': 0::BIGINT, 'cuts': 0::BIGINT, 's': 0::BIGINT}] AS best FROM s
  UNION ALL SELECT k, e + 1, n, p, pp, best || [list_min([{
      'cost': best[a + 1].cost + CASE WHEN a > 0 THEN 10000 ELSE 0 END + (e + 1 - a) * CAST(floor(1000 * ln(CAST(
        1 + ((e + 1 - a) * (pp[e + 2] - pp[a + 1]) - (p[e + 2] - p[a + 1]) * (p[e + 2] - p[a + 1])) // ((e + 1 - a) * (e + 1 - a)) AS DOUBLE))) AS BIGINT),
      'cuts': best[a + 1].cuts + 1, 's': a::BIGINT} for a in range(e + 1) if (a = 0 AND (e + 1 >= 5 OR e + 1 = n)) OR (a >= 5 AND e + 1 - a >= 5)])]
    FROM t WHERE e < n),
z AS (SELECT k, n, p, pp, best FROM t WHERE e = n),
b AS (SELECT k, n AS e, best[n + 1].s AS a FROM z UNION ALL SELECT b.k, b.a, z.best[b.a + 1].s FROM b JOIN z USING (k) WHERE b.a > 0),
g AS (SELECT r.vendor_id, k, r.first, a, e, e - a AS n, (p[e + 1] - p[a + 1])::BIGINT AS total, pp[e + 1] - pp[a + 1] AS squares, z.best[z.n + 1] AS whole FROM b JOIN z USING (k) JOIN r USING (k)),
v AS (SELECT *, (1 + (n * squares - total::HUGEINT * total) // (n * n))::BIGINT AS spread FROM g)
SELECT vendor_id, row_number() OVER (PARTITION BY k ORDER BY a) AS segment_no, first + a AS first_day, n::BIGINT AS n_days, total, spread,
  n * CAST(floor(1000 * ln(spread::DOUBLE)) AS BIGINT) AS cost, whole.cuts AS n_segments, whole.cost AS best_cost FROM v
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_chat, op3_bpe, op4_fingerprint, op5_mixing, op6_urls, op7_toxicity, op8_secrets, op9_exact_dedup, op10_sharding, op11_align, op12_line_dedup, op13_change_points)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op6_urls": _op6_sql(), "op9_exact_dedup": OP9_SQL, "op12_line_dedup": OP12_SQL, "op13_change_points": OP13_SQL}
