"""The native operators against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import chat, exact, fingerprint, mixing, queries, sharding, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [(1, "Abc é", "en", "a", 5), (2, "aBC é", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, "abc é", "en", "b", 5), (5, "x" * 200_000, "en", "b", 1), (6, "ABC É", "en", "b", 1), (6, "ABC É", "en", "b", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumns({"keep_id": F.lit("clash"), "_slot": F.lit(1), "size": F.lit("s"), "sketch": F.lit(0), "_s": F.lit(0), "odd.name": F.lit(1), "a`b.c": F.lit("x")})


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def oracle(sf, sql):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return sorted(map(tuple, c.execute(sql).fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op2_chat", "op6_urls", "op9_exact_dedup"])
def test_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    order = duckdb.connect().execute
    assert order("select 1").fetchall() == [(1,)]
    want = oracle(sf, queries.oracle_sql()[name])
    assert sorted(map(tuple, df.collect()), key=repr) == want


# exact dedup


def test_exact_edges(edge):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(edge, keep="max").collect()), key=str)
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, True)], key=str)
    kept = exact.drop_exact(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "6", "None"]
    assert exact.exact_groups(edge.where("false")).count() == 0


def test_exact_repeated_ids(spark):
    """A row that loses its group takes no other text of its id along."""
    rows = [(1, "a"), (2, "A"), (2, "only here"), (2, "b"), (3, "B"), (3, None), (4, ""), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_SHA", F.lit("clash"))
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, "a"), (2, "b"), (2, "only here"), (3, "None")]
    assert sorted((r.doc_id, str(r.text)) for r in exact.drop_exact(docs, keep="max").collect()) == [(2, "A"), (2, "a"), (2, "only here"), (3, "B"), (4, "")]


# sharding


def draw(key, node):
    seed = xxhash.xxh64_intdigest(str(key).encode(), 42) if key is not None else 42
    u = ((xxhash.xxh64_intdigest(node.name.encode(), seed) >> 11) + 0.5) / 2**53
    return -math.log(u) / node.total()


def place(key, node):
    while node.shard is None:
        node = min(node.children, key=lambda c: draw(key, c)) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_shards_match_plain_descent(spark, sf):
    tree = sharding.tree_for(8)
    more = sharding.grown(tree, 8)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (place(r.doc_id, tree), place(r.doc_id, more))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_confine_movement(spark):
    """A heavier shard only moves rows within its rack, region and into them."""
    a, b = sharding.tree_for(8), sharding.tree_for(8)
    b.children[1].children[0].children[0].weight = 3.0  # shard 4
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    rows = ids.select(sharding.shard_of(F.col("k"), a).alias("x"), sharding.shard_of(F.col("k"), b).alias("y")).collect()
    moved = Counter((r.x // 4, r.y // 4) for r in rows if r.x != r.y)
    assert moved[0, 0] == 0 == moved[1, 0]
    share = Counter(r.y for r in rows)
    assert abs(share[4] / 4000 - 0.3) < 0.04


def test_shard_edges(edge):
    rows = sharding.hash_tree_shards(edge, sharding.tree_for(3), sharding.grown(sharding.tree_for(3), 3), per_bucket=1).collect()
    assert len(rows) == len(EDGE)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(1, 0)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.hash_tree_shards(edge.where("false"), sharding.tree_for(3)).count() == 0


# mixing


def test_pfair_windows():
    for weights in ({"a": 1, "b": 1, "c": 5}, {"x": 0.7, "y": 0.29, "z": 0.01}, {"s": 3}, {chr(65 + i): i + 1 for i in range(20)}):
        q = mixing.quotas(weights, 100)
        plan = mixing.pfair_period(q)
        size = sum(q.values())
        assert sorted(p[4] for p in plan) == list(range(size))
        assert all(r <= t < d for _, _, r, d, t in plan)
        done = Counter()
        for s, _, _, _, t in sorted(plan, key=lambda p: p[4]):
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * q[x] / size) < 1 for x in q)


def test_schedule_follows_weights():
    """Over many periods of 1024, and with more sources than that, a source that
    lasts is less than one block from its weight's share at every slot."""
    sized = {k: float(v) ** 0.5 for k, v in {"a": 34, "b": 25, "c": 20, "d": 15, "e": 6}.items()}
    rare = {"a": 0.9999, "b": 0.0001}
    many = {f"s{i:04d}": 1.0 + i % 7 for i in range(1500)}
    for weights, slots in ((sized, 200_000), (rare, 200_000), (many, 10_000)):
        total = sum(weights.values())
        blocks = {s: math.ceil(slots * w / total) + 1 for s, w in weights.items()}
        done: dict[str, list[int]] = defaultdict(list)
        for s, k, r, d, t in mixing.pfair(weights, blocks):
            assert r <= t < d
            assert k == len(done[s])
            done[s].append(t)
        assert len({t for own in done.values() for t in own}) == sum(blocks.values())
        for s, own in done.items():
            w = weights[s] / total
            assert all(abs(k - t * w) < 1 + 1e-6 and abs(k + 1 - (t + 1) * w) < 1 + 1e-6 for k, t in enumerate(own) if t < slots)


def test_mix_many_sources(spark):
    """Weights count also where there are more sources than a period has blocks."""
    docs = spark.range(1100 * 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 99).alias("text"), (F.col("id") % 1100).cast("string").alias("source"))
    weights = {str(i): 3.0 if i < 100 else 1.0 for i in range(1100)}
    rows = mixing.mix(docs, weights=weights, block_bytes=100, period=3).select("row.source", "block", "release", "slot", "deadline").collect()
    assert len(rows) == 4400
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len({r.slot for r in rows}) == 4400
    for r in rows:
        w = weights[r.source] / 1300
        assert (r.release, r.deadline) == (int(r.block / w + 1e-9), math.ceil((r.block + 1) / w - 1e-9))


def test_mix_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, block_bytes=4000, period=64).select("row.*", *[F.col(c).alias(f"_{c}") for c in ("size", "block", "release", "deadline", "slot", "bucket", "in_bucket")]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    slot_of = {}
    for s, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: (r._block, r._bucket, r._in_bucket)):
            assert r._size == len(r.text.encode()) + 1
            assert r._block == at // 4000
            assert r._release <= r._slot < r._deadline
            assert slot_of.setdefault(r._slot, (s, r._block)) == (s, r._block)
            at += r._size
    order = [r.doc_id for r in mixing.mixed_order(docs, block_bytes=4000, period=64).collect()]
    at = {r.doc_id: r._slot for r in rows}
    assert [at[i] for i in order] == sorted(at.values())


def test_mix_edges(edge):
    for w in (None, {"a": 3.0, None: 1.0}):
        out = mixing.mixed_order(edge, weights=w, per_bucket=2)
        assert out.columns == edge.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))
    assert mixing.mix(edge.where("false")).count() == 0


# fingerprints


def sketch_of(text, width=5, scale=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = []
    for i in range(max(1, len(words) - width + 1) if words else 0):
        h = 42
        for w in words[i : i + width]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.append(struct.unpack("<q", struct.pack("<Q", h))[0])
    low = [h for h in out if h < -(1 << 63) + (1 << 64) // scale]
    return sorted(set(low or out and [min(out)]))


def test_probe_matches_plain_python(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op4_fingerprint(spark, sf).collect()}
    like = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b))) if a or b else 1.0
    hexed = lambda s: "".join(f"{h & (2**64 - 1):X}" for h in s)
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch_of(t), sketch_of(edited), sketch_of(nxt)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(b))
        assert r.near_edited == pytest.approx(like(a, b))
        assert r.near_next == pytest.approx(like(a, c))


def test_merge_and_containment(spark):
    """Sketches of parts merge to the sketch of all; unequal texts compare."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(60):
        a, b = [word() for _ in range(rng.choice([0, 3, 6, 9, 60]))], [word() for _ in range(rng.choice([0, 4, 7, 30]))]
        rows.append((i, " ".join(a), " ".join(b), " ".join(b + [word() for _ in range(3000)])))
    df = spark.createDataFrame(rows, "i long, a string, b string, long string")
    for scale in (8, 1):
        s = {c: fingerprint.sketch(F.col(c), 5, scale) for c in ("a", "b", "long")}
        for r in df.select("*", fingerprint.merge(s["a"], s["b"], scale).alias("m"), fingerprint.containment(s["b"], s["long"], scale).alias("c"), s["b"].alias("s")).collect():
            low = -(1 << 63) + (1 << 64) // scale if scale > 1 else 1 << 63
            every = sorted({*sketch_of(r.a, 5, 1), *sketch_of(r.b, 5, 1)})
            kept = [h for h in every if h < low]
            assert r.m == (kept or every[:1])
            own = [h for h in r.s if h < low]
            # short texts are one shingle, which no longer text has
            assert r.c == (None if not own else 1.0 if len(r.b.split()) >= 5 else 0.0)


def test_next_over_buckets(spark):
    ids = [5, -3, 7, 7, 100, 10**12, None, 8, 9, 2**62]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id bigint, text string").withColumn("_tie", F.col("text"))
    want = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for per, edges in ((1, 256), (1, 2), (3, 4), (100, 256)):
        got = {r.text: r.next_text for r in fingerprint.with_next(rows, ["text"], per_bucket=per, edges=edges).collect()}
        assert got == {t: want[(k + 1) % len(want)][1] for k, (_, t) in enumerate(want)}


def test_fingerprint_edges(edge):
    assert fingerprint.edit_probe(edge).count() == len(EDGE)
    one = fingerprint.edit_probe(edge.where("doc_id = 1")).collect()
    assert one[0].edited == "Abc" + "Ab"
    assert fingerprint.edit_probe(edge.where("false")).count() == 0


# URLs


PAGES = [None, "", "no scheme", "http://NET/x", "https://a.example.net/en/1?q=/", "https://A.Example.COM/de/#x", "http://x.org/fr/", "http://x.org/fr", "http://net", "http://notnet/", "ftp://h.org?x=/fr/", "://?#", "http://ünïcode.org/FR/"]


def parts(u):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", u or "")
    return (lower(m.group(1)), m.group(2)) if m else ("", "")


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)) + [(3, "http://NET/x")], "page_id bigint, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    for r in urls.judge_urls(pages, queries.URL_RULES).collect():
        host, path = parts(PAGES[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = [(len(x), x, v) for v, x in queries.URL_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        assert r.rule == (max(fit)[1] if fit else None)
        assert r.verdict == max(fit)[2] if fit else r.verdict in ("allow", "block")
    assert urls.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages.where("url is null"), queries.URL_RULES).collect()} == {"allow"}


def plain_url_model(urls_, ruled, order, least):
    """P(c | longest frequent context) of one class, by dictionaries of strings."""
    code = lambda c: c if 33 <= ord(c) <= 96 else "`"  # noqa: E731  (the last symbol stands for all others)
    text = {u: "".join(map(code, (u or "").translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))) for u in urls_}
    known = [(v, text[u]) for u, v in ruled if hashlib.md5(u.encode()).hexdigest()[0] >= "4"]
    contexts = Counter(t[i - d : i] for _, t in known for i in range(len(t)) for d in range(1, min(order, i) + 1))
    kept = {w for w, n in contexts.items() if n >= least} | {""}
    seen = {v: defaultdict(Counter) for v in ("block", "allow")}
    for v, t in known:
        for i, c in enumerate(t):
            for d in range(min(order, i) + 1):
                if t[i - d : i] in kept:
                    seen[v][t[i - d : i]][c] += 1

    def prob(v, w, c):
        base = 1 / 64 if not w else prob(v, w[1:], c)
        row = seen[v][w]
        return (row[c] + len(row) * base) / (sum(row.values()) + len(row)) if row else base

    def score(u):
        t, total = text[u], 0
        for i, c in enumerate(t):
            w = next(t[i - d : i] for d in range(min(order, i), -1, -1) if t[i - d : i] in kept)
            total += round(math.log(prob("block", w, c) / prob("allow", w, c)) * 10_000)
        return total / (10_000 * len(t)) if t else 0.0

    return score


def test_url_model_matches_plain(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for order, least in ((4, 50), (2, 5), (5, 3)):
        rows = urls.judge_urls(pages, queries.URL_RULES, order=order, least=least).collect()
        text = {r.page_id: r.url for r in pages.collect()}
        score = plain_url_model(set(text.values()), [(text[r.page_id], r.verdict) for r in rows if r.rule], order, least)
        assert len({len(str(r.score)) for r in rows}) > 1
        for r in rows:
            assert r.score == pytest.approx(score(text[r.page_id]), abs=2e-4)


def test_url_chain():
    """Moves keep the longest end; the number of states is bounded by counts."""
    code = lambda t: sum(b * 64 ** (len(t) - 1 - i) for i, b in enumerate(t)) + 64 ** len(t)
    chain = urls.Chain([code(t) for t in ([1], [2], [1, 2], [2, 1], [1, 2, 1])], 3)
    moves, at = chain.moves(), 0
    walked = []
    for c in (1, 2, 1, 2, 5, 2, 1):
        at = moves[at * 64 + c]
        walked.append(chain.names[at])
    assert walked == [code(t) for t in ([1], [1, 2], [1, 2, 1], [1, 2], [], [2], [2, 1])]
    p = chain.probs({(0, 3): 2, (chain.index[code([1, 2])], 4): 5})
    for s in range(len(chain.names)):
        assert sum(p[s * 64 : s * 64 + 64]) == pytest.approx(1)


def test_url_states_are_bounded(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a = urls.judge_urls(pages, queries.URL_RULES, least=1, states=40).collect()
    assert len(a) == pages.count()
    assert any(r.score for r in a)


def test_url_long(spark, sf):
    """A URL of a million characters, in linear time."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(-1, "http://x.net/" + "ab/" * 300_000), (-2, "x" * 900_000)], "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages.unionByName(more), queries.URL_RULES).where("page_id < 0").collect()}
    assert (got[-1].verdict, got[-2].host) == ("block", "")


def test_url_accuracy(spark):
    """Balanced accuracy on ruled URLs that neither model has counted."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.judge_urls(pages, queries.URL_RULES).where("rule is not null and held_out").select("verdict", "score").collect()
    scores = {v: sorted(r.score for r in rows if r.verdict == v) for v in ("block", "allow")}
    best = max((sum(s >= c for s in scores["block"]) / len(scores["block"]) + sum(s < c for s in scores["allow"]) / len(scores["allow"])) / 2 for c in scores["block"])
    assert best > 0.95


# chat


def test_reply_tree(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good </turn>\n### user: \\t", 0.9), ("t", 4, 3, "user", "thx", 0.5), ("t", 5, 99, "a:b\\c", None, None)]
    rows = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {r.leaf: r for r in chat.format_trees(rows, best=None).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {2, 4, 5}
    assert [(t.role, t.text) for t in got[4].turns] == [("user", "q"), ("assistant", nodes[2][4]), ("user", "thx")]
    assert [(t.role, t.text) for t in got[5].turns] == [("a:b\\c", "")]
    assert got[4].loss == nodes[2][4]
    assert got[4].branch == 1
    assert [r.leaf for r in chat.format_trees(rows).collect()] == [4]
    loop = spark.createDataFrame([("t", 1, 2, "u", "x", 0.0), ("t", 2, 1, "u", "x", 0.0)], rows.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(loop)
    assert chat.format_trees(rows.where("false")).count() == 0


def test_branches_against_plain_walks(spark):
    """Random trees with unequal scores: each branch's rank and turns."""
    rng = random.Random(6)
    rows = []
    for tree in "abc":
        for i in range(120):
            rows.append((tree, i, None if i < 2 else rng.randrange(max(0, i - 9), i), "user", f"{tree}{i}", rng.choice([None, rng.random()])))
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    info = {(r[0], r[1]): r for r in rows}
    want = {}
    for tree in "abc":
        parents = {r[2] for r in rows if r[0] == tree}
        walks = []
        for leaf in set(range(120)) - parents:
            walk, at = [], leaf
            while at is not None:
                walk.append(info[tree, at])
                at = walk[-1][2]
            walks.append((-sum(w[5] or 0 for w in walk) / len(walk), leaf, [w[4] for w in reversed(walk)]))
        for k, (_, leaf, texts) in enumerate(sorted(walks)):
            want[tree, k + 1] = (leaf, texts)
    for best in (1, 3, None):
        got = chat.format_trees(nodes, best=best).select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()
        assert {(r.tree, r.branch): (r.leaf, [t.text for t in r.turns]) for r in got} == {k: v for k, v in want.items() if best is None or k[1] <= best}


def test_comb_is_not_listed(spark):
    """A spine with a leaf at each node: pointers stay linear, one path is listed."""
    n = 600
    rows = [("t", i, i - 1 if i else None, 0.0) for i in range(n)] + [("t", n + i, i, float(i == 300)) for i in range(n)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    scored, jumps = chat.branches(nodes)
    assert scored.count() == n
    assert max(j.count() for j in jumps) <= 2 * n
    top = scored.orderBy(F.desc("score"), "leaf").limit(1).withColumn("branch", F.lit(1))
    path = sorted((r.up, r.node) for r in chat.reply_paths(top, jumps).collect())
    assert path == [(0, n + 300), *((k + 1, 300 - k) for k in range(301))]


def test_long_chain_and_repeats(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"### {t} \\h" * (t % 3)) for t in range(300)] + [(2, 0, None, None), (2, 0, None, None), (None, 5, "user", "x" * 100_000)]
    out = chat.format_trees(chat.threads(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit("clash"))))
    got = {r.tree: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [t.text for t in got["1"].turns] == [r[3] for r in rows[:300]]
    assert got["2"].n_turns == 2
    assert got[""].turns[0].text == "x" * 100_000


def test_mixing_blocks_are_bounded(spark):
    """Blocks grow with the input: never more than ``most_blocks`` and one a source."""
    docs = spark.createDataFrame([(i, "x" * (i % 50), None, f"s{i % 3}", 0) for i in range(3000)], DOCS)
    out = mixing.mix(docs, carry=["doc_id"], block_bytes=64, most_blocks=40).collect()
    total = sum(r["size"] for r in out)
    slots = {r.slot for r in out}
    assert len(out) == 3000 and total / 64 > 1000 and len(slots) <= max(slots) + 1 <= 43
    small = mixing.mix(docs, carry=["doc_id"], block_bytes=64).collect()
    assert len({r.slot for r in small}) > 1000
