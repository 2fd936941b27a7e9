"""Toxicity, URLs, sharding, search, mixing, embeddings, components, pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embed_dedup, graph, mixing, queries, sharding, topk, toxicity, urlfilter
from lodestone.llm.common import ranked_within

BIG = "/root/testdata/sf0.1"


def test_registry():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(rel.columns)
    ours = queries.queries()[name](spark, sf_dir)
    assert sorted(ours.columns) == columns
    theirs = [tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()]
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(theirs)


@pytest.mark.parametrize("name", ["op7_topk", "op10_embeddings"])
def test_vectors_against_sql(spark, sf_dir, name):
    against_sql(spark, sf_dir, name)


# ------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_rows(spark):
    found = queries.op1_toxicity(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out")
    got = {(r["toxic"], r["predicted"]): r["n"] for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert got[1, 1] >= 0.75 * (got[1, 1] + got.get((1, 0), 0))
    assert got.get((0, 1), 0) <= 0.01 * got[0, 0]


def test_toxicity_learns_a_pair(spark):
    """Each of two words is harmless alone and toxic with the other."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"n{k}" for k in range(50)], k=10) + ["foo"] * a + ["bar"] * b
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    probe = [set(), *[model.features(t, set(), {}) for t in ("foo", "bar", "foo bar")]]
    s = model.scores(probe)
    assert s[3] > 0.7 and max(s[:3]) < 0.5


def test_toxicity_score_is_the_sum_over_pairs(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.arange(30), -0.3, rng.standard_normal(30), 0.4 * rng.standard_normal((30, 8)))
    rows = [set(), {4}, *[set(rng.choice(30, k, replace=False).tolist()) for k in (2, 5, 12, 30)]]
    for found, terms in zip(model.scores(rows), rows, strict=True):
        t = sorted(terms)
        z = model.bias + sum(model.w[i] for i in t) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(t) for j in t[:k])
        assert found == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_learns_once_from_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "bad words here", 0)] * 50 + [(2, "kind words there", 0)] + [(3, "bad again", 0)], "doc_id long, text string, toxicity_score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    once = toxicity.learn(docs.dropDuplicates(), labels, F.lit(True))
    assert model.bias == once.bias and (model.w == once.w).all()
    got = toxicity.score(docs, model, name="toxicity_score")
    assert got.columns == ["doc_id", "text", "toxicity_score"] and got.count() == 52


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "x" * 10_000, 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.judge(docs, none, F.lit(True)).collect()
    assert len(got) == 4 and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in got)
    all_toxic = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    assert all(r["predicted"] == 1 for r in toxicity.judge(docs, all_toxic, F.lit(True)).collect())
    assert toxicity.judge(docs.limit(0), none, F.lit(True)).collect() == []


# ------------------------------------------------------------ URLs


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def rule_by_hand(host, path):
    fits = [(len(r), r) for r, _ in urlfilter.RULES for n, p in [r.split("/", 1)] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
    return max(fits)[1] if fits else None


URLS = [
    None, "", "nothing", "http://A.Example.ORG/es/x?y", "https://org", "https://org/", "http://x.org?q=/a", "://", "http://h/p#f?g", "http://example.org/en/1", "http://sub.example.org/en/12",
    "http://example.org/en/2", "http://a.com/fr/", "http://com/de/x", "http://acom/de/x", "http://É.COM/de/\nx", "x://y://z.org/a", "http://a.org/" + "x" * 5000,
]


def test_urls(spark, sf_dir):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path = split_by_hand(url)
        rule = rule_by_hand(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == dict(urlfilter.RULES)[rule] if rule else got[i]["verdict"] in ("allow", "block")


def test_url_model_by_hand():
    """The vectorised model against the recursion, on exact counts."""
    texts = [b"http://a.org/x", b"", b"abcabc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    contexts, joints, rows = urlfilter.slots(data, offsets)
    tables = np.zeros((2, 2, urlfilter.SLOTS))
    for y, pick in ((0, rows == 2), (1, rows == 0)):
        tables[y, 0] = np.bincount(contexts[:, pick].ravel(), minlength=urlfilter.SLOTS)
        tables[y, 1] = np.bincount(joints[:, pick].ravel(), minlength=urlfilter.SLOTS)
    got = urlfilter.ratios(tables, data, offsets)

    def logp(text, corpus):
        total, text = 0.0, b"\2" * urlfilter.ORDER + text + b"\3"
        corpus = b"\2" * urlfilter.ORDER + corpus + b"\3"
        for i in range(urlfilter.ORDER, len(text)):
            p = 1 / 256
            for k in range(urlfilter.ORDER + 1):
                places = range(urlfilter.ORDER, len(corpus))
                seen = [j for j in places if corpus[j - k : j] == text[i - k : i]]
                both = sum(corpus[j] == text[i] for j in seen)
                p = (both + urlfilter.SMOOTH * p) / (len(seen) + urlfilter.SMOOTH)
            total += np.log(p)
        return total / (len(text) - urlfilter.ORDER)

    want = [logp(t, texts[0]) - logp(t, texts[2]) for t in texts]
    assert got == pytest.approx(want)


def test_url_scores_are_of_exact_counts(spark):
    """So many n-grams that a table of fixed size would mix them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-_", k=40))
    rows = [(i, f"http://x.{('org', 'example.org/es', 'net')[i % 3]}/{word()}") for i in range(2400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    held = {r["url"] for r in df.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    counts = {"allow": {}, "block": {}}
    steps = lambda url: ((url[i - k : i], url[i]) for url in ["\2" * urlfilter.ORDER + url + "\3"] for i in range(urlfilter.ORDER, len(url)) for k in range(urlfilter.ORDER + 1))
    for i, url in rows:
        if got[i]["rule"] and url not in held:
            own = counts[got[i]["verdict"]]
            for context, char in steps(url):
                own[context] = own.get(context, 0) + 1
                own[context, char] = own.get((context, char), 0) + 1
    for i, url in rows[2:120:3]:
        total = 0.0
        for label, sign in (("allow", 1), ("block", -1)):
            p = 1 / 256
            for context, char in steps(url):
                p = 1 / 256 if not context else p
                p = (counts[label].get((context, char), 0) + urlfilter.SMOOTH * p) / (counts[label].get(context, 0) + urlfilter.SMOOTH)
                total += sign * np.log(p) * (len(context) == urlfilter.ORDER)
        assert got[i]["score"] == pytest.approx(total / (len(url) + 1), abs=1e-9)


def test_url_edges(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(df).collect() == []
    one = urlfilter.judge(spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a")], "page_id long, url string")).collect()
    assert [(r["verdict"], r["score"]) for r in one] == [("allow", 0.0)] * 2
    assert urlfilter.cut_at([(0, 100, 5), (1, 3000, 5)]) < 0.1


# ------------------------------------------------------------ sharding


def test_sharding_law_and_cut(spark):
    rng = random.Random(2)
    texts = [f"single {i}" for i in range(700)] + [f"group {i}" for i in range(60) for _ in range(rng.randrange(2, 8))] + ["hot"] * 400 + ["", None, None]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, "x", 0)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 10).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 10
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text_of = {r["doc_id"]: r for r in got}
    places = {}
    for i, t in enumerate(texts):
        places.setdefault(t or "", set()).add(text_of[i]["shard"])
    groups = [places[t] for t in places if t.startswith("group")]
    assert sum(len(p) == 1 for p in groups) >= 0.8 * len(groups)
    assert text_of[700]["size"] == len(texts[700]) + 16 and {r["law"] for r in got} == {"rows"}


def test_sharding_with_a_hot_id_and_long_texts(spark, monkeypatch):
    """One id and one text in a third of the rows, in cells of few rows."""
    monkeypatch.setattr(sharding, "CELL", 2)
    monkeypatch.setattr(sharding, "SPREAD", 7)
    rows = [(1, "same")] * 150 + [(None, None)] * 50 + [(i, f"t{i // 2}") for i in range(2, 250)] + [(900, "x" * 3_000_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert [r["size"] for r in got if r["doc_id"] == 900] == [3_000_016]
    # Fewer linked pairs are cut than where documents stay where they start.
    pairs = [(r["doc_id"], r["shard"]) for r in got if r["doc_id"] is not None and 2 <= r["doc_id"] < 250]
    place = dict(pairs)
    cut = sum(place[i] != place[i + 1] for i in range(2, 250, 2))
    assert cut <= 0.5 * 124 * 7 / 8


def test_sharding_of_nothing_and_of_few(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = sharding.shard(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)


def test_ranks(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(7)], "k string, v int")
    got = ranked_within(df, ["k"], [F.col("v")], (F.col("v") / 10).cast("int"), "r").collect()
    assert all(r["r"] == r["v"] for r in got)


# ------------------------------------------------------------ top-k


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [-1.0, -2.0]), (None, [1.0, 1.0]), (1, [1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id").isin(0, 4, 7), k=3, scale=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 19), (0, 2, 1, 5), (0, 3, 2, 5), (7, 1, 0, 0), (7, 2, 1, 0), (7, 3, 1, 0)]
    pooled = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in topk.top_k(pooled, F.col("vec_id") == 0, k=3, scale=1.0).orderBy("rank").collect()] == [(1, 2, 6), (2, 2, 6), (3, 2, 3)]
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.top_k(huge, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


def test_topk_with_repeated_ids_against_sql(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.standard_normal(4).tolist()) for i in rng.integers(0, 120, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    ours = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    theirs = con.sql(queries.oracle_sql()["op7_topk"]).fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs) and len(theirs) == 15


def test_topk_parts_merge(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 37)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 6)) * (rng.random((300, 6)) < 0.5)
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, scale=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 300, 10):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:4]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(order)}


# ------------------------------------------------------------ mixing


def test_shares():
    assert mixing.shares(100, [1, 1], [1000, 1000]) == [50, 50]
    assert mixing.shares(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.shares(100, [1, 1], [10, 20]) == [10, 20]
    assert mixing.shares(7, [1, 1, 1], [9, 9, 9]) == [3, 2, 2]
    assert mixing.shares(5, [0, 1], [9, 2]) == [0, 2]


def test_shortages_go_to_siblings_first():
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.budgets(tokens, {}, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    assert mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, {}, 200, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}


def mixed_by_hand(rows, weights, share, epochs, seed):
    import hashlib

    leaves = {}
    for i, source, lang, n in rows:
        leaves.setdefault((lang or mixing.NONE, source or mixing.NONE), []).append((i, n))
    have = {p: sum(n for _, n in v) for p, v in leaves.items()}
    given = mixing.budgets(have, weights, int(share * sum(have.values())), epochs)
    out = []
    for p, docs in leaves.items():
        docs = [d for d in docs if d[1] > 0]
        if not have[p]:
            continue
        whole, rest = divmod(given[p], have[p])
        out += [(i, e) for i, _ in docs for e in range(whole)]
        keyed = {}
        for i, n in docs:
            key = hashlib.md5(f"{seed}|{whole}|{mixing.NONE if i is None else i}".encode()).hexdigest()
            keyed.setdefault(key, []).append((i, n))
        total = 0
        for key in sorted(keyed):
            total += sum(n for _, n in keyed[key])
            if total > rest:
                break
            out += [(i, whole) for i, _ in keyed[key]]
    return sorted(out, key=str)


@pytest.mark.parametrize("share, epochs", [(0.5, 2), (1.4, 2), (0.01, 1), (0.0, 1), (9.0, 3)])
def test_mixing(spark, share, epochs):
    rng = random.Random(5)
    rows = [(i, rng.choice(["s1", "s2", None]), rng.choice(["en", "de", None]), rng.choice([0, 1, 5, 50, 400])) for i in range(300)] + [(3, "s1", "en", 5)] * 2 + [(None, "s2", "de", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    weights = {("en",): 3.0, ("de", "s1"): 2.0}
    levels = [F.col("lang"), F.col("source")]
    got = mixing.mix(df, levels, F.col("n"), weights=weights, share=share, max_epochs=epochs).collect()
    want = mixed_by_hand(rows, weights, share, epochs, mixing.SEED)
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == want
    clash = df.withColumn("path_", F.lit(1)).withColumn("times_", F.lit(1))
    chosen = mixing.choose(clash, levels, F.col("n"), weights=weights, share=share, max_epochs=epochs, copies=True)
    assert chosen.columns == clash.columns and sorted((r["doc_id"] for r in chosen.collect()), key=str) == sorted((i for i, _ in want), key=str)


def test_the_leaves_of_a_mix_need_no_python_worker(spark, monkeypatch):
    """A table made from Python rows passes plain Python workers, which executors keep beside those for Arrow."""
    df = spark.createDataFrame([(i, "s1", "en", "a b c") for i in range(20)], "doc_id long, source string, lang string, text string")
    made, make = [], type(spark.sparkContext).parallelize
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda self, *a, **b: made.append(a) or make(self, *a, **b))
    assert mixing.mix(df, queries.mix_levels(), mixing.n_words(F.col("text"))).collect()
    assert not made


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df, queries.mix_levels(), mixing.n_words(F.col("text"))).collect() == []


# ------------------------------------------------------------ embeddings


def test_hadamard_and_codes():
    x = np.random.default_rng(1).standard_normal((5, 8))
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embed_dedup.hadamard(x), x @ h / np.sqrt(8))
    own, probe = embed_dedup.codes(x, 0, 2)
    assert (own != probe).all() and own.max() < 16 * 16


def linked_by_hand(rows, least):
    unit = []
    for i, v, label in rows:
        ok = i is not None and v and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    link = [[a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and float(unit[a] @ unit[b]) >= least for b in range(n)] for a in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[a], *[comp[b] for b in range(n) if link[a][b]]]) if comp[a] is not None else None for a in range(n)]
        if new == comp:
            break
        comp = new
    return [(rows[a][0], sum(link[a]), comp[a]) for a in range(n)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.7:
            base = rows[int(rng.integers(len(rows)))]
            v = np.array(base[1]) + rng.choice([0.0, 0.02, 0.1]) * rng.standard_normal(16)
            rows.append((1000 - i, v.tolist(), base[2]))
        else:
            rows.append((1000 - i, rng.standard_normal(16).tolist(), int(rng.integers(3))))
    hot = rng.standard_normal(16)
    rows += [(2000 + i, (hot + 0.01 * rng.standard_normal(16)).tolist(), 1) for i in range(60)] + [(3000 + i, hot.tolist(), 1) for i in range(20)]
    rows += [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] + [1.0] * 15, 1), (4, hot.tolist(), None), (5, [None] + [1.0] * 15, 1), (6, (hot * 5).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(0)).repartition(4)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    want = linked_by_hand(rows, 0.93)
    found, there = sum(r["n_links"] for r in got.values()), sum(w[1] for w in want)
    assert len(got) == len(rows) and 0.97 * there <= found <= there
    wrong = [w for w in want if (got[w[0]]["n_links"], got[w[0]]["component_id"]) != w[1:]]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("bucket, functions", [(1 << 20, 1), (100, 2), (4, 3)])
def test_embedding_links_at_the_threshold(spark, monkeypatch, bucket, functions):
    """Pairs just above 0.93 are found whatever number of hashes a code has."""
    monkeypatch.setattr(embed_dedup, "BUCKET", bucket)
    counted = []
    real = embed_dedup.tables_for
    monkeypatch.setattr(embed_dedup, "tables_for", lambda size, width, f, least: counted.append(f) or real(size, width, f, least))
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for i in range(600):
        x = unit(rng.standard_normal(64))
        z = rng.standard_normal(64)
        y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * unit(z - (x @ z) * x)
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, y.tolist(), i)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = sum(r["n_links"] for r in embed_dedup.near_duplicates(df).collect())
    assert counted == [functions] and found >= 0.997 * 2 * 600


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [2.0], "a"), (None, [1.0, 0.0], "a"), (3, [1.0, 0.0], "b")]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)


# ------------------------------------------------------------ components and pipeline


@pytest.mark.parametrize("one_task", [250_000, 40, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)] + [(5000, 5000)]
    got = {r["id"]: r["component_id"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    label = {v: v for e in edges for v in e}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert got == {v: root(v) for v in label}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)
    first = stage["toxicity"](spark, docs, sf_dir)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    lines = stage["line_dedup"](spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.where("n_chars <> char_length(text)").count() == docs.where("n_chars <> char_length(text)").count()
    near = stage["near_duplicates"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    from test_text_ops import components

    want = {ids[i] for i, c in enumerate(components(texts, 5, 80)[1]) if c == i}
    assert {r["doc_id"] for r in near.collect()} == want
    mixed = stage["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    out = pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage on what the one before kept: lines and near-duplicates by hand,
    tokens by the library; only toxic documents go in the first."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    import public_tokenizers
    from test_text_ops import components, removed_by_hand
    from tokenizers import Tokenizer

    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id", "text").collect()]
    start = rows(kept)
    from lodestone.llm.common import saved

    kept = saved(stage["toxicity"](spark, kept, sf_dir))
    first = rows(kept)
    assert set(first) <= set(start) and len(first) >= 0.9 * len(start)
    kept = saved(stage["line_dedup"](spark, kept, sf_dir))
    gone = removed_by_hand([t for _, t in first], 80, 5)
    want = []
    for n, (d, text) in enumerate(first):
        lines = text.split("\n")
        left = [x for k, x in enumerate(lines) if (n, k) not in gone]
        if len(left) == len(lines) or "".join(left).strip():
            want.append((d, "\n".join(left)))
    second = rows(kept)
    assert second == want
    kept = saved(stage["near_duplicates"](spark, kept, sf_dir))
    label = components([t for _, t in second], 5, 80)[1]
    third = rows(kept)
    assert third == [second[i] for i, c in enumerate(label) if c == i]
    kept = saved(stage["mixing"](spark, kept, sf_dir))
    fourth = rows(kept)
    assert set(fourth) <= set(third) and max(fourth.count(r) for r in set(fourth)) <= 2
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    library.no_padding()
    library.no_truncation()
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stage["encoding"](spark, kept, sf_dir).collect())
    told = [library.encode(t, add_special_tokens=False).ids for _, t in fourth]
    assert got == sorted((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for (d, _), x in zip(fourth, told, strict=True))


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    line = "one two three four five six seven"
    data = [(1, line, "en", "src0", 1), (1, line, "en", "src0", 1), (2, None, None, None, None), (None, f"{line}\nother", "en", "src0", 9), (3, "", "de", "src1", 0), (4, f"{line} eight\n" + "long " * 200_000, "en", "src2", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 AS toxicity_score", "2 AS n_removed", "3 AS late_", "4 AS component_id", "5 AS n_tokens", "6 AS path")
    ids = {}
    for name, stage in pipeline.STAGES:
        got = stage(spark, clash, sf_dir)
        if name != "encoding":
            assert got.columns == docs.columns, name
        ids[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.select("doc_id").collect())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    every = sorted((d[0] is None, d[0] or 0) for d in data)
    assert ids["toxicity"] == ids["line_dedup"] == ids["encoding"] == every
    assert ids["near_duplicates"] == every
    assert len(ids["mixing"]) <= 2 * len(data)
