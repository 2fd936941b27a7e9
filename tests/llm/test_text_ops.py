"""Line dedup, n-gram join, licences and BPE against brute force on fixtures."""

import hashlib
import random
import re
import struct
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, license_scan, line_dedup, ngram_join

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def near_texts(seed, n=120):
    """Random texts, with copies and variants of a few of them."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            words = spaced(rng.choice(texts) or "") or ["x"]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(WORDS)]
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 5, 8, 20, 60, 150]))))
    return texts


ODD = ["", None, "   \n ", "one", "A b", "a B", "é\u00a0x \u2003 y z", "word " * 500, "z" * 5000, None, "a b"]


def components(texts, size, percent):
    sets = []
    for t in texts:
        w = spaced(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(0, len(w) - size + 1))} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3), (2, 95, 4)])
def test_jaccard_components(spark, size, percent, seed):
    texts = near_texts(seed) + ODD
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_shingles", F.lit("clash")).repartition(5)
    got = ngram_join.jaccard_components(df, size=size, percent=percent).orderBy("doc_id").collect()
    sizes, label = components(texts, size, percent)
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == label


def test_jaccard_edges(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "A b C d e"), (None, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None), (7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 0, None)], key=str)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = rng.choices(WORDS, k=80)
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2])):
            words[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = ngram_join.jaccard_components(df).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == components(texts, 4, 85)[1]


def test_one_allocation_covers_the_tolerance():
    for percent in (50, 80, 85, 95):
        layout = ngram_join.Layout(percent)
        for (m, two), low, high in zip(layout.plan[:40], layout.low, layout.low[1:], strict=False):
            assert m + two > layout.tolerance(high - 1, (high - 1) * 100 // percent), (low, m, two)


def removed_by_hand(texts, percent, least):
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            s = set(spaced(lower(line)))
            if len(s) < least:
                continue
            if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.add((d, k))
            seen.append(s)
    return gone


@pytest.mark.parametrize("percent, least, seed", [(80, 5, 1), (60, 3, 2), (90, 1, 3)])
def test_line_dedup(spark, percent, least, seed):
    lines = near_texts(seed, 150)
    rng = random.Random(seed)
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 6))) for _ in range(60)] + ["", None, "\n\n", "a b c d e f\r\nA b c d e f\n", "z " * 3000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, late_ int").repartition(4)
    got = line_dedup.dedup_lines(df, percent=percent, least=least, counted=True).orderBy("doc_id").collect()
    gone = removed_by_hand(texts, percent, least)
    assert gone
    for d, (row, t) in enumerate(zip(got, texts, strict=True)):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        assert row["text"] == want and row["late_"] == d
        assert row["n_removed"] == sum(a == d for a, _ in gone)


def test_line_dedup_second_round(spark):
    """More near candidates than a bucket keeps, none of the nearest a match."""
    rng = random.Random(4)
    base = rng.sample(WORDS, 60)
    texts = [" ".join(base[: 60 - k] + rng.sample(WORDS, k)) for k in (5, 12, 13, 13, 14, 14, 15, 16, 7, 9, 11, 12) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = line_dedup.dedup_lines(df, counted=True).where("n_removed > 0").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in removed_by_hand(texts, 80, 5)}


TIGHT = line_dedup.Limits(hot=13, whole=6, lead=2, keep=1, local=4)  # frequent: counted twice or more


@pytest.mark.parametrize("percent, least, seed", [(80, 5, 1), (60, 4, 2), (90, 1, 3)])
def test_line_dedup_by_pairs_of_words_and_open_lines(spark, percent, least, seed):
    """Frequent words, buckets large in a task and in all, and the last round."""
    rng = random.Random(seed)
    base = rng.sample(WORDS, 30)
    lines = near_texts(seed, 100) + [" ".join(rng.sample(base, 26) + rng.sample(WORDS, rng.choice([2, 4, 6]))) for _ in range(80)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 6))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = line_dedup.removals(df.select(F.col("doc_id").alias("id"), "text"), percent, least, TIGHT).collect()
    assert {tuple(r) for r in got} == removed_by_hand(texts, percent, least)
    assert len(got) == len({tuple(r) for r in got})


def test_line_dedup_makes_no_more_rows_than_a_group_has_lines():
    """In a bucket a line makes one row, however many lines before it are similar."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(24)]

    class Held:
        value = np.full(line_dedup.COUNTERS, 30, np.uint8)

    def rows(n):
        texts = [" ".join([f"own{i}" if j == k else w for j, w in enumerate(base)]) for i, k in enumerate(rng.choices(range(24), k=n))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["id", "text"])
        made = Counter()
        for out in line_dedup._pack(Held, 80, 5, 8, line_dedup.LIMITS)(iter([batch])):
            out = out.take(pc.sort_indices(out["part"]))
            for x in line_dedup._match(80, line_dedup.LIMITS)(iter([out])):
                made.update(zip(x["doc"].to_pylist(), x["key"].to_pylist(), strict=True))
        return made

    few, many = rows(5), rows(25)
    assert max(many.values()) == 1
    assert len({d for d, _ in many}) == 24  # all but the first have a candidate
    assert many.total() <= 8 * few.total()


def test_line_dedup_reads_buckets_of_open_lines_again(spark):
    """Each line of a large family is asked for by frequent pairs of words in
    several buckets, and only its farther candidates match."""
    rng = random.Random(9)
    base = rng.sample(WORDS, 40)
    texts = [" ".join(base[: 40 - k] + rng.sample(WORDS, k)) for k in rng.choices([3, 5, 6, 7, 8, 9], k=120)]
    df = spark.createDataFrame([(i, "x y\n\n" + t) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = line_dedup.removals(df.select(F.col("doc_id").alias("id"), "text"), 80, 5, TIGHT).collect()
    assert sorted(map(tuple, got)) == sorted((d, 2) for d, _ in removed_by_hand(texts, 80, 5))


def python_steps(node, above=0):
    """The most Python steps that one task of a plan runs."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_steps(node.initialPlan(), above)
    here = 0 if "Exchange" in name else above + (name == "MapInArrow")
    below = [node.children().apply(i) for i in range(node.children().size())]
    return max([here, *(python_steps(x, here) for x in below)])


@pytest.mark.parametrize("module", [line_dedup, ngram_join])
def test_a_task_has_one_python_worker(spark, module, monkeypatch):
    most, write = [], module.saved

    def saved(df, *more):
        most.append(python_steps(df._jdf.queryExecution().executedPlan()))
        return write(df, *more)

    monkeypatch.setattr(module, "saved", saved)
    df = spark.createDataFrame(list(enumerate(near_texts(3))), DOCS)
    (module.dedup_lines if module is line_dedup else module.jaccard_components)(df).collect()
    assert max(most) == 1


def test_one_bitmap_reaches_the_driver(spark, monkeypatch):
    """However many tasks make its parts: sixteen of 1 MB at once, with their copies, swelled the driver's heap."""
    sizes = []

    def measured(take):
        def run(df):
            got = take(df)
            sizes.append(got.nbytes if isinstance(got, pa.Table) else sum(len(r["bits"]) for r in got))
            return got

        return run

    rows = spark.range(0, 20_000, 1, 16)
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(rows), name, measured(getattr(type(rows), name)))
    got = line_dedup.bitmap(rows, line_dedup.spots).value
    want = np.zeros(line_dedup.BITS, bool)
    want[line_dedup.spots(np.arange(20_000))] = True
    assert got == np.packbits(want).tobytes()
    assert 0 < sum(sizes) <= line_dedup.BITS // 8 + 4096
    assert line_dedup.bitmap(rows.where("id < 0"), line_dedup.spots).value == bytes(line_dedup.BITS // 8)
    assert line_dedup.bitmap(spark.createDataFrame([], "id long"), line_dedup.spots).value == bytes(line_dedup.BITS // 8)


def test_word_counts_reach_the_driver_packed(spark, monkeypatch):
    """16 MB of counters, most of them 0, swelled the driver's heap too; the table itself is the same."""
    sizes, texts = [], near_texts(4)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name in ("collect", "toArrow"):
        take = getattr(type(df), name)
        size = lambda got: got.nbytes if isinstance(got, pa.Table) else sum(len(r["body"]) for r in got)
        monkeypatch.setattr(type(df), name, lambda self, take=take: sizes.append(size(got := take(self))) or got)
    got = line_dedup.word_counts(df)
    body = np.frombuffer(lower("\n".join(t or "" for t in texts)).encode(), np.uint8)
    starts, ends, _ = line_dedup.words(body, np.array([0, len(body)]))
    want = np.bincount(line_dedup.bucket_of(line_dedup.word_hashes(body, starts, ends)).astype(np.int64), minlength=line_dedup.COUNTERS)
    assert np.array_equal(got, np.minimum(255, np.round(8 * np.log2(1.0 + want))).astype(np.uint8))
    assert 0 < sum(sizes) < 1 << 20


def test_a_worker_of_line_dedup_stays_small(spark):
    """One task reads 25 MB of text in one go and holds a few slices of it."""
    code = (
        "import random, resource, sys, numpy as np, pyarrow as pa\n"
        "from lodestone.llm import line_dedup as L\n"
        "rng = random.Random(1)\n"
        "words = [''.join(rng.choices('abcdefgh', k=6)) for _ in range(60000)]\n"
        "texts = ['\\n'.join(' '.join(rng.choices(words, k=40)) for _ in range(8)) for _ in range(11000)]\n"
        "batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=['id', 'text'])\n"
        "del texts\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "class Held: value = np.full(L.COUNTERS, 30, np.uint8)\n"
        "for _ in L._count(iter([batch.select([1])])): pass\n"
        "for out in L._pack(Held, 80, 5, 64, L.LIMITS)(iter([batch])):\n"
        "    for _ in L._match(80, L.LIMITS)(iter(out.slice(i, 1) for i in range(out.num_rows))): pass\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    root = Path(__file__).resolve().parents[2]
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(got.stdout.split()[-1]) < 160  # MB


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_regular_long_words_do_not_meet(spark, size):
    """Thue-Morse words and their complements, which polynomial hashes confuse."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rest = "c d e"
    df = spark.createDataFrame([(0, f"{x} {rest}"), (1, f"{y} {rest}")], DOCS)
    got = ngram_join.jaccard_components(df).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == [0, 1]
    same = line_dedup.dedup_lines(spark.createDataFrame([(0, f"{x} c d e f"), (1, f"{y} c d e f")], DOCS), percent=90, counted=True).collect()
    assert [r["n_removed"] for r in same] == [0, 0]


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "e d c b a")]
    got = sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "")], key=str)


def test_licences(spark):
    mit = dict(license_scan.TEMPLATES)["mit-permission"]
    changed = mit.replace("free of charge", "at no cost").replace("sublicense, ", "")
    texts = ["x y z. Released under the MIT License. more", "é Licensed under CC BY-NC 4.0.\n" * 2, mit.upper(), "a " * 500 + changed + " b", "the license of nothing", "", None, "Released under"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], DOCS + ", license string")
    got = license_scan.scan(df).orderBy("doc_id", "start").collect()
    found = [(r["doc_id"], r["license"]) for r in got]
    assert found == [(0, "mit-line"), (1, "cc-by-nc-4.0-line"), (1, "cc-by-nc-4.0-line"), (2, "mit-permission"), (3, "mit-permission")]
    assert [texts[r["doc_id"]][r["start"] : r["end"]] for r in got[:2]] == ["Released under the MIT License", "Licensed under CC BY-NC 4.0"]
    assert got[3]["coverage"] == 1 and 0.9 < got[4]["coverage"] < 1
    assert got[4]["start"] == 1000
    assert license_scan.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_licences_with_every_fifth_word_changed(spark):
    """The coverage decides whether a template is found, not its fingerprints."""
    for name, text in license_scan.TEMPLATES:
        words = re.findall(r"[A-Za-z0-9]+", text)
        rows, left = [], len(words) - len(words) // 5
        for first in range(5):
            changed = words.copy()
            for i in range(first, len(words), 5)[: len(words) // 5]:
                changed[i] = "zzz"
            rows.append((first, "Some words before. " + " ".join(changed) + ", and behind"))
        got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ((name, text),)).collect()
        assert sorted((r["doc_id"], r["matched_words"]) for r in got) == [(i, left) for i in range(5)], name


def unbanded(t, d):
    """Matched words and span of the best local alignment, by the full table."""
    rows = [[(0, 0, 0)] * (len(d) + 1) for _ in range(len(t) + 1)]  # score, matched, start
    best = (0, 0, 0, 0)
    for i, x in enumerate(t):
        for j, y in enumerate(d):
            s, m, a = rows[i][j]
            options = [(s + (2 if x == y else -1), m + (x == y), a if s > 0 else j)]
            options += [(s - 1, m, a) for s, m, a in (rows[i][j + 1], rows[i + 1][j])]
            top = max(options, key=lambda o: o[0])
            if top[0] > 0:
                rows[i + 1][j + 1] = top
                if top[0] > best[0]:
                    best = (*top, j + 1)
    return best[1:]


def test_licence_recall_against_unbanded_alignment(spark):
    """Words changed, dropped and put in, and foreign lines within a notice."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(120):
        name, text = rng.choice([t for t in license_scan.TEMPLATES if len(t[1]) < 900])
        words = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]
        changed = list(words)
        for _ in range(rng.randrange(len(words) // 5 + 1)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(WORDS)]])
        if len(words) > 30 and rng.random() < 0.4:
            at = rng.randrange(len(changed))
            changed[at:at] = rng.choices(WORDS, k=rng.randrange(5, 20))
        doc = rng.choices(WORDS, k=20) + changed + rng.choices(WORDS, k=20)
        rows.append((i, " ".join(doc)))
        matched, first, last = unbanded(words, doc)
        if matched >= 0.8 * len(words):
            want[i] = (name, len(" ".join(doc[:first])) + 1, len(" ".join(doc[:last])))
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["start"], r["end"]))
    hit = sum(any(name == n or (s <= a and b <= e) for n, s, e in got.get(i, [])) for i, (name, a, b) in want.items())
    assert len(want) > 80 and hit >= 0.97 * len(want)
    assert len({i for i in got if i not in want}) <= 0.05 * len(rows)


def test_licences_with_foreign_words_and_odd_rows(spark):
    text = dict(license_scan.TEMPLATES)["apache-2.0-notice"].split()
    split = " ".join(text[:39] + [f"f{k}" for k in range(12)] + text[39:])
    part = " xx ".join([" ".join(text[:20])] * 100)
    long = "word " * 600_000 + split
    rows = [(None, split), (1, split), (1, split), (2, part), (3, long)]
    got = license_scan.scan(spark.createDataFrame(rows, DOCS)).where("license = 'apache-2.0-notice'").collect()
    assert sorted((r["doc_id"] or -1, r["coverage"]) for r in got) == [(-1, 1.0), (1, 1.0), (1, 1.0), (3, 1.0)]
    assert [r["start"] for r in got if r["doc_id"] == 3] == [3_000_000]


def test_licence_hits_equal_a_search_for_the_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    texts = docs.select("doc_id", "text").collect()
    for name in ("mit-line", "cc-by-nc-4.0-line", "apache-2.0-line", "gpl-3.0-line"):
        words = dict(license_scan.TEMPLATES)[name].rstrip(".")
        assert {r["doc_id"] for r in texts if words in r["text"]} == {d for d, n in got if n == name}


PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "", None, "Hello, WORLD! don't you'll I'VE", "a<|endoftext|>b <|startoftext|><|EndOfText|>", "Σας ΟΔΥΣΣΕΥΣ İstanbul ǅ", "é́ x́ ﬁ", "12 3½ ٣ ⅷ",
    "a\u200bb\u00a0c\x1cd\x85e\u3000f", "🙂🙂 日本語テキスト", "\x00\x01 \x7f", "x" * 3000, "ab" * 400 + "'s", "%%" * 300 + "&&&", "ʼn ß ẞ", "   ", "\n\t",
]


def test_bpe_equals_the_library(spark, sf_dir):
    texts = TRICKY + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_tokens int").repartition(3)
    got = bpe.encode_decode(df, PATH, keep=True).orderBy("doc_id").collect()
    tok = Tokenizer.from_file(PATH)
    for row, text in zip(got, texts, strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == back
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []


def test_bpe_forms_agree():
    coder = bpe.Bpe(bpe.load_spec(PATH))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeè%", k=rng.randrange(1, 60))).encode() for _ in range(300)]
    block = coder.encode_words(words)
    for word, ids in zip(words, block, strict=True):
        parts = [*coder.inner[list(word[:-1])].tolist(), int(coder.last[word[-1]])]
        assert coder.merge_long(parts) == [x[0] for x in struct.iter_unpack("<I", ids)]
