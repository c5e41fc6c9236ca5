"""Each operator against brute force or a round trip, and on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import collections
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chroma, common, decontam, linededup, mixing, neardup, quality, toxicity, urlrules, warc, words
from vellum.llm.common import Scratch
from vellum.llm.tokens import PieceCounter, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a null id of five words", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y z w v " * 20000, "en", "s", 1), (4, "same words in this row here", "en", "t", 1), (4, "same words in this row here", "en", "t", 1), (5, "same words in this row here", None, "", 1), (6, " \n\n ", "en", None, 3)]


def odd(spark):
    """Awkward rows with extra columns named like results."""
    return spark.createDataFrame([(*r, 9.0, 7, "z", 5) for r in ODD], DOC + ", score double, n_tokens int, key string, mix_slot int")


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    ids = sorted({i for i, _ in rows})
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(rng):
    rows = []
    for base in range(8):
        t = text(rng, rng.randrange(6, 90)).split()
        for _ in range(6):
            c = list(t)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = f"n{rng.randrange(50)}"
            rows.append((len(rows), " ".join(c)))
    return rows + [(len(rows) + i, text(rng, 40)) for i in range(20)]


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(random.Random(5))
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_near_duplicates_odd(spark):
    rows = neardup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[None][0].component_id is None and by[None][0].kept and by[1][0].n_shingles == 0 and by[2][0].component_id == 2
    assert [r.component_id for r in by[4] + by[5]] == [4, 4, 4] and not by[5][0].kept and by[6][0].component_id == 6
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_word_hashes():
    rng = random.Random(2)
    texts = [text(rng, rng.randrange(0, 30)).replace(" ", rng.choice([" ", "\t", "\n\x0b", "  "])).encode() for _ in range(200)] + [b"", b"  ", "é à ü ñ ß".encode(), b"A b C d E f"]
    assert [len(s) for s in words.shingle_sets(texts)] == [len(shingles(t.decode())) for t in texts]
    long = (b"some words and more " * 200_000)[:-3]
    assert len(words.words_of([long])[0]) == len(long.split()) and len(words.shingle_sets([long])[0]) == len(shingles(long.decode()))


def test_signature_distance_guarantee():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        base = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
        a, b = np.concatenate([base[:60], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]), np.concatenate([base[:60], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
        s = neardup.signatures([a, b])
        lanes = (s[:, : neardup.LANES, None] >> np.array([45, 30, 15, 0], np.uint64)) & np.uint64(0x3FFF)
        apart = (lanes[0] != lanes[1]).sum(1)
        assert apart.sum() > neardup.MOST or (apart <= 1).any()
        missed += apart.sum() > neardup.MOST or np.bitwise_count(s[0, neardup.LANES :] ^ s[1, neardup.LANES :]).sum() > neardup.MOST_FINE
    assert missed == 0


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_families_in_parts(spark, monkeypatch, block):
    """Chains of drifting copies, whose first and last are unlike: the parts of a family still find each other, whatever the size of the blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng, rows = random.Random(31), []
    for _ in range(4):
        words = text(rng, 60, 5000).split()
        for step in range(14):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
            if step % 5 == 4:
                words = words[: rng.randrange(40, len(words))] + text(rng, 15, 5000).split()
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len(set(got.values())) > 4


@pytest.mark.parametrize("task_edges", [1_000_000, 7])
def test_components(spark, task_edges):
    """Against union-find; also where no task can hold all edges."""
    rng = random.Random(20)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"), task_edges).collect()
    assert {(r.node, r.root) for r in got} == {(i, find(i)) for i in list(root)} and len(got) == len(root)
    assert neardup.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc"), task_edges).count() == 0


def test_quality():
    rng = random.Random(1)
    good = [text(rng, rng.randrange(20, 80)).capitalize() + "." for _ in range(300)]
    bad = [rng.choice([" *** ".join(text(rng, 20).split()), text(rng, 20).upper().replace(" ", "!! "), " ".join([f"w{rng.randrange(400)}"] * 30)]) for _ in range(100)]
    model = quality.fit(good[:200] + bad[:70], [1] * 200 + [0] * 70)
    score = [model.probability(x) for x in quality.all_indicators(good[200:] + bad[70:])]
    assert np.mean((np.array(score) >= 0.3) == np.array([1] * 100 + [0] * 30)) > 0.97
    assert 0 < quality.fit(["a"], [1]).probability(np.zeros(0, np.int64)) < 1 and quality.fit([], []).probability(np.zeros(0, np.int64)) == 0.5
    x = quality.indicators([b"a a a", b"", b"b"])
    assert len(x[1]) == 0 and len(x[0]) > len(x[2]) > 0


def test_dual_coordinate_descent():
    rng = np.random.default_rng(0)
    y = np.array([1.0, -1.0] * 20)
    rows, values = [np.array([0, 1])] * 40, [np.array([s * 2 + rng.normal() * 0.1, rng.normal()]) for s in y]
    w, b = quality.dual_coordinate_descent(rows, values, y, 2, np.full(40, 1.0), rounds=200)
    assert all(s * (w @ v + b) > 0 for s, v in zip(y, values, strict=True))


def test_dual_coordinate_descent_finds_the_minimum():
    """The primal loss against a brute-force search around the solution, and against the dual: no gap is left."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = rng.uniform(0.5, 2, 60)
    w, b = quality.dual_coordinate_descent([np.arange(3)] * 60, list(x), y, 3, cost, rounds=3000, tolerance=1e-10)

    def loss(v):
        return (v @ v) / 2 + (cost * np.maximum(0, 1 - y * (x @ v[:3] + v[3]))).sum()

    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + s * rng.normal(size=4)) >= best - 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(300))


def test_ratios_and_scores():
    """Log-count ratios and margins counted again one by one."""
    texts, y = ["a b c", "a b", "d d e", "d f"], np.array([1.0, 1, 0, 0])
    rows = quality.all_indicators(texts)
    ratio = quality.fit_ratio(rows, y)
    size = 1 << quality.BITS
    n = {k: size + sum(len(r) for r, c in zip(rows, y, strict=True) if c == k) for k in (0, 1)}
    for i in set(np.concatenate(rows).tolist()):
        p, q = (1 + sum(i in r.tolist() for r, c in zip(rows, y, strict=True) if c == k) for k in (1, 0))
        assert math.isclose(ratio[i], math.log(p / n[1]) - math.log(q / n[0]), abs_tol=1e-12)
    m = quality.fit(texts * 5, [1, 1, 0, 0] * 5)
    for r in rows:
        got = sum(float(m.scaled[i]) for i in r.tolist()) / math.sqrt(sum(float(m.squares[i]) for i in r.tolist())) + m.bias
        assert math.isclose(m.margin(r), got, rel_tol=1e-3, abs_tol=1e-4)


def test_labels_that_differ(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (5, 1)], "doc_id long, quality int")
    seen = common.fitted(docs, labels, "quality", lambda texts, y: sorted(zip(texts, y, strict=True)), 1000, 100)
    own = {i for i in range(20) if zlib.crc32(str(i).encode()) % 5 and i != 4}
    assert seen == sorted(("again" if i == 3 else f"text {i}", i % 2) for i in own)
    assert len(common.fitted(docs, labels, "quality", lambda texts, y: texts, 1000, 100, budget=20)) <= 3


def test_shared_folder_on_a_cluster(monkeypatch):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far)


def test_clashing_columns(spark):
    """Extra columns that differ from the operators' own only in case, or that are called like their helpers."""
    docs = spark.createDataFrame([(i, f"text {i} of the table", "s", "x", "y", "z") for i in range(6)], "doc_id long, text string, source string, Score string, _lost_keys string, _source string")
    m = quality.fit([], [])
    out = quality.quality_scores(docs, m)
    assert [c for c in out.columns if c.lower() == "score"] == ["score"] and out.count() == 6 and out.first()["_source"] == "z"
    assert linededup.LineDedup(spark).build(docs).apply(docs).first()["_lost_keys"] == "y"
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 6 and all(r["_source"] == "z" and r["Score"] == "x" for r in mixed)
    assert neardup.near_duplicates(docs.withColumn("class_id", F.lit("q"))).count() == 6


def test_scores_odd(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for out in (quality.quality_scores(docs, quality.train(docs, labels)), toxicity.toxicity_scores(docs, toxicity.train(docs, labels))):
        rows = out.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows) and {"key", "n_tokens"} <= set(out.columns)
        assert next(r for r in rows if r.doc_id is None).held_out
    assert quality.quality_scores(docs.limit(0), quality.fit([], [])).count() == 0 and toxicity.toxicity_scores(docs.limit(0), toxicity.fit([], [])).count() == 0


def test_toxicity_grammar():
    g = toxicity.Grammar()
    aimed, plain, negated, said = (g.features(t)[0] for t in ("You are an idiot.", "An idiot.", "You are not an idiot.", "He said you are an idiot."))
    assert aimed > plain > 0 and aimed > said and aimed > negated and g.features("A fine day.") == (0, 0, 0) == g.features(None)
    score = lambda t: g.clause(t.lower().split())
    assert score("I will kill you") > 0 == score("They kill time in the park") == score("people attack the problem") == score("attack")
    assert score("kill them all") > 0 and score("he said I will kill you") < score("I will kill you") > score("I will not kill you")
    rng = random.Random(3)
    bad, good = ["zorg", "blemfo", "quax"], [text(rng, 40) for _ in range(200)]
    toxic = [t.replace(" ", f" {rng.choice(bad)} ", 3) for t in (text(rng, 40) for _ in range(100))]
    m = toxicity.fit(good[:150] + toxic[:70], [0] * 150 + [1] * 70)
    assert np.mean([m.score(t) < 0.5 for t in good[150:]] + [m.score(t) >= 0.5 for t in toxic[70:]]) > 0.95


def test_transducers_compose():
    """The composed automaton against all paths through the five transducers, one after the other."""
    parts = [toxicity.negation(), toxicity.report(), toxicity.target(), toxicity.insult(), toxicity.threat()]

    def every(t, symbols):
        paths = [(t.start, 0.0, ())]
        for x in symbols:
            paths = [(to, w + v, (*out, y)) for s, w, out in paths for y, v, to in t.arcs.get(s, {}).get(x, ())]
        return {(w, out) for s, w, out in paths if s in t.finals}

    rng = random.Random(12)
    kinds = ["other", "target", "negation", "report", "intent", "threat", "insult3", "insult8"]
    for _ in range(150):
        read = [(rng.choice(kinds), "") for _ in range(rng.randrange(0, 6))]
        now = {(0.0, tuple(read))}
        for t in parts:
            now = {(w + v, out) for w, x in now for v, out in every(t, x)}
        assert math.isclose(toxicity.automaton().weigh(read), max(w for w, _ in now), abs_tol=1e-9)
    assert toxicity.Grammar().clause([]) == 0


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_splicing(model_path):
    c, rng = PieceCounter(model_path, 200, 20), random.Random(3)
    parts = ["a", "b ", " ", "  ", "the", "\n", "▁", "ｆ😀", "é", "x" * 50, "\t", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 900))) for _ in range(150)] + ["x" * 3000, "é" * 1000, " " * 1000, "a " * 2000, " a" * 999 + " ", "▁" * 700, ""]
    assert c.counts(texts) == [len(x) for x in c.model.encode(texts)]


def test_tokens_odd(spark, model_path):
    rows = {r.doc_id: r for r in token_counts(odd(spark), model_path, chunk=5000, overlap=100).collect()}
    assert rows[1].n_tokens == 0 and rows[1].n_bytes == 0 and rows[2].n_tokens == 0 and rows[3].over_limit and rows[6].n_tokens > 0
    assert token_counts(odd(spark).limit(0), model_path).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_urls(spark):
    urls = ["http://A.example.COM/en/1", "https://www.example.com/en/2", "x://example.com?q", "http://b.net/es/1", "http://b.net/en/1", "nothing", None, "http://notcom/en/", "http://c.org#x", "a://b://c"] + [f"http://h{i}.net/fr/p{i}" for i in range(30)]
    rows = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert [rows[i].rule for i in range(7)] == ["example.com/en/", "www.example.com/en/", None, "net/es/", None, None, None]
    assert (rows[0].host, rows[0].path) == ("a.example.com", "/en/1") and (rows[2].host, rows[2].path) == ("example.com", "") and (rows[9].host, rows[9].path) == ("b:", "//c")
    assert rows[0].verdict == "block" and rows[6].verdict == "allow" and rows[5].host == "" and len(rows) == len(urls)
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_urls_odd(spark):
    """Repeated rows, very long urls, deep paths that are all frequent, extra columns."""
    deep = "http://d.net/fr/" + "/".join(f"x{i}"[:1] + "abcdefghijklmnopqrst"[i % 20] for i in range(40))
    urls = [(1, "http://q.net/fr/" + "z" * 200_000), (1, "http://q.net/fr/" + "z" * 200_000), (2, "http://other.org/" + "y/" * 20_000)] + [(i, deep) for i in range(10, 60)]
    table = spark.createDataFrame([(*u, "r", "v") for u in urls], "page_id long, url string, rule string, Verdict string")
    rows = urlrules.judge(table, RULES).collect()
    assert len(rows) == len(urls) and {r.verdict for r in rows if r.page_id != 2} == {"block"} and next(r for r in rows if r.page_id == 2).verdict == "allow"
    t = spark.createDataFrame([("a.b.c.d.e.f", "/1/2/x/y/z/w/v/u")], "h string, p string").select(urlrules.tokens(F.col("h"), F.col("p")).alias("t")).first().t
    assert len(t) == 12 and "h4+=b/a" in t and "p6+=v/u" in t


def test_listed_rules_by_join(spark):
    """Many rules, against the expression for few and against a plain search."""
    rng = random.Random(22)
    name = lambda n: ".".join(rng.choice(["a", "b", "net", "com"]) for _ in range(n))
    rules = sorted({(rng.choice(["allow", "block"]), name(rng.randrange(1, 4)), "/" + "/".join(rng.choice("xy") for _ in range(rng.randrange(3)))) for _ in range(80)})
    urls = [(i, f"http://{name(rng.randrange(1, 5))}/{'/'.join(rng.choice('xyz') for _ in range(rng.randrange(4)))}") for i in range(300)] + [(300, None), (301, "no url")]
    table = spark.createDataFrame(urls, "page_id long, url string")
    few = rules[:40]
    assert urlrules.listed(table, few).exceptAll(urlrules.listed(table, spark.createDataFrame(few, "verdict string, host string, path string"))).count() == 0
    for r in urlrules.listed(table, rules).collect():
        fits = [x for x in rules if (r.host == x[1] or r.host.endswith("." + x[1])) and r.path.startswith(x[2])]
        best = max(fits, key=lambda x: (len(x[1] + x[2]), len(x[1]), x)) if fits else None
        assert (r.listed, r.rule) == ((best[0], best[1] + best[2]) if best else (None, None))


def test_mined_rules(spark):
    rng = random.Random(4)
    data = [(sorted({f"t{rng.randrange(6)}" for _ in range(3)}),) for _ in range(200)]
    data = [(t, "block" if {"t1", "t2"} <= set(t) or rng.random() < 0.1 else "allow") for (t,) in data]
    got = urlrules.mined_rules(spark.createDataFrame(data, "tokens array<string>, label string"), 0.05, 0.8, 1, Scratch(spark, "rules")).collect()
    want = set()
    for label in ("allow", "block"):
        found = []
        for n in (1, 2, 3):
            for s in itertools.combinations([f"t{i}" for i in range(6)], n):
                has = [y for t, y in data if set(s) <= set(t)]
                hit = has.count(label)
                if has and hit / len(data) >= 0.05 and hit / len(has) >= 0.8 and not any(x <= set(s) for x in found):
                    found.append(set(s))
                    want.add((s, label))
    assert {(tuple(r["items"]), r.label) for r in got} == want


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, text(rng, rng.randrange(10, 50), 2000)) for i in range(30)] + [(90, None), (91, "two words"), (None, "a null id item text")]
    docs, leaky = [], set()
    for d in range(60):
        w = text(rng, 80, 2000).split()
        if d < 40:
            own = items[rng.randrange(30)]
            x = own[1].split()
            for _ in range(rng.randrange(int(0.15 * len(x)) + 1)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], ["zz"], [x[k], "yy"]])
            w[20:20] = x
            leaky.add((d, own[0]))
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(got & leaky) >= 0.95 * len(leaky) and not got - leaky
    assert got == {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=500).collect()}
    assert decontam.leaks(odd(spark), bench).count() == 0 and decontam.without_leaks(odd(spark), bench).count() == len(ODD)
    assert decontam.leaks(odd(spark), bench.limit(0)).count() == 0 and decontam.leaks(odd(spark).limit(0), bench).count() == 0


def edited(rng, words, edits):
    """The words after so many edits, each at another word."""
    out = list(words)
    for k in sorted(rng.sample(range(len(words)), edits), reverse=True):
        out[k : k + 1] = rng.choice([[], [f"e{k}"], [out[k], f"e{k}"]])
    return out


@pytest.mark.parametrize("n", [12, 100, 250, 500])
def test_decontamination_of_long_items(n):
    """Passages with as many edits as the rate allows are all found, at the least distance."""
    rng = random.Random(n)
    items = [(i, text(rng, n, 3000)) for i in range(6)]
    index = decontam.BenchmarkIndex(items)
    for i, t in items:
        w = [f"o{k}" for k in range(30)] + edited(rng, t.split(), index.most(n)) + [f"p{k}" for k in range(40)]
        own, _ = words.words_of([" ".join(w).encode()])
        want = decontam.best_window(index.words[i].tolist(), own.tolist(), index.most(n))
        assert want and (i, want[0]) in {(k, d) for k, _, d in index.matches(own)}


def test_decontamination_against_all_windows():
    """Runs of one word, few words, and passages that occur truncated before they occur whole."""
    rng = random.Random(8)
    cases = [(["a a b"], "a a a b"), (["a a b"], "a " * 50 + "b"), (["b a a"], "x b" + " a" * 50), (["a a a"], "a " * 9)]
    long = [text(rng, 40, 900) for _ in range(2)]
    cases.append((long + [" ".join(long[0].split()[:34])], " ".join(long[0].split()[:34]) + " o p q " + long[0].replace(" ", " z ", 3)))
    cases += [([" ".join(rng.choice("ab") for _ in range(rng.randrange(3, 12))) for _ in range(4)], " ".join(rng.choice("aaab") for _ in range(30))) for _ in range(60)]
    for items, doc in cases:
        index = decontam.BenchmarkIndex(list(enumerate(items)))
        own = words.words_of([doc.encode()])[0]
        want = {(k, x[0]) for k, w in zip(index.ids, index.words, strict=True) if (x := decontam.best_window(w.tolist(), own.tolist(), index.most(len(w))))}
        assert {(k, d) for k, _, d in index.matches(own)} == want, (items, doc)


def test_best_window():
    def distance(a, b):
        r = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, r = r, [i]
            for j, y in enumerate(b, 1):
                r.append(min(p[j] + 1, r[-1] + 1, p[j - 1] + (x != y)))
        return r[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b, most = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(0, 12))], rng.randrange(4)
        least = min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got = decontam.best_window(a, b, most)
        assert (got and got[0]) == (least if least <= most else None)


def test_decontamination_against_all_windows(spark):
    """Runs, repeats and edits at the bound: every document and item by the whole table of edit distances."""

    def least(item, words):
        row = [0] * (len(words) + 1)
        for i, x in enumerate(item, 1):
            now = [i]
            for j, y in enumerate(words, 1):
                now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
            row = now
        return min(row)

    rng, docs = random.Random(23), []
    items = [(i, " ".join(rng.choice("abcdefgh"[: rng.choice([2, 3, 8])]) for _ in range(rng.randrange(3, 14)))) for i in range(12)]
    items += [(100, "a a b c"), (101, "p p q r s t u v w x")]
    for d in range(300):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice("abcp")] * rng.choice([0, 1, 2, 6])
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice("abc")], [copy[at], rng.choice("abc")]])
                copy = copy or ["a"]
            words += copy + [rng.choice("abcdefgh") for _ in range(rng.randrange(5))]
        docs.append((d, " ".join(words)))
    docs += [(900, "x y a a a a b c z"), (901, "p p p p p z q r s t z v w x")]
    want = {(d, i, n) for d, t in docs for i, item in items if (n := least(item.split(), t.split())) <= int(0.2 * len(item.split()))}
    for size in (16 << 20, 60):  # a block, and many
        got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size).collect()
        assert {(r.doc_id, r.item_id, r.edit_distance) for r in got} == want and {(900, 100, 0)} <= want and any(d == 901 and i == 101 for d, i, _ in want)


def test_archives(spark):
    body = b"<html>\r\n\r\nWARC/1.1 \xc3\xa9</html>"
    file = b"filedesc://x 0.0.0.0 20240101 text/plain 4\n2 0\n\n" + warc.arc_record(2, "http://a b/", "20240102030405", "text/html", body) + warc.arc_record(2, "http://c/", "2024", "text/html", b"")
    arcs = list(warc.parse_arc(file))
    assert [(a["url"], a["body"], a["error"]) for a in arcs] == [("http://a b/", body, None), ("http://c/", b"", None)]
    assert list(warc.parse_arc(b"http://x 1.1.1.1 2024 text/html 99\nshort"))[0]["error"] and next(warc.parse_arc(warc.arc_record(1, "u", "2024", "t", body)))["body"] == body
    data = b"".join(warc.warc_record(i, a, None) + warc.END for i, a in enumerate(arcs))
    assert [r["body"] for r in warc.parse_warc(data)] == [body, b""] and warc.warc_date("2024") == "2024-01-01T00:00:00Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\n", None), (4, "u", ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n")]
    rows = {r.page_id: r for r in warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert rows[3].payload_bytes == 0 and rows[5].payload_bytes == len(pages[4][2].encode()) and rows[3].payload_digest == warc.digest(b"")
    large = {r.page_id: r for r in warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string"), least=1).collect()}
    assert large[3].record_type == "response" and large[1].record_type == "revisit"
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_of_odd_rows(spark):
    """Repeated and null ids, very long payloads, extra columns; whatever the size of the files."""
    long = "long " * 100_000
    pages = [(1, "u", "same"), (1, "u", "other"), (2, "u", "same"), (2, "u", "same"), (3, "u", "other"), (None, "n", "same"), (None, "n", "alone"), (None, "m", "alone"), (9, "u", long), (10, "u", long)]
    table = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, last string, sum string")
    want = sorted(
        [(1, "same", "revisit", 2), (1, "other", "revisit", 3), (2, "same", "response", None), (2, "same", "response", None), (3, "other", "response", None), (None, "same", "revisit", 2)]
        + [(None, "alone", "response", None)] * 2 + [(9, long, "revisit", 10), (10, long, "response", None)], key=str
    )
    for size in (16 << 20, 100):
        got = warc.archived(table, file_bytes=size).collect()
        named = {warc.digest(h.encode()): h for _, _, h in pages}
        assert sorted(((r.page_id, named[r.payload_digest], r.record_type, r.refers_to) for r in got), key=str) == want
        assert all(r.payload_bytes == len(named[r.payload_digest]) for r in got)


def test_line_dedup_grows_and_keeps_its_state(spark, tmp_path, monkeypatch):
    """More shards as blocked keys grow; the source may change after the build."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    line = "common line {} " + "x" * 40
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, line.format(0)) for i in range(6)], "doc_id long, text string").write.parquet(path)
    index = linededup.LineDedup(spark).build(spark.read.parquet(path))
    spark.createDataFrame([(99, "else")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    more = spark.createDataFrame([(i, "\n".join(line.format(k) for k in range(60))) for i in range(10, 16)], "doc_id long, text string")
    index.insert(more)
    assert index.shards > 1 and {r.doc_id: r.n_dropped for r in index.apply(more).collect()} == {**dict.fromkeys(range(10, 15), 60), 15: 0}
    index.delete(more.select("doc_id"))
    first = spark.createDataFrame([(i, line.format(0)) for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in index.apply(first).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_line_dedup_reverses(spark):
    rng = random.Random(8)
    pool = [f"line {i} " + "x" * 40 for i in range(12)] + ["short"]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else " " + rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, half, other = (linededup.LineDedup(spark) for _ in range(3))
    whole.build(docs)
    half.build(docs.where("doc_id < 20")).insert(docs.where("doc_id >= 20"))

    def result(index):
        return sorted((r.doc_id, r.text, r.n_dropped) for r in index.apply(docs).collect())

    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[x.strip().lower()].add(i)
    want = []
    for i, t in rows:
        kept = [x for x in t.split("\n") if len(x.strip()) < 40 or len(holders[x.strip().lower()]) < 5 or max(holders[x.strip().lower()]) == i]
        want.append((i, "\n".join(kept), t.count("\n") + 1 - len(kept)))
    assert result(whole) == want == result(half) == result(linededup.LineDedup(spark, broadcast_limit=-1).build(docs))
    half.delete(docs.where("doc_id >= 20").select("doc_id"))
    assert result(half) == result(other.build(docs.where("doc_id < 20")))


def test_line_dedup_odd(spark):
    rows = linededup.LineDedup(spark).build(odd(spark)).apply(odd(spark)).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_lines for r in rows}[1] == 1 and next(r for r in rows if r.doc_id == 1).text is None
    assert linededup.LineDedup(spark).build(odd(spark).limit(0)).apply(odd(spark).limit(0)).count() == 0


def test_cuckoo():
    rng = random.Random(9)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    c = linededup.Cuckoo(expect=1000)  # overfull on purpose: what finds no place is kept exactly
    for k in keys:
        c.insert(k)
    c = linededup.Cuckoo(c.dump())
    assert c.has(np.array(keys, np.uint64)).all()
    for k in keys[:1500]:
        c.delete(k)
    assert c.has(np.array(keys[1500:], np.uint64)).all()
    assert c.has(np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)).mean() < 0.05


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, None), (7, "big")]
    weights = {"big": 3.0, "s0": 2.0}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4, bucket_rows=50).collect()
    assert len(out) == len(rows) and len({r.mix_position for r in out}) == len(rows)
    slots = sorted({(r.mix_slot, r.source) for r in out}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots)))
    left = collections.Counter(s for _, s in slots)
    names = {s: s or "" for s in left}
    share = mixing.shares({names[s]: weights.get(names[s], 1.0) for s in left})
    done, total = collections.Counter(), sum(share[names[s]] for s in left)
    for t, s in slots:
        done[s] += 1
        for k in left:
            assert abs(done[k] - (t + 1) * share[names[k]] / total) < 1
        if done[s] == left[s]:
            break
    assert mixing.mix(odd(spark)).count() == len(ODD) and mixing.mix(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [dict.fromkeys(map(str, range(21)), 1.0), {"a": 1.0, "b": 0.0005, "c": math.pi, "d": 2 / 3}, {"a": 0.7, "b": 0.2, "c": 0.1}])
def test_mixing_keeps_target_weights(weights):
    """Against the unrounded weights over very many slots, while all sources last."""
    blocks = dict.fromkeys(weights, 3000) | ({"b": 30} if "d" in weights else {})
    phases, patterns = mixing.plan(blocks, mixing.shares(weights))
    slots = {(p["phase"], p["source"]): p["slots"] for p in patterns}
    order = {}
    for p in phases:
        own = slots[p["phase"], p["source"]]
        order |= {p["begin"] + (b - p["first"]) // p["q"] * p["n"] + own[(b - p["first"]) % p["q"]]: p["source"] for b in range(p["first"], p["until"])}
    assert sorted(order) == list(range(sum(blocks.values()))) and collections.Counter(order.values()) == blocks
    done, total = collections.Counter(), sum(weights.values())
    for t in range(len(order)):
        done[order[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / total) < 1 for s, w in weights.items())
        if done[order[t]] == blocks[order[t]]:
            break
    assert t > 3000


def test_mixing_against_a_plain_schedule():
    """Earliest deadline first, slot by slot over exact fractions, for sources of different sizes."""
    rng = random.Random(21)
    for _ in range(40):
        names = "abcde"[: rng.randrange(1, 6)]
        weights, blocks = {s: rng.randrange(1, 9) for s in names}, {s: rng.randrange(1, 30) for s in names}
        phases, patterns = mixing.plan(blocks, mixing.shares(weights))
        slots, order = {(p["phase"], p["source"]): p["slots"] for p in patterns}, {}
        for p in phases:
            own = slots[p["phase"], p["source"]]
            order |= {p["begin"] + (b - p["first"]) // p["q"] * p["n"] + own[(b - p["first"]) % p["q"]]: p["source"] for b in range(p["first"], p["until"])}
        left, want = dict(blocks), []
        while left:
            total, done = sum(weights[s] for s in left), dict.fromkeys(left, 0)
            for t in itertools.count():
                ready = [(Fraction((done[s] + 1) * total, weights[s]).__ceil__(), s) for s in left if Fraction(done[s] * total, weights[s]).__floor__() <= t]
                s = min(ready)[1]
                want.append(s)
                done[s] += 1
                if done[s] == left[s]:
                    break
            left = {s: n - done[s] for s, n in left.items() if n > done[s]}
        assert [order[t] for t in range(len(order))] == want


def test_mixing_bounds_its_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 50)
    assert mixing.planned({"a": 1000, "b": 1000}, {"a": 1, "b": 1}, 16)[0] == 16
    size, phases, patterns = mixing.planned({"a": 100_000, "b": 900}, {"a": 1_000_003, "b": 2_000_029}, 16)
    assert size > 16 and sum(p["until"] - p["first"] for p in phases) == sum(-(-n // size) for n in (100_000, 900)) <= 50
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    rows = spark.createDataFrame([(i, "ab"[i % 3 > 0], "c") for i in range(999)] + [(None, "a", None)] * 5, "doc_id long, source string, slot string")
    out = mixing.mix(rows, {"a": 0.123457, "b": 1.0}, block_rows=2, bucket_rows=10).collect()
    assert len({r.mix_position for r in out}) == 1004 and {r.slot for r in out} == {"c", None}
    assert all(len({r.source for r in g}) == 1 for _, g in itertools.groupby(sorted(out, key=lambda r: r.mix_slot), key=lambda r: r.mix_slot))


def test_mixing_weights(spark):
    assert mixing.shares({"a": 0.5, "b": 0.0001, "c": 0.0}) == {"a": 5000, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        mixing.shares({"a": -1.0})
    rows = spark.createDataFrame([(i, "abz"[i % 3]) for i in range(300)], "doc_id long, source string")
    out = sorted(mixing.mix(rows, {"a": 1.0, "b": 1e-30, "z": 0.0}, block_rows=1).collect(), key=lambda r: r.mix_slot)
    assert [r.mix_slot for r in out] == list(range(300)) and {r.source for r in out[200:]} == {"z"} and sum(r.source == "a" for r in out[:101]) == 100


def test_chroma(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.12, 64).tolist()) for i in range(60)]
    vectors += [(100 + i, (np.array(vectors[i][1]) + rng.normal(0, 0.002, 64)).tolist()) for i in range(40)] + [(200, vectors[0][1]), (300, None), (301, []), (None, vectors[1][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    prints = chroma.fingerprints(chroma.render(table))
    rows = {r.rec_id: r for r in chroma.search(prints, every=1).collect()}
    assert len(rows) == len(vectors) and rows[200].class_id == 0 and rows[300].n_frames == 0 and rows[301].matches == []
    own = {r.rec_id: np.frombuffer(r["print"], np.uint32) for r in prints.collect() if r.n_frames}
    classes = sorted({rows[i].class_id for i in own if i is not None})
    want = {(a, b) for a in classes for b in classes if a != b and (x := chroma.align(own[a], own[b])) and x[1] <= 0.1}
    got = {(a, m.class_id) for a in classes for m in rows[a].matches}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 10
    x = chroma.read_wav(chroma.wav_bytes(np.sin(np.arange(40000) / 3)))
    a, b = chroma.fingerprint(x * np.linspace(0.5, 1, 40000)), chroma.fingerprint(x[2560:])
    assert chroma.align(a, b, 8)[1] < 0.05 and len(chroma.fingerprint(chroma.read_wav(b"no wave"))) == 0 and math.isclose(abs(x).max(), 1, abs_tol=0.01)
    noisy = rng.normal(0, 0.3, 40000)
    assert chroma.align(chroma.fingerprint(noisy), chroma.fingerprint(noisy[2560:]))[0] == -10


def test_chroma_odd(spark):
    """Null, repeated and empty recordings, a very long one, extra columns, no rows."""
    tone = chroma.wav_bytes(np.sin(np.arange(9000) / 3) * 0.5)
    long = chroma.wav_bytes(np.sin(np.arange(2_000_000) / (3 + np.arange(2_000_000) // 9000 % 5)) * 0.5)
    rows = [(None, tone), (50, tone), (51, tone), (51, tone), (52, b"no wave"), (53, None), (54, tone[:200]), (100, long)]
    table = spark.createDataFrame([(i, None if x is None else bytearray(x), "a", 1) for i, x in rows], "rec_id long, audio binary, own string, class_id int")
    prints = chroma.fingerprints(table)
    got = chroma.search(prints.withColumn("own", F.lit("x")).withColumn("matches", F.lit(1))).collect()
    assert sorted(((r.rec_id, r.class_id) for r in got), key=str) == sorted([(None, None), (50, 50), (51, 50), (51, 50), (52, 52), (53, 53), (54, 54), (100, 100)], key=str)
    assert all((r.matches is not None) == r.is_query == (r.rec_id in (50, 100)) for r in got) and next(r for r in got if r.rec_id == 100).n_frames > 7000
    assert chroma.search(prints.limit(0)).count() == 0 and chroma.fingerprints(table.limit(0)).count() == 0


def test_chroma_misses_no_pair(spark):
    """Recall against every offset of every pair: copies up to the limit, short prints, and prints of one integer."""
    rng = np.random.default_rng(5)
    prints = {}
    for i in range(0, 40, 2):
        p = rng.integers(0, 1 << 32, int(rng.choice([8, 10, 25, 120])), dtype=np.uint32)
        bits = np.zeros(32 * len(p), np.uint32)
        bits[rng.choice(len(bits), int(0.1 * len(bits)), replace=False)] = 1
        prints[i], prints[i + 1] = p, p ^ (bits.reshape(-1, 32) << np.arange(32, dtype=np.uint32)).sum(1, dtype=np.uint32)
    prints |= {50: np.full(20, 7, np.uint32), 51: np.full(33, 7, np.uint32), 52: np.full(7, 7, np.uint32)}

    def brute(a, b):
        best = None
        for off in range(1 - len(a), len(b)):
            i, j = max(0, -off), max(0, off)
            m = min(len(a) - i, len(b) - j)
            n = int(np.bitwise_count(a[i : i + m] ^ b[j : j + m]).sum())
            if m >= 8 and n <= 0.1 * 32 * m and (best is None or 32 * m - n > best[0]):
                best = 32 * m - n, off, n / (32 * m)
        return best and best[1:]

    table = spark.createDataFrame([(i, len(p), bytearray(p.tobytes())) for i, p in prints.items()], "rec_id long, n_frames long, print binary")
    got = {(r.rec_id, m.class_id): (m.offset, m.error) for r in chroma.search(table, every=1).collect() for m in r.matches}
    want = {(i, j): x for i, a in prints.items() for j, b in prints.items() if i != j and (x := brute(a, b))}
    assert got == want and {(i, i + 1) for i in range(0, 40, 2)} | {(50, 51)} <= set(want)
    assert all(chroma.align(prints[i], prints[j]) == x for (i, j), x in want.items())
