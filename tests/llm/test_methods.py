"""Each method against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelode.llm import exact_dedup, main_text, mixing, near_dup, pack, repetition, substrings, toxicity, url_filter, warc
from citelode.llm.common import BlockedBloom
from citelode.llm.queries import QUERIES, tokenizer_path


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    bloom = BlockedBloom.build(keys, "key")
    held, clear = bloom.split(keys, F.col("key"))
    assert held.count() == 3000 and clear.count() == 0
    others = spark.range(5000, 15000).select(F.xxhash64("id").alias("key"))
    held, clear = bloom.split(others, F.col("key"))
    assert held.count() < 1500 and held.count() + clear.count() == 10000
    words = substrings._bits(bloom)
    assert substrings._may_hold(words, np.array([r[0] for r in keys.collect()])).all()


# Fingerprints


@given(st.binary(max_size=200), st.integers(1, 40), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_fingerprints_compose(data, one, other):
    def fold(size):
        h1 = h2 = 0
        for a, s1, b, s2, _ in exact_dedup.piece_maps(data, size):
            h1, h2 = (h1 * s1 + a) % exact_dedup.PRIMES[0], (h2 * s2 + b) % exact_dedup.PRIMES[1]
        return h1, h2

    assert fold(one) == fold(other)


def test_parts_compose_in_spark(spark):
    whole = "Some text, " * 50
    parts = spark.createDataFrame([(1, i, whole[at : at + 70]) for i, at in enumerate(range(0, len(whole), 70))], "doc long, part int, text string")
    got = exact_dedup.fingerprint_parts(parts.repartition(4), "doc", "part", "text").first()["fingerprint"]
    one = exact_dedup.fingerprint_parts(spark.createDataFrame([(1, 0, whole)], "doc long, part int, text string"), "doc", "part", "text")
    assert got == one.first()["fingerprint"]


def test_false_matches_are_parted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "compose", lambda pieces: F.struct(
        F.lit(1).cast("long").alias("h1"), F.size(pieces).cast("long").alias("h2"), F.lit(0).cast("long").alias("n")
    ))
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d"), (5, "c ")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 5, 2), (5, 5, 2), (4, 4, 1)}


# Packing


def test_hilbert_neighbours_touch():
    points = np.array([(a, b) for a in range(16) for b in range(16)])
    keys = pack.hilbert_keys(points, 4)
    assert sorted(keys.tolist()) == list(range(256))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_every_id(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = QUERIES["op1_pack"](spark, sf_dir).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for doc, own in pieces.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2]
        at = 0
        for piece in own.sort_values("start").itertuples():
            data = np.array(ids[piece.start : piece.start + piece.length], dtype="<u4").tobytes()
            assert piece.start == at and piece.doc_tokens == len(ids) and zlib.crc32(data) == piece.ids_crc32
            at += piece.length
        assert at == len(ids)
    assert set(pieces.doc_id) == set(texts)
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        size = own.length.sum()
        assert (own.offset == own.length.cumsum() - own.length).all() and (size == 4096 or size & (size - 1) == 0)


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(tokenizer_path()), pack.WordTokens(tokenizer_path())
    texts = ["Ab'S a's, <|endoftext|> x<|STARTOFTEXT|>y Été. 12a3.,b. İx ΑΣ. don't!!", "x ýz a's. it's, 5%", "", "a.b,c|| )"]
    assert [ids.tolist() for ids in words.encode([text.encode() for text in texts])] == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_words_of_letters_are_encoded_together(monkeypatch):
    from tokenizers import Tokenizer

    words = pack.WordTokens(tokenizer_path())
    rng = random.Random(5)
    drawn = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for letters in ("abcdefghij", "XYZabc", "abéüßñ", "אבגד", "ab1.'") for _ in range(300)]
    texts = [" ".join(drawn), "<|x Abc DEF " + " ".join(drawn[::-1]), "e\u0301a \u0958 ﬁn İ ΑΣ"]
    asked = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, some, **more):
            asked.extend(some)
            return self.inner.encode_batch_fast(some, **more)

    for name in ("_tokenizer", "_plain"):
        if hasattr(words, name):
            monkeypatch.setattr(words, name, Counted(getattr(words, name)))
    plain = Tokenizer.from_file(tokenizer_path())
    assert [ids.tolist() for ids in words.encode([text.encode() for text in texts])] == [plain.encode(text, add_special_tokens=False).ids for text in texts]
    seen = {word.lower() for word in drawn}
    assert len(asked) < len(seen) / 2


# Main text


def brute_cut(scores, edges):
    best = None
    for mask in range(1 << len(scores)):
        side = [bool(mask >> i & 1) for i in range(len(scores))]
        cost = sum(max(0, s) if not keep else max(0, -s) for s, keep in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = [rng.randint(-30, 30) / 10 for _ in range(n)]
        edges = [(i - 1, i, rng.randint(0, 15) / 10) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n), 0.5) for _ in range(3)]
        edges = [e for e in edges if e[0] != e[1]]
        side = main_text.content_side(scores, edges)
        cost = sum(max(0, s) if not keep else max(0, -s) for s, keep in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost == pytest.approx(brute_cut(scores, edges))


def test_page_without_article():
    page = """<body class="with-sidebar"><header><p>Welcome to this site with many long words in its header.</p></header>
    <div class="cookie-notice"><p>We use cookies to give you the best experience on our website and more.</p></div>
    <div id="content"><h1>Title&nbsp;here</h1><p>First paragraph of the article, with <a href=x>a link</a> &amp; more<br>text to read.
    <p>Short.<ul><li>point one<li>point two</ul><script>if (a < b) "<p>no</p>"</script></div>
    <section id="comments"><article><p>I think this is a great article and I liked it very much.</p></article></section>
    <aside><p>Related stories that you may like to read on another day.</p></aside><footer>&copy; 2020</footer>"""
    assert main_text.extract(page) == "Title here\nFirst paragraph of the article, with a link & more text to read.\nShort.\npoint one\npoint two"


# URL rules, archives


def test_loser_tree_merges():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(12))) for i in range(k)]
        assert list(warc.merged(runs)) == sorted(x for run in runs for x in run)


def test_index_is_in_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES", 20)
    index = warc.capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    got = [(r["url_key"], r["captured"], r["page_id"]) for r in index.collect()]
    assert got == sorted(got) and index.rdd.getNumPartitions() > 1


def test_longest_rule_wins(spark):
    urls = ["https://www.example.com/en/1", "http://a.example.com/en/", "http://x.com/en", "http://b.net/es/q", "http://b.net/de/", "ftp://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {0: "www.example.com/en/", 1: "example.com/en/", 2: "com/", 3: "net/es/", 4: None, 5: "com/"}


# Repeated passages


def brute_repeats(texts):
    places = Counter()
    split = {doc: text.encode().split() for doc, text in texts.items()}
    w = substrings.WINDOW
    for words in split.values():
        places.update(tuple(words[i : i + w]) for i in range(len(words) - w + 1))
    out = {}
    for doc, words in split.items():
        gone = {p for i in range(len(words) - w + 1) if places[tuple(words[i : i + w])] > 1 for p in range(i, i + w)}
        out[doc] = b" ".join(word for p, word in enumerate(words) if p not in gone).decode()
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(70)]
    texts = {i: " ".join([word() for _ in range(rng.randrange(60))] + shared[: rng.randrange(20, 70)] + [word() for _ in range(rng.randrange(60))]) for i in range(40)}
    texts[40] = "a b c d e " * 60
    texts[41] = "x " * 200
    texts[42] = " ".join(shared + shared)
    texts[43] = texts[5]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts)


# Near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for doc, text in texts.items():
        words = near_dup.words_of(text)
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    parent = {doc: doc for doc in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {doc: (len(sets[doc]), find(doc)) for doc in texts}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(2000)}"
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(120):  # a star and a chain of edits, most pairs near the threshold
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = word()
        texts[i] = " ".join(copy)
        if i % 3 == 0:
            base = copy
    common = [word() for _ in range(60)]
    for i in range(120, 170):
        texts[i] = " ".join(common + [word() for _ in range(40)])
    texts[170], texts[171], texts[172] = texts[3].upper(), "two words", "Two  Words"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.link(docs, width=width, percent=percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_odd_sketches_follow_similarity():
    rng = np.random.default_rng(4)
    plan = near_dup.Plan(3, 85)
    for share in (0.85, 0.9, 0.95):
        both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        other = rng.integers(0, 2**63, 6000, dtype=np.uint64)
        own = int(3000 * (1 - share) / share / 2)
        a, b = (np.concatenate([both, x]) for x in (other[:own], other[own : 2 * own]))
        ones = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(*(near_dup.odd_sketch(near_dup.min_hashes(s, plan.samples)) for s in (a, b))))
        assert ones <= plan.most_ones


def test_chains_become_components(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(1, 40)] + [(b"\x60", b"\x61")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["comp"]) for r in near_dup.components(edges).collect()}
    assert set(got.values()) == {b"\x01", b"\x60"} and len(got) == 42


# Mixing


def test_targets_stop_at_the_bound(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 900, None: 70, "f": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    names = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        for s in full or list(open_):
            want[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(want[s] for s in full)
        open_ -= set(full or open_)
    assert got == pytest.approx(want)


def mix_misses(spark, docs):
    """Miss of each source as a share of its target."""
    rows = mixing.sample(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(r["most"] <= 2 for r in rows)
    return {r["source"]: abs(r["taken"] - r["target"]) / r["target"] for r in rows if r["target"]}


def test_mix_comes_near_its_targets(spark, sf_dir):
    assert max(mix_misses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).values()) < 0.05


def test_mix_passes_over_a_long_document(spark):
    """One document holds a third of its source, in eight sources; the targets are fractions of the size."""
    rows = [(1000 * s + i, " ".join(["w"] * (5_000 if i == 0 else 20 + i % 60)), f"s{s}") for s in range(8) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert max(mix_misses(spark, docs).values()) < 0.01


def test_mix_draws_long_documents_more_often(spark):
    """Inclusion within a class goes with the size, so the order is not that of the draw."""
    rows = [(i, " ".join(["w"] * (9 if i % 2 else 15)), "a" if i < 4_000 else "b") for i in range(4_400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = {(r["source"], r["size"]): r["n"] for r in mixing.sample(docs).withColumn("fraction", F.col("target") / F.col("source_size")).filter(
        F.col("copies") > F.floor("fraction")).groupBy("source", "size").agg(F.count("*").alias("n")).collect()}
    assert extra["a", 15] > 1.2 * extra["a", 9] > 0


# Repetition


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=80, deadline=None)
def test_suffix_array_repeats(symbols):
    got = repetition.repeat_lengths(np.array(symbols, dtype=np.int64))
    for i in range(len(symbols)):
        want = 0
        for j in range(len(symbols)):
            n = 0
            while i != j and max(i, j) + n < len(symbols) and symbols[i + n] == symbols[j + n]:
                n += 1
            want = max(want, n)
        assert got[i] == want


# Toxicity


def brute_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel():
    words = ["idiot", "id-iot", "moron", "mor", "x", ""]
    got = toxicity.kernel_values(words, ["idiot", "moron"])
    for i, s in enumerate(words):
        for j, t in enumerate(["idiot", "moron"]):
            own = brute_kernel(s, s) * brute_kernel(t, t)
            assert got[i, j] == pytest.approx(brute_kernel(s, t) / own**0.5 if own else 0.0, abs=1e-4)


def test_held_out_insults_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "re", "in", "es", "on", "ti"]) for _ in range(rng.randint(1, 4)))
    insults, texts, labels = ["idiot", "moron", "scum", "worthless"], [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(insults) <= set(model.landmarks)
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, model).alias("score")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows if r["held_out"]]
    assert sum(out) / len(out) > 0.95
    worst = dict(zip(["idxiot", "house", "id.iot"], model.worst(["an idxiot er", "an house er", "an id.iot er"])))
    assert min(worst["idxiot"], worst["id.iot"]) > worst["house"]


def test_kernel_of_many_characters(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    marks = ["abcab", "éab", "bbbbb"] + ["".join(chr(0x4E00 + 7 * i + k) for k in range(5)) for i in range(70)]
    got = toxicity.kernel_values(words + marks, marks)
    assert got[-len(marks) :].diagonal() == pytest.approx(np.ones(len(marks)), abs=1e-4)
    for i, s in enumerate(words):
        for j, t in enumerate(marks[:3]):
            own = brute_kernel(s, s) * brute_kernel(t, t)
            assert got[i, j] == pytest.approx(brute_kernel(s, t) / own**0.5 if own else 0.0, abs=1e-4)
    weights = np.linspace(-1, 1, len(marks)).astype(np.float32)
    for most in (toxicity.DENSE, 0):
        monkeypatch.setattr(toxicity, "DENSE", most)
        assert toxicity.Model(marks, weights, 0.5).string_scores(words + marks) == pytest.approx(got @ weights + 0.5, abs=1e-4)


def test_every_word_with_evidence_counts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "th", "re", "in", "es", "on", "ti"]) for _ in range(rng.randint(1, 4)))
    insults = ["".join(rng.choice("bcdfgklmpvwz") + rng.choice("aou") for _ in range(4)) for _ in range(30)]
    texts, labels = [], []
    for i in range(1600):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:  # one of them alone, so that none is found by another
            for _ in range(3):
                words.insert(rng.randrange(len(words)), insults[i // 4 % len(insults)])
        texts.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(insults) <= set(model.landmarks)
    rows = docs.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", toxicity.score(docs, model).alias("score")).collect()
    toxic = [r["score"] >= 0.5 for r in rows if r["doc_id"] % 4 == 0]
    clean = [r["score"] >= 0.5 for r in rows if r["doc_id"] % 4]
    assert sum(toxic) / len(toxic) > 0.95 and sum(clean) / len(clean) < 0.05
