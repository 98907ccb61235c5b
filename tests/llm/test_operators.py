"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.llm import bpe, common, decontaminate, html, jaccard, language, quality, suffix, toxicity, urls, vectors
from kinspark.llm.queries import URL_RULES

WORDS = "the of and lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore magna aliqua enim minim veniam quis nostrud".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    docs = [text(rng, rng.randint(1, 120)) for _ in range(40)]
    docs += [docs[0], docs[0], docs[1].upper(), docs[2] + " tail", docs[3].replace("the", "a", 1), None, "", "   \n ", "one two", "one  two", "One Two three"]
    passage = text(rng, 40)
    docs += [text(rng, 30) + " " + passage + " " + text(rng, 30) for _ in range(6)]
    near = text(rng, 90).split()
    docs += [" ".join(near[:i] + ["changed"] + near[i + 1 :]) for i in range(0, 90, 9)]
    docs += [text(rng, 4000), "x" * 3000, "日本 " * 80 + "é"]
    return [(i * 3, d) for i, d in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, d, "en", "s", 0, 1, 2) for i, d in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, ids int").repartition(3)


def brute_jaccard(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return {i: (len(s), top[i]) for i, s in sets.items()}


def test_jaccard(docs):
    got = {r[0]: (r[1], r[2]) for r in jaccard.link(docs).collect()}
    assert got == brute_jaccard(corpus())


def test_jaccard_tree_keeps_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 90), dtype=np.int64).astype(np.uint64)])) for _ in range(80)]
    order = np.argsort([len(s) for s in sets])[::-1]
    sets = [sets[i] for i in order]
    points = jaccard.Points(np.array([len(s) for s in sets]), [jaccard.count_vector(s) for s in sets])
    comp, every = np.arange(80), np.arange(80)
    true = {(a, b) for a in range(80) for b in range(a) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))}
    by_tree = set(zip(*(x.tolist() for x in jaccard.tree_pairs(points, every, every, comp))))
    by_sides = set(zip(*(x.tolist() for x in jaccard.tree_pairs(points, every[::2], every[1::2], comp))))
    by_leaf = set(zip(*(x.tolist() for x in jaccard.leaf_pairs(points, every, np.array([0]), np.array([80]), comp))))
    assert true and true <= by_tree and by_tree == by_leaf
    assert {(a, b) for a, b in true if a % 2 != b % 2} <= by_sides
    bits = rng.integers(0, 1 << 62, 3000, dtype=np.int64).astype(np.uint64)
    wide = np.frombuffer(jaccard.count_vector(bits), np.uint8).reshape(1, 3, -1)
    counts = np.bincount((bits & np.uint64(wide.shape[2] * 4 - 1)).astype(np.int64))
    assert (np.unpackbits(jaccard.folded(wide), axis=2, bitorder="little").sum(axis=1)[0] == np.minimum(counts, 3)).all()


def test_components_of_few_edges_take_one_table(spark, monkeypatch):
    """Few edges are one table, not several a round; many go the long way to the same components."""
    rng = random.Random(2)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    top = {x: x for p in pairs for x in p if x is not None and p[0] != p[1] and None not in p}
    while any(top[a] != top[b] for a, b in pairs if b is not None and a != b):
        for a, b in pairs:
            if b is not None and a != b:
                top[a] = top[b] = min(top[a], top[b])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    for few in (common.FEW_EDGES, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        scratch = common.Scratch(spark, "test")
        got = common.components(scratch, edges)
        assert {r["id"]: r["component"] for r in got.collect()} == top and got.count() == len(top)
        assert len(scratch.made) == 1 or not few
    assert common.components(scratch, edges.filter("false")).collect() == []


def test_jaccard_names_few_pairs_of_near_copies(spark, monkeypatch):
    """Of a group of near copies, some of them linked only through others, few pairs are verified and no link is lost."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    verified, write = [], jaccard.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "pairs":
            verified.append(out.count())
        return out

    monkeypatch.setattr(jaccard.Scratch, "write", counted)
    got = {r[0]: (r[1], r[2]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_jaccard(rows)
    assert sum(verified) <= 5 * len(rows)


def test_jaccard_crowds_come_few_times(spark, monkeypatch):
    """The last round's tiles of groups of near copies don't grow with their squares, and no link is lost."""
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    tiles, write = [], jaccard.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "tiles":
            tiles.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "TILE", 64)
    monkeypatch.setattr(jaccard.Scratch, "write", counted)
    got = {r[0]: (r[1], r[2]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_jaccard(rows)
    assert tiles[-1] <= 10 * len(rows)


@pytest.mark.parametrize("searched", [jaccard.SEARCHED, 30])
def test_jaccard_crowd_tiles_hold_every_pair(spark, monkeypatch, searched):
    """Classes of one group and of different components share a tile, whether groups become a crowd, stay alone, or have no main component."""
    rng = random.Random(7)
    groups = {-1 - s: rng.sample(range(100), 70) for s in range(8)} | {-20: range(200, 300), -21: [*range(300, 340), 5]} | {-30 - s: [1000, *range(1001 + 50 * s, 1051 + 50 * s)] for s in range(9)}
    groups[-40] = [*range(2000, 2400)]
    comp = {k: min(k, 2000) if k < 2390 else k for k in range(2000, 2400)} | {k: k % 100 % 60 for k in range(300)}
    rows = [(s, k, comp.get(k, k), min(ks)) for s, ks in groups.items() for k in ks]
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "SEARCHED", searched)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0 if searched == 30 else jaccard.BROADCAST_ROWS)
    found = jaccard.crowd_tiles(common.Scratch(spark, "test"), spark.createDataFrame(rows, "sign bigint, key bigint, component bigint, first bigint"), 4).collect()
    tiles, met = {}, set()
    for r in found:
        tiles.setdefault((r["sign"], r["p"], r["q"]), ([], []))[r["side"]].append(r["key"])
    for a, b in tiles.values():
        met |= {(min(x, y), max(x, y)) for x in (b or a) for y in a}
    for ks in groups.values():
        assert all((min(x, y), max(x, y)) in met for x in ks for y in ks if x != y and comp.get(x, x) != comp.get(y, y))
    signs = {r["sign"] for r in found}
    assert not signs & {-1 - s for s in range(8)} and signs >= {-30 - s for s in range(9)}
    assert searched == 30 or sum(r["sign"] in (-40, 2000) for r in found) <= 450


def test_jaccard_null_ids_and_long_texts(spark):
    rng = random.Random(5)
    a, b, c = (text(rng, 60) for _ in range(3))
    rows = [(None, a), (4, a + " end"), (None, a), (None, b), (None, b + " end"), (7, c), (9, None), (None, None), (None, "")]
    long = text(rng, 60_000)
    rows += [(20, long), (21, long.upper() + "  "), (22, "start " + long)]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    sizes = {i: n for i, n, _ in got if i is not None}
    assert len(got) == len(rows) and [x for x in got if x[0] in (4, 7, 9, 20, 21, 22)] == sorted([(4, 57, 4), (7, 56, 7), (9, 0, 9), (20, sizes[20], 20), (21, sizes[20], 20), (22, sizes[20] + 1, 20)], key=str)
    assert sorted([(n, c) for i, n, c in got if i is None and n], key=str) == sorted([(56, 4), (56, 4), (56, None), (57, None)], key=str)


def brute_suffix(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, cover) if not m)
        out[i] = (len(raw), len(raw) - len(kept), sum(1 for k, m in enumerate(cover) if m and (k == 0 or not cover[k - 1])), kept)
    return out


def test_suffix(docs):
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix.cut_repeats(docs).collect()}
    assert got == brute_suffix(corpus())


def test_suffix_crowd(docs, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", 1)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix.cut_repeats(docs).collect()}
    assert got == brute_suffix(corpus())


def repeating():
    rng = random.Random(11)
    p, q, x, y, z = (text(rng, 30) for _ in range(5))
    rows = [(1, p + z), (2, x + p + y + q + x + p + y), (3, (x + p + y + q) * 3 + p), (4, "ab" * 60), (5, "c" + "ab" * 200 + "d" + "ab" * 90 + "e")]
    rows += [(6 + i, text(rng, 3) + p[i : i + 90] + text(rng, 9) + p[i : i + 90]) for i in range(12)]
    return rows + [rows[1], (30, y + p + x + p + y + p + x)]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_block_repeats_in_a_document(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rows = repeating()
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_suffix(rows)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(1, 30), 300]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert list(suffix.suffix_array(s)) == sorted(range(n), key=lambda i: s[i:].tolist())


def test_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.Merges(bpe.read_ranks(path)).ids
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = corpus() + [(1000 + i, "".join(rng.choice(" \n\t'abs12é日.!\x85\xa0ll re") for _ in range(rng.randint(0, 50)))) for i in range(300)] + [(9999, "ab" * 3000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path).collect()}
    for i, t in rows:
        assert got[i]["ids"] == own.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def toxic_rows():
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        words, bad = text(rng, rng.randint(5, 80)).split(), i % 3 == 0
        if bad:
            words.insert(rng.randint(0, len(words)), rng.choice(["dolt", "oaf", "cretin"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 1200], "doc_id bigint, quality int, toxic int")
    got = {r[0]: r[1] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    said = {y: [got[i] >= toxicity.THRESHOLD for i, _, z in rows if i >= 1200 and z == y] for y in (0, 1)}
    assert np.mean(said[0]) < 0.01 and np.mean(said[1]) > 0.85
    empty = toxicity.train(docs, labels.limit(0))
    assert empty.bias < 0 and toxicity.score(docs.limit(0), empty).count() == 0


def test_toxicity_learns_pairs():
    rng = random.Random(2)
    texts, label = [], []
    for _ in range(1500):  # toxic only where both words meet
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(WORDS, 6) + ["insultword"] * a + ["groupword"] * b))
        label.append(int(a and b))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    model = toxicity.fit(data, offsets, np.array(label))
    assert np.mean((model.scores(data, offsets) >= 0.5) == np.array(label)) > 0.95


def test_quality():
    rng = random.Random(4)
    good = [text(rng, rng.randint(20, 150)) for _ in range(300)]
    junk = ["!! ".join(text(rng, rng.randint(20, 100)).upper().split()) for _ in range(300)]
    texts = good[:250] + junk[:250]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    net = quality.fit(data, offsets, np.array([1] * 250 + [0] * 250))
    texts = good[250:] + junk[250:] + [""]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    scores = net.scores(data, offsets)
    assert (scores[:50] >= 0.3).mean() > 0.95 and (scores[50:100] < 0.3).mean() > 0.95 and 0 <= scores[100] <= 1
    alone = net.scores(data[offsets[7] : offsets[8]], np.array([0, offsets[8] - offsets[7]]))
    assert alone[0] == pytest.approx(scores[7], abs=1e-4)  # a text's score doesn't hang on its neighbours


def test_language(spark):
    import public_tokenizers

    sets = {"en": "the water house with children running over green fields", "fr": "une maison avec des enfants qui courent dans les champs verts", "de": "das wasser und kinder laufen ueber gruene felder mit freude"}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(sets[k].split()) for _ in range(30)), k) for i, k in enumerate(sorted(sets) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "water " * 5 + "w" * 500, None)], "doc_id bigint, text string, lang string")
    model = language.train(df.filter("doc_id < 60"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r[0]: (r[1], r[2]) for r in language.predict(df, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and [got[i][0] for i in (900, 901, 902)] == ["und"] * 3 and got[900][1] == 0.0 and got[903][0] == "en"


def test_language_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b" a"]
    rng = np.random.default_rng(0)
    p = np.zeros((len(pieces) + 1, 1))
    p[:-1, 0] = rng.random(len(pieces)) / 300
    model = language.LanguageModel(pieces, ["x"], p, np.ones(1))

    def total(word):
        return 1.0 if not word else sum(p[i, 0] * total(word[len(x) :]) for i, x in enumerate(pieces) if word.startswith(x))

    words = [b" abc", b"abcab", b" ", b"zab"]
    assert np.exp(model.word_scores(language.Pieces(pieces), words)[:, 0]) == pytest.approx([total(w) for w in words], rel=1e-5)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(3, 16))
    rows = [(i, (centre[i % 3] + rng.normal(size=16) * 0.05).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=16).tolist()) for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16), (206, []), (207, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, id int, many int")
    got = {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(df).collect()}
    good = {i: np.array(v) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j in good if j != i and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95] for i in good}
    assert {i: n for i, (n, _) in got.items()} == {i: len(links.get(i, [])) for i, _ in rows}
    assert got[200][1] == got[0][1] == 0 and got[202][1] == 202
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [16_384, 100])
def test_vectors_in_a_cone(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "WINDOW", 16)
    monkeypatch.setattr(vectors, "FEW", few, raising=False)
    rng = np.random.default_rng(1)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(rng.normal(size=(1500, 48)))
    x[:1000] = unit(0.9**0.5 * x[0] + 0.1**0.5 * x[:1000])
    x = np.concatenate([x, unit(x[:1500:5] + 0.3 * unit(rng.normal(size=(300, 48))))])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    top = vectors.joined(a, b, len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(df).collect()}
    assert len(a) > 300 and got == {i: (int(near[i].sum()), int(top[i])) for i in range(len(x))}


def test_decontamination(spark):
    rng = random.Random(8)
    items = [text(rng, 20), "Calculate how many apples Maria sells when she sells 12 apples per hour for 3 hours", "a b", None, "three short words"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    changed = "So: Calculate how many apples Peter sells when she sells 45 apples per hour for 7 hours. Thanks"
    rows = [(1, "before " + items[0] + " after"), (2, changed), (3, text(rng, 200)), (4, None), (5, ""), (6, "x three short words y"), (7, " ".join(items[0].split()[:8])), (8, items[0].upper()), (1, "before " + items[0] + " after")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, item bigint, hash int")
    got = {(r[0], r[1]): r["kind"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1, 0] == "exact" and got[2, 1] == "reparameterised" and got[6, 4] == "exact"
    assert {k[0] for k in got} <= {1, 2, 6, 8}
    clash = [(9, "Calculate how many apples Maria sells when she sells 12 apples per hour for 3 hours".replace("Maria sells", "Peter sells"))]
    assert decontaminate.contaminated(spark.createDataFrame(clash, "doc_id bigint, text string"), bench).count() == 1
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_tries_every_place(spark):
    item = "so Maria sells 12 apples per hour for 3 hours and then she gives 12 apples away to all of her friends at school today before Maria goes home with the rest of them"
    other = item.replace("sells 12", "sells 45").replace("gives 12", "gives 77")
    words = item.split()
    longer = " ".join(words[:16] + ["really"] + words[16:])
    docs = [(1, item), (2, other), (3, other + " . " + item), (4, "it was " + longer), (5, other + " . " + other), (6, "well " + item.replace("12", "13"))]
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r["kind"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: "exact", 3: "exact", 4: "partial", 6: "reparameterised"}  # a word put in leaves a copy that isn't word for word


def test_urls(spark):
    rows = ["http://Example.COM/en/1", "https://www.example.com/en/2?x#y", "https://a.b.net/es/1", "net/es/1", None, "", "ftp://shop.com", "https://xcom/", "https://z.org/fr/spam", "https://example.com/de/3"]
    rows += [f"https://good{i}.com/page/{i}" for i in range(30)] + [f"https://bad{i}.net/fr/spam{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, 0) for i, u in enumerate(rows)], "page_id bigint, url string, shape int")
    got = {r["page_id"]: r for r in urls.judge(df, URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None, "com/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 8, 9)] == ["block", "allow", "block", "block", "allow"]
    assert (got[3]["host"], got[4]["path"], got[0]["host"]) == ("", "", "example.com")
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert {r["verdict"] for r in urls.judge(df.limit(0), URL_RULES).collect()} == set()
    assert urls.judge(df, []).filter("verdict <> 'allow'").count() == 0


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home of the site</a></ul></nav>
<div class="cookie-notice">We use cookies for the best of the site and you can read about it</div>
<article><header><h1>The   head &amp; line</h1></header><p>First of the paragraphs with a <a href=x>link</a> in it,<br>and more of it.</p><div class=ad>Buy the best of all</div>
<p>Short.</p><script>var x = "</p>";</script><section id="comments"><p>I am the comment of a reader and this is what I think of it</p></section></article>
<aside>Related to this and that of the site</aside><form><p>Search the site for all of it</p></form><footer>&copy; the owner of the site</footer>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>It is the plain text of a page that has no article at all", 5), (5, "u", "<div><!-- open", 5), (1, "u", PAGE, 5)], "page_id bigint, url string, html string, text int")
    got = {r[0]: r["text"] for r in html.extract(pages).collect()}
    assert got[1] == "The head & line\nFirst of the paragraphs with a link in it, and more of it.\nShort."
    assert (got[2], got[3], got[5]) == ("", "", "") and got[4].startswith("It is the plain")


def test_html_left_out_end_tags():
    article = "<article><p>It is the plain text of a page and this is all of it</article>"
    for tag in ("li", "dt", "td"):
        assert html.main_text(f"<nav><ul>{f'<{tag}>an entry' * 500}</ul></nav>{article}").startswith("It is the plain")
    for head in ("<head><title>T</title><meta a=b>", "<head><script>'<p>'</script><!-- <p> --><title>T</title></head><body>", "<head><link x><title>T</title><body class=x>"):
        assert html.main_text(f"<html>{head}{article}") == "It is the plain text of a page and this is all of it"
    assert html.main_text(f"<head><title>It is the title of the page and of all in it</title>{article}") == "It is the plain text of a page and this is all of it"
    assert html.main_text(f"<header><p>The name of the site and all of it</p></header>{article}") == "It is the plain text of a page and this is all of it"


def test_html_keeps_signs_and_other_languages():
    one, two = "The sign &copy; stands for the copyright of this text and of all of it", "Short &copy; of it"
    assert html.main_text(f"<article><p>{one}<p>{two}</article><p>&copy; the owner") == f"{one}\n{two}".replace("&copy;", "©")
    first, other = "It is the plain text of a page and this is all of it", "Suomalainen kirjoitus kertoo vanhasta talosta " * 6
    assert html.main_text(f"<p>{first}<p>{other}") == f"{first}\n{other.strip()}"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_rows()[:300]
    clean = corpus()
    docs = [(i, t) for i, t, _ in rows] + [(2000 + i, t) for i, t in clean]
    leak = text(random.Random(99), 20)
    docs += [(9000, "start of it " + leak + " end")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 9000 not in out and 2000 in out and 2000 + 3 * 40 not in out
    toxic = [i for i, _, y in rows if y]
    assert sum(i in out for i in toxic) < 0.1 * len(toxic) and sum(i in out for i, _, y in rows if not y) > 0.9 * (len(rows) - len(toxic))
    for r in out.values():
        assert r["n_tokens"] == len(r["ids"])
    assert hashlib.sha256(out[2003]["text"].encode()).hexdigest()


def test_pipeline_cut_inside_characters(spark):
    from kinspark.llm import pipeline

    rng = random.Random(12)
    p, q = text(rng, 20) + " caf", text(rng, 20)
    rows = [(1, p + "é" + q), (2, "b\ufffd " + p + "è, and on"), (3, "日" + q[:60] + "本"), (None, p)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.cut_repeats(spark, docs, "").collect()}
    kept = {i: want[3] for i, want in brute_suffix([r for r in rows if r[0]]).items()}
    assert any(x.decode("utf-8", "ignore").encode() != x for x in kept.values())
    assert got[1][0] == rows[0][1] and got[2][0] == "b\ufffd , and on" and got[None][0] == p
    assert all(n == len(t) and "\ufffd" not in t.replace("b\ufffd", "") for t, n in got.values())


def test_whole_characters():
    raw, gone = "aéxèb".encode(), np.ones(7, bool)
    gone[2:5] = False  # leaves the first byte of é beside the last byte of è
    assert suffix.whole_characters(raw, gone) == b"ab"
