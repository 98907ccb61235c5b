"""Samples and their bounds, models side by side, and what operators give for odd input, against plain Python."""

import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.llm import common, decontaminate, html, language, pipeline, quality, suffix, toxicity
from kinspark.llm import queries as llm_queries

from .test_operators import brute_suffix, text, toxic_rows


def test_sample_keeps_small_shares(spark):
    df = spark.range(3_000_000).select(F.col("id").alias("k"), F.lit("x").alias("y"))
    n = common.labelled_sample(df.withColumn("y", F.lit("x")), "k", "y", 1).count()
    assert n < 20  # a share of a third of a millionth
    assert 100 < common.labelled_sample(df, "k", "y", 200).count() < 300


def test_sample_keeps_its_bounds(spark):
    rows = [(i, "ab"[i % 2], "x" * (10 + i % 90)) for i in range(4000)] + [(9000, "a", "y" * 100_000), (None, "a", "z")]
    df = spark.createDataFrame(rows, "k bigint, y string, x string")
    scratch = common.Scratch(spark, "test")
    for most, size in ((50, 1 << 20), (4000, 3000), (5000, 1 << 30)):
        got = common.bounded_sample(scratch, df, "k", "y", "x", most, size).to_pylist()
        for y in "ab":
            own = [r for r in got if r["y"] == y]
            assert len(own) <= most and sum(len(r["x"]) for r in own) <= size and own
    assert len(got) == 4001


def test_language_models_side_by_side(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, ("water and fields " if i % 2 else "maison et champs ") * 5, "ab"[i % 2], "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string").coalesce(1)
    swapped = docs.withColumn("lang", F.translate("lang", "ab", "ba"))
    one, two = language.train(docs, path), language.train(swapped, path)
    for model, names in ((one, "ab"), (two, "ba"), (one, "ab")):
        assert all(r["lang_pred"] == names[r["doc_id"] % 2] for r in language.predict(docs, model).collect())
    odd = [(1, "½ ① 123", None), (2, "½ ① é", None), (3, None, None), (4, "water and fields " * 3, "a"), (4, "water and fields " * 3, "a")]
    got = [tuple(r) for r in language.predict(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"), one).collect()]
    assert got[0][1:] == ("und", 0.0) and got[1][1] in "ab" and got[2][1:] == ("und", 0.0) and got[3] == got[4]
    assert language.predict(docs.limit(0), one).count() == 0
    none = language.train(docs.filter("false"), path)
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


def test_language_sums_long_pieces_and_words():
    rng = np.random.default_rng(3)
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b"abcab", b"abcabcabcabcabcab", b"c" * 33]
    p = np.zeros((len(pieces) + 1, 2))
    p[:-1] = rng.random((len(pieces), 2)) / 300
    model = language.LanguageModel(pieces, ["x", "y"], p, np.ones(2))
    words = [b" abc", b" " + b"abc" * 40, b"c" * 700, b" " + bytes(rng.choice([97, 98, 99], 5000).astype(np.uint8)), b"z"]

    def total(word, k):
        """Sums over segmentations, as pairs of a number and the power of 2 left out."""
        at, lift = [1.0] + [0.0] * len(word), 0
        for j in range(len(word)):
            if 0 < at[j] < 1e-200:
                at, lift = [0.0] * j + [x * 2.0**600 for x in at[j:]], lift + 600
            for i, x in enumerate(pieces):
                if word.startswith(x, j):
                    at[j + len(x)] += at[j] * p[i, k]
        return np.log(at[-1]) - lift * np.log(2)

    got = model.word_scores(language.Pieces(pieces), words)
    assert got == pytest.approx(np.array([[total(w, k) for k in (0, 1)] for w in words]), rel=1e-5)


def test_models_reach_workers_without_this_library(tmp_path):
    """Workers that can't import the library run what travels by value."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executorEnv.PYTHONPATH", "").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", 2).getOrCreate()
from kinspark.llm import quality, toxicity
docs = spark.createDataFrame([(i, ("bad word " if i % 2 else "good text ") * 9) for i in range(40)], "doc_id bigint, text string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 40
rows = quality.score(docs, quality.train(docs, labels)).collect()
assert len(rows) == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=tmp_path, timeout=240)


def odd_documents(spark):
    """Nulls, empties, repeats, a long text, and columns whose names the operators use."""
    rng = random.Random(1)
    rows = [(1, "one text " + text(rng, 20)), (1, "one text " + text(rng, 20)), (2, None), (3, ""), (None, "no key " + text(rng, 9)), (4, text(rng, 90_000)), (5, "é" * 50), (5, "é" * 50)]
    return spark.createDataFrame([(i, t, 1, 2.0, "r", 4, 5, 6) for i, t in rows], "doc_id bigint, text string, score int, k double, x string, y int, id int, row int"), rows


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_documents(spark, operator, label):
    docs, rows = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, "a"), (3, 0, "b"), (4, 0, "c"), (5, 1, "d"), (None, 1, "e"), (2, None, "f"), (99, 1, "g")], f"doc_id bigint, {label} int, x string")
    for marks in (labels, labels.filter("false"), labels.filter(f"{label} = 1")):
        model = operator.train(docs, marks)
        got = operator.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        by = {}
        for (i, t), r in zip(rows, got):
            assert by.setdefault(t or "", r["score"]) == pytest.approx(r["score"], abs=1e-6)
    assert operator.score(docs.filter("false"), model).count() == 0
    assert operator.score(docs.filter("false"), operator.train(docs.filter("false"), labels)).count() == 0


def test_quality_reads_long_texts_in_parts():
    random_ = np.random.default_rng(2)
    data = random_.integers(1, 255, 3 * common.SLICE_BYTES + 77).astype(np.uint8)
    net = quality.fit(data[:4096], np.arange(0, 4097, 256), np.array([0, 1] * 8))
    whole = net.layers(*quality.padded(data, np.array([0, len(data)])))["z"][0]
    assert net.long_text(data) == pytest.approx(float(whole), rel=1e-4)


def test_toxicity_reads_long_texts_in_parts():
    rng = random.Random(3)
    words = text(rng, 90_000).encode()
    assert len(words) > 2 * common.SLICE_BYTES
    data, ends = np.frombuffer(words, np.uint8), np.array([0, len(words)])
    who, key = toxicity.terms(data, ends)
    parts = [toxicity.terms(data[a:b], np.array([0, b - a]))[1] for a, b in common.cut_at(data, ~toxicity._WORD)]
    assert len(parts) > 1 and (np.sort(np.concatenate(parts)) == np.sort(key)).all()


def test_suffix_one_key_with_several_texts(spark):
    rng = random.Random(21)
    p, q, r = (text(rng, 25) for _ in range(3))
    rows = [(1, p + " a " + q), (1, r + " b " + p), (2, q + " c " + r), (2, p + " d " + q + " e"), (2, q + " c " + r), (3, r), (0, q[:80])]
    got = sorted((x[0], x[1], x[2], x[3], bytes(x[4])) for x in suffix.cut_repeats(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, id int, row int")).collect())
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), "".join(c for c, g in zip(t, gone) if not g).encode()))
    assert got == sorted(want)


def test_suffix_long_texts_and_empty_tables(spark):
    rng = random.Random(22)
    long = text(rng, 80_000)
    rows = [(1, long), (2, "x" + long[: len(long) // 2] + "y" + long[300_000:]), (3, long[99_990:400_000]), (4, None), (5, "")]
    assert len(long) > 2 * common.SLICE_BYTES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix.cut_repeats(docs).collect()}
    assert got == brute_suffix(rows)
    assert suffix.cut_repeats(docs.filter("false")).count() == 0


def test_stages_keep_rows_and_columns(spark):
    docs, rows = odd_documents(spark)
    docs = docs.withColumn("n_chars", F.char_length("text")).withColumn("rest", F.lit(7))
    got = pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    near = pipeline.drop_near_duplicates(spark, docs, "")
    assert near.columns == docs.columns and sorted(str(r[0]) for r in near.collect()) == sorted(str(i) for i, _ in rows)
    assert pipeline.cut_repeats(spark, docs.filter("false"), "").count() == pipeline.drop_near_duplicates(spark, docs.filter("false"), "").count() == 0
    tokens = pipeline.tokenize(spark, docs, "").collect()
    assert [(r["doc_id"], r["text"]) for r in tokens] == [(i, t or "") for i, t in rows]


ARTICLE = "It is the plain text of a page and this is all of it"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content with-sidebar"><p>{ARTICLE}</p></div>', ARTICLE),
        (f'<div class="layout no-sidebar"><article><p>{ARTICLE}</p></article></div>', ARTICLE),
        (f'<div class="sidebar-wrap"><article><p>{ARTICLE}</p></article></div>', ARTICLE),
        (f'<article><div class="post-header"><h1>The headline of it</h1></div><p>{ARTICLE}</p></article>', f"The headline of it\n{ARTICLE}"),
        (f"<article><p>{ARTICLE} where <math><mi>x</mi><annotation>x</annotation></math> stands</p></article>", f"{ARTICLE} where x stands"),
        (f'<article><p>{ARTICLE}</p></article><div class="page-footer"><p>{ARTICLE} and the foot</p></div>', ARTICLE),
        (f'<main><p>{ARTICLE}</p></main><div class="sidebar"><article><p>{ARTICLE} in brief</p></article></div>', ARTICLE),
        (f"<nav>{'<b>' * 300}x</nav><p>{ARTICLE}</p>", ARTICLE),
        (f"<aside><article><p>{ARTICLE}</p></article></aside>", ""),
        (f'<article><p>{ARTICLE}</p><section id="comments"><article class="comment"><p>{ARTICLE} says a reader</p></article></section></article>', ARTICLE),
    ],
)
def test_html_pages(page, want):
    assert html.main_text(page) == want


def brute_contaminated(docs, items):
    """The rules of the operator's docstring, pair by pair."""
    strip = ".,;:!?\"'()[]{}<>*#$&|-_"

    def words(t):
        raw = (t or "").split()
        out = []
        for i, w in enumerate(raw):
            bare, last = w.strip(strip), (raw[i - 1][-1] if i else ".")
            if bare[:1] and "0" <= bare[0] <= "9":
                out.append("<num>")
            elif bare[:1].lower() != bare[:1] and last not in ".!?:":
                out.append("<name>")
            elif bare.lower() in decontaminate.UNITS:
                out.append("<unit>")
            else:
                out.append(bare.lower())
        return raw, out

    slots, found = {"<num>", "<name>", "<unit>"}, {}
    for d, t in docs:
        raw, doc = words(t)
        for i, s in items:
            own_raw, own = words(s)
            if d is None or i is None or len(own) < 3:
                continue
            n = min(8, len(own))
            windows = [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
            literal = {w for w in windows if sum(x not in slots for x in w) >= 3}
            counted = literal or set(windows)
            reading = {w: w for w in counted}
            bare = own_raw[0].strip(strip)
            if bare[:1].lower() != bare[:1] and own[0] not in slots and windows[0] in counted:
                reading[("<name>", *windows[0][1:])] = windows[0]
            theirs = [tuple(doc[k : k + n]) for k in range(len(doc) - n + 1)]
            held = {reading[w] for w in theirs if w in reading}
            if len(held) < 0.5 * len(counted):
                continue
            places = {w: [k for k, x in enumerate(windows) if x == reading[w]] if w in counted else [0] for w in reading}
            shifts = [(k, j - k) for j, w in enumerate(theirs) if w in reading for k in places[w]]
            often = {x: sum(y == x for _, y in shifts) for _, x in shifts}
            alone = {}
            for k, x in shifts:
                alone[k] = max(alone.get(k, (0, 0)), (often[x], -x))

            def beside(pairs):
                return [(own[a], doc[b], own_raw[a].strip(strip), raw[b].strip(strip)) if 0 <= b < len(doc) else None for a, b in pairs]

            whole = [beside([(a, a + x) for a in range(len(own))]) for x in often]
            layouts = whole + [beside([(a, a - back) for k, (_, back) in alone.items() for a in range(k, k + n)])]
            kinds = set()
            if any(all(x and x[2].lower() == x[3].lower() for x in layout) for layout in whole):
                kinds.add("exact")
            for layout in layouts if literal else ():
                met = {(x[0], x[2], x[3]) for x in layout if x and x[0] == x[1] and x[0] in slots}
                if len(met) == len({x[:2] for x in met}):
                    kinds.add("partial" if all(x[1] == x[2] for x in met) else "reparameterised")
            if kinds:
                found[d, i] = min([*kinds, found.get((d, i), "z")])
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(31)
    plain = "the a in of to and with has every bus apple school market town sells buys counts walks runs takes gives before after".split()

    def question(n):
        out = []
        for _ in range(n):
            out.append(rng.choice([*plain, *plain, str(rng.randint(1, 60)), rng.choice(["Maria", "Peter", "Li"]), rng.choice(["km", "hours", "$3"])]) + rng.choice(["", "", "", ",", "."]))
        return " ".join(out)

    items = [(i, question(rng.choice([4, 7, 9, 12, 20, 30]))) for i in range(30)] + [(100, "Where the bus runs"), (101, "Maria Peter Li Maria"), (102, "12 + 30"), (103, None), (None, question(9)), (104, "two words")]
    docs = []
    for j in range(120):
        item = rng.choice([s for _, s in items if s])
        words = item.split()
        way = j % 8
        if way == 1:
            words = [w if not w[0].isdigit() else str(rng.randint(1, 60)) for w in words]
        elif way == 2:
            words = words[: 2 * len(words) // 3]
        elif way == 3:
            words.insert(len(words) // 2, "really")
        elif way == 4:
            words = [w.upper() for w in words]
        elif way == 5:
            words = [w.replace("Maria", "Peter") for w in words] + words
        elif way == 6:
            rng.shuffle(words)
        docs.append((j if j % 17 else None if j % 2 else j, " ".join([question(rng.randint(0, 12)), *words, question(rng.randint(0, 12))]).strip()))
    docs += [(900, None), (901, ""), (902, "Where the bus runs"), (903, 'he said: "Where the bus runs" (and Where the bus runs)'), (1, docs[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id bigint, text string, number int, hash int, item bigint")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminated(table, bench).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and {"exact", "partial", "reparameterised"} == set(want.values()) and (903, 100) in want


def test_urls_sql_names_the_rules():
    assert all(r in llm_queries.ORACLE_SQL["op3_urls"] for _, r in llm_queries.URL_RULES) and re.search("page_id", llm_queries.ORACLE_SQL["op3_urls"])
