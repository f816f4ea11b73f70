"""Packing, language models, toxicity, language spans and page text: exact properties, plain versions and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorefield.llm import brown, htmlmain, langid, levenshtein, packing, toxicity
from tests.llm import plain

TEXTS = ["", None, "Hello wOrld!", "héé ﬁ \U0001f600 <|endoftext|> x", "a" * 20000, "word " * 3000, "\n\n\t tab", "Zürich 12345 'll don't"]


def pack(docs, **options):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **options)


def test_pack_round_trip(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["alpha", "Beta", "γ", "42", "x.y"], k=rng.randint(1, 900))) for _ in range(60)] + ["same text"] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group_rows=30).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for piece in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start):
            assert (piece.start, piece.doc_tokens) == (at, len(ids))
            assert piece.ids_crc32 == plain.crc(ids[at : at + piece.length])
            at += piece.length
        assert at == len(ids)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 1024


def test_pack_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, None, 9)], "doc_id long, text string, start long")
    assert sorted((r.doc_id or 0, r.start, r.length) for r in pack(docs).collect()) == [(0, 0, 1), (1, 0, 2), (1, 0, 2)]
    assert pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_token_once_with_little_padding(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randint(1, 3000), 600, 600)) for _ in range(400)]
    pieces = packing.plan(sizes)
    for doc, size in enumerate(sizes):
        own = sorted((s, n) for d, s, n, _, _ in pieces if d == doc)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == size
    fills = Counter()
    for _, _, n, sequence, _ in pieces:
        fills[sequence] += n
    assert max(fills.values()) <= 1024 and len(fills) * 1024 <= sum(sizes) * 1.02 + 1024
    assert packing.plan([]) == []


def test_first_fit_takes_the_first_bin_with_room():
    rng = random.Random(3)
    tree, free = packing.BinTree(50, 100), [100] * 50
    for _ in range(50):
        need = rng.randint(1, 100)
        want = next(i for i, f in enumerate(free) if f >= need)
        assert tree.put(need) == (want, free[want])
        free[want] -= need


def test_base_scores_and_counts(spark):
    rng = random.Random(2)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(left if i % 2 else right, k=rng.randint(0, 60)) + [f"new{i}"]), i % 5 == 0) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (None, "L1 l1", True)]
    got = brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3), classes=6).collect()
    tokens = {d: plain.WORDS.findall(plain.low(t)) + [None] for d, t, _ in rows}
    counts = Counter(w for d, _, held in rows if not held for w in tokens[d])
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
        assert r.score <= 0
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(5)
    size = brown.END_UNIT + 1 + 3
    pairs = np.zeros((size, size))
    pairs[-8:, -8:] = rng.integers(0, 50, (8, 8))
    shape = np.zeros((4, brown.ENDINGS + 1))
    shape[:, -8:-3] = [[20] * 5, [9] * 5, [4] * 5, [2] * 5]
    model = brown._model(pairs, np.arange(1, 4, dtype=np.uint64), shape, 100, 50, 4)
    assert np.allclose((10**model.transition).sum(1), 1)
    for label in range(4):
        assert math.isclose((10 ** model.unit_given_class[model.label == label]).sum(), 1) or not (model.label == label).any()


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((8, 8))
    pairs[np.ix_([0, 2, 4, 6], [1, 3, 5, 7])] = 10
    pairs[np.ix_([1, 3, 5, 7], [0, 2, 4, 6])] = 10
    label = brown.exchange_clusters(pairs, 2)
    assert len(set(label[::2])) == len(set(label[1::2])) == 1 and label[0] != label[1]


def test_word_gains_are_those_of_moving_one_word():
    rng = np.random.default_rng(6)
    text, size = rng.integers(0, 12, 400), 4
    label = rng.integers(0, size, 12)
    pairs = np.zeros((12, 12))
    np.add.at(pairs, (text[:-1], text[1:]), 1)
    table = lambda label: np.eye(size)[label].T @ pairs @ np.eye(size)[label]
    found = Counter()
    for a, b in zip(text[:-1].tolist(), text[1:].tolist(), strict=True):
        found.update([(b, 2 * size)] if a == b else [(a, label[b]), (b, size + label[a])])
    word, code, n = (np.array(x) for x in zip(*((w, c, k) for (w, c), k in sorted(found.items())), strict=True))
    gains = brown.word_gains(table(label), label, word, code, n)
    for w in range(12):
        want = [brown.likelihood(table(np.where(np.arange(12) == w, k, label))) for k in range(size)]
        assert np.allclose(gains[w] - gains[w][0], np.array(want) - want[0])


def test_every_word_is_exchanged_not_its_ending(spark):
    """Two kinds of rare words, all with the same ending, alternate; as many common words keep them from being frequent."""
    rng = random.Random(7)
    kinds = [[f"{c}{i}end" for i in range(400)] for c in "ab"]
    texts = [" ".join(kinds[j % 2][rng.randrange(400)] for j in range(100)) for _ in range(300)]
    rows = [(i, t, i >= 250) for i, t in enumerate(texts)]
    got = brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3), classes=8).collect()
    tokens = sum(r.n_tokens for r in got if r.held_out)
    # Words of one class alone are one in 800 of them; when the kinds are told apart, one in 400.
    assert sum(r.score for r in got if r.held_out) / tokens > -math.log10(400) - 0.07


def test_word_model_is_a_distribution():
    rng = np.random.default_rng(8)
    size = brown.END_UNIT + 1
    pairs = np.zeros((size, size))
    pairs[-30:, -30:] = rng.integers(0, 9, (30, 30))
    units = brown._model(pairs, np.empty(0, np.uint64), np.zeros((4, size)), int(pairs.sum()), 90, 5)
    start = brown.Start(units.frequent, units.label, 9.0, 0, 5)
    counts, label = rng.integers(1, 9, 90), rng.integers(0, 5, 90)
    table = np.zeros((5, 5))
    table[0] = np.bincount(label, counts, minlength=5)
    shape = np.stack([np.bincount(label[x], minlength=5) for x in (counts > 0, counts == 1, counts == 2)])
    model = brown._word_model(units, start, table, shape)
    known = np.bincount(label, (counts - model.discount[label]) / model.size[label], minlength=5)
    unknown = np.bincount(units.label[: brown.ENDINGS], 10 ** model.unknown[: brown.ENDINGS], minlength=5)
    assert np.allclose(known + unknown, 1) and np.allclose((10**model.transition).sum(1), 1)


def test_scores_with_nothing_to_learn_or_score(spark):
    rows = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    only = brown.score_texts(rows).collect()[0]
    assert (only.n_known, only.train_tokens, only.base_score) == (0, 0, 0.0)
    assert brown.score_texts(rows.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = [levenshtein.Term(t, s, e) for t, s, e in (("abcab", False, 1), ("bacca", False, 2), ("abb", False, 0), ("cab", True, 0))]
    automaton = levenshtein.build(terms)
    words = ["".join(rng.choices("abcx", k=rng.randint(1, 8))) for _ in range(4000)] + ["abcab", "bacca", "abb", "cabxx"]
    flat = np.frombuffer("".join(words).encode(), np.uint8)
    classes = np.array([automaton.letters.get(int(c), 0) for c in flat], np.int16)
    end = np.cumsum([len(w) for w in words])
    state = levenshtein.read(automaton, classes, end - [len(w) for w in words], end)
    for word, kind in zip(words, automaton.kind[state], strict=True):
        near = [edits(word, t.text) for t in terms[:3]]
        exact = 0 in near or word.startswith("cab")
        close = near[0] <= 1 or near[1] <= 2
        assert kind == (levenshtein.EXACT if exact else levenshtein.FUZZY if close else levenshtein.NONE), word
    assert levenshtein.build([]).table.shape == (2, 1)


def toxic_corpus(n):
    rng = random.Random(6)
    common = ["".join(rng.choices("aeioustrnlm", k=rng.randint(3, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(common, k=rng.randint(15, 80)), int(i % 6 == 0)
        for _ in range(toxic * rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numpty", "schwein" + rng.choice(common)]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_learns_terms_and_stems(spark):
    rows, labels = toxic_corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id % 5 <> 0"), marks.where("doc_id % 5 <> 0"))
    found = {(t.text, t.stem) for t in model.terms}
    assert {("blockhead", False), ("numpty", False)} <= found and any(stem and "schwein".startswith(t) for t, stem in found)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    more = spark.createDataFrame([(1, "blokhead blockhaed numpti", 7), (2, None, 7), (3, "", 7)], "doc_id long, text string, score int")
    scores = {r.doc_id: r.score for r in toxicity.score_texts(more, model).collect()}
    assert scores[1] > scores[2] == scores[3] and scores[2] < 0.5
    spelled = {r.term for r in toxicity.matches(more, model).collect() if not r.exact}
    assert spelled == {"blockhead", "numpty"}


def test_quotation_lowers_the_window_score():
    model = toxicity.ToxicityModel([], levenshtein.build([levenshtein.Term("numpty", False, 1)]), toxicity.ASSUMED)
    texts = pa.array(["you numpty", 'they said "you numpty" then', "sie sagten „numpty” dort", "no\nmatch"])
    rows = toxicity._features(texts, model.automaton)
    assert (rows[:, 1] > 0).tolist() == [True, False, False, False] and (rows[:, 2] > 0).tolist() == [False, True, True, False]
    scores = rows @ model.weights
    assert scores[0] > scores[1] == scores[2] > scores[3]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score_texts(docs, model).collect()] == [0]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


SAMPLES = {
    "aa": ["kala mura tani", "mura kala", "tani rumi kala"],
    "bb": ["wöchst zeign grümp", "zeign pfort wöchst", "grümp pfort"],
    "cy": ["привет мир дом", "дом улица мир", "мир привет"],
}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(9)
    rows = [(f"{k}{i}".encode().hex(), " ".join(rng.choices(v, k=4)), k) for k, v in SAMPLES.items() for i in range(40)]
    return langid.train(spark.createDataFrame([*rows, ("x", "kala", None), ("y", None, "aa")], "doc_id string, text string, lang string"))


def test_language_of_texts_and_spans(spark, languages):
    assert languages.languages == ["aa", "bb", "cy"]
    rows = [(1, "mura tani, kala!"), (2, "pfort grümp"), (3, "улица"), (4, None), (5, "12 – 34 !"), (6, "kala mura tani mura. wöchst zeign"), (7, "漢字"), (8, "")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, languages).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8)] == ["aa", "bb", "cy", "und", "und", "aa", "und"]
    assert got[4].score == 0 and got[7].lang_pred in languages.languages and got[1].lang == "kept"
    cut = [(r.first, r.last, r.lang) for r in langid.spans(docs.where("doc_id = 6"), languages).orderBy("first").collect()]
    assert cut == [(0, 19, "aa"), (21, 33, "bb")]
    assert langid.identify(docs.limit(0), languages).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 5, 1])
    scores, prior = rng.normal(size=(9, 3)).astype(np.float32), np.zeros(3, np.float32)
    got = langid._labels(scores, counts, prior, 0.7)
    at = 0
    for n in counts:
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.empty((0, 0), int)
        if n:
            value = [sum(scores[at + i, s] for i, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in paths]
            assert got[at : at + n].tolist() == paths[int(np.argmax(value))].tolist()
        at += n


def test_training_without_rows(spark):
    docs = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, lang string")
    model = langid.train(docs.limit(0))
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()] == [("und", 0.0)]


PAGE = (
    "<html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-bar'>We use cookies</div><!-- x --><div class=ad>Buy</div>"
    "<article><h1>Head &amp; line {0}</h1><p><b>Bold  {0}<br>next<p>Second &eacute;&nbsp;{1}</p><p>Read on in our letter</p>"
    "<aside>side</aside><form><label>Mail</label></form><ul><li>one {0}<li>two {0}</ul><section id=comments><p>Nice post</p></section></article><footer>&copy; x"
)


def test_page_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(f"w{i}", f"v{i}")) for i in range(12)]
    rows += [(50, None, None), (51, "http://b.example/x", ""), (52, "http://b.example/y", "<p>Un<b>closed <i>text"), (53, "bad", "5 < 6 & more")]
    got = {r.page_id: r.text for r in htmlmain.main_text(spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")).collect()}
    for i in range(12):
        assert got[i] == f"Head & line w{i}\n\nBold w{i} next\n\nSecond é v{i}\n\none w{i}\n\ntwo w{i}"
    assert (got[50], got[51], got[52], got[53]) == ("", "", "Unclosed text", "5 < 6 & more")


def test_template_words_share_the_vector_of_their_element(spark):
    rows = [(f"https://a.example/{i}", f"<article><p>fixed words here</p><div>own{i} text{i} more{i}</div></article>") for i in range(10)] + [("https://b.example/", "<p>fixed words here</p>")]
    found = htmlmain.templates(spark.createDataFrame(rows, "url string, html string").select(htmlmain.host_of(F.col("url")).alias("host"), "html").repartition(3)).collect()
    words = {(r.host, r.path): sorted(w.word for w in r.words or []) for r in found}
    fixed = ["fixed", "here", "words"]
    assert words == {("a.example", "/article/p"): fixed, ("a.example", "page"): fixed, ("a.example", "/article/div"): []}
    texts = htmlmain.main_text(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(r.text for r in texts) == sorted([f"own{i} text{i} more{i}" for i in range(10)] + ["fixed words here"])
    assert htmlmain.main_text(spark.createDataFrame([], "url string, html string")).count() == 0
    copies = spark.createDataFrame([(f"https://c.example/{i}", "<article><p>the same page</p></article>") for i in range(20)], "url string, html string")
    assert {r.text for r in htmlmain.main_text(copies).collect()} == {"the same page"}


@pytest.mark.parametrize("wrap", ['<body class="single has-sidebar">', '<body class="comments-open">', '<body><div class="content with-sidebar">', '<body><div class="sidebar">'])
def test_names_of_page_wrappers_exclude_nothing(wrap):
    page = wrap + "<div class=ad>Buy now</div><div class='cookie-bar'>We use them</div><article><p>first part</p><section class='social-science'>second part</section><section id=related-work>third</section>"
    assert [" ".join(b.words) for b in htmlmain.blocks_of(page) if not b.other] == ["first part", "second part", "third"]


def test_templates_hold_on_short_pages_small_hosts_and_beside_copies(spark):
    menu = "".join(f"<div>entry {n} of the menu</div>" for n in ("one", "two", "three", "four"))
    page = lambda i: f"{menu}<p>own{i} text{i}</p>"
    rows = [(f"https://big.example/{i}", page(i)) for i in range(12)] + [(f"https://small.example/{i}", page(i)) for i in range(2)]
    rows += [(f"https://same.example/{i}", page(7)) for i in range(12)]
    got = {r.url: r.text for r in htmlmain.main_text(spark.createDataFrame(rows, "url string, html string").repartition(5)).collect()}
    whole = "\n\n".join([f"entry {n} of the menu" for n in ("one", "two", "three", "four")] + ["own7 text7"])
    for url, text in got.items():
        number = url.rpartition("/")[2]
        assert text == (whole if "same" in url else f"own{number} text{number}")


def test_all_articles_and_main_are_kept_and_links_inside_text():
    page = "<p>out</p><main><h1>Head</h1><p>Lede</p><article><p>one text</p></article><article><p>two</p></article><article><a href=x>more</a></article><article class=teaser>see also</article></main>"
    assert htmlmain._text(page, set()) == "Head\n\nLede\n\none text\n\ntwo"
    long = " ".join(["word"] * 20)
    page = f"<ul><li><a href=/>Home</a></ul><p>{long}</p><p><a href=x>a source</a></p><p>{long}</p><ul><li><a href=/>Top</a></ul>"
    assert htmlmain._text(page, set()) == f"{long}\n\na source\n\n{long}"


def test_folds_follow_the_contract(spark):
    from lorefield.llm.common import held_out

    rows = spark.range(200).select("id", held_out(F.col("id"), 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)
