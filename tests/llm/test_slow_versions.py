"""Parts of the operators against plain slow versions of themselves."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from synodic.llm import quality as q
from synodic.llm.benchmarks import DecontaminationConfig, ItemIndex, contaminated, plain
from synodic.llm.jaccard import ShardIndex
from synodic.llm.language import LanguageConfig, detect, fit_language, kneser_ney, known_language, language
from synodic.llm.licenses import BASE, TEMPLATES, find_licenses
from synodic.llm.pieces import PieceModel, Stretches, Tree, decode_table, encode_table, two_best_of
from synodic.llm.secrets import interval_join
from synodic.llm.toxicity import BoostedTrees, ToxicityConfig, isotonic

from .test_operators import SCHEMA, corpus, docs_of, roots


def test_pairwise_part_of_the_machine():
    """The sum of squares gives what the sum over all pairs of features gives."""
    rng = np.random.default_rng(3)
    machine = q.FactorisationMachine(50, 4)
    machine.w, machine.v, machine.bias = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32), 0.3
    rows = [(rng.choice(50, n, replace=False), rng.normal(size=n).astype(np.float32)) for n in (1, 2, 7, 30)]
    doc = np.repeat(np.arange(4), [len(i) for i, _ in rows])
    got = machine.margins(doc, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), 4)
    for (index, x), margin in zip(rows, got, strict=True):
        slow = machine.bias + sum(float(machine.w[i]) * float(v) for i, v in zip(index, x, strict=True))
        slow += sum(float(machine.v[i] @ machine.v[j]) * float(x[a]) * float(x[b]) for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
        assert abs(slow - margin) < 1e-3


def test_training_follows_the_slope():
    """One step over one batch moves every weight against the slope of the loss, found by differences."""
    rng = np.random.default_rng(5)
    config = q.QualityConfig(epochs=1, rate=1e-3, decay=0.0)
    doc, index = np.repeat(np.arange(6), 3), rng.integers(0, 8, 18)
    value, label = rng.uniform(0.2, 1, 18).astype(np.float32), np.array([0, 1, 1, 0, 1, 0], np.float32)
    before, after = q.FactorisationMachine(8, 2), q.FactorisationMachine(8, 2)
    after.fit(doc, index, value, label, config)

    def loss(w):
        machine = q.FactorisationMachine(8, 2)
        machine.w, machine.bias = w, before.bias
        share = label.mean()
        machine.bias = float(np.log(share / (1 - share)))
        y = machine.margins(doc, index, value, 6)
        return float(np.mean(np.log1p(np.exp(-y)) * label + np.log1p(np.exp(y)) * (1 - label)))

    for i in np.unique(index):
        up, down = before.w.astype(np.float64), before.w.astype(np.float64)
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        assert abs(slope) < 1e-5 or np.sign(after.w[i] - before.w[i]) == -np.sign(slope)


def test_metadata_counts():
    texts = ["some words here", None or "", "x" * 50]
    plain_rows, told = q.features(texts, 64), q.features(texts, 64, [15, 400, 3])
    assert not np.array_equal(plain_rows[1], told[1]) and np.array_equal(q.features(texts, 64, [15, 0, 50])[1], plain_rows[1])


@pytest.mark.parametrize("reach", [None, 0, 7])
def test_interval_join(reach):
    rng = random.Random(4)
    for _ in range(200):
        scopes = [0, *sorted(rng.sample(range(1, 100), rng.randint(0, 4)))]

        def spans(n, scopes=scopes):
            out = []
            for _ in range(n):
                s = rng.randrange(100)
                end = min([b for b in scopes if b > s], default=120)
                out.append(("k", s, min(s + rng.randint(1, 9), end)))
            return sorted(out, key=lambda x: x[1])

        left, right = spans(rng.randint(0, 6)), spans(rng.randint(0, 6))
        scope = lambda s: sum(b <= s for b in scopes)  # noqa: B023, E731
        far = math.inf if reach is None else reach
        slow = {i for i, (_, s, e) in enumerate(left) if any(scope(s) == scope(a) and (s <= a <= e + far or a < s and b >= s - far) for _, a, b in right)}
        assert interval_join(left, right, reach, scopes) == slow


def test_query_path_of_pieces(spark):
    model, texts = PieceModel.load(), ["", "plain words here", "Übergrößenträger, 12.5% off!", "a  b\n\tc ▁ x", "日本語のテキスト", *corpus(6, 4)[:6]]
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in encode_table(docs, digest=False).collect()}
    for k, t in enumerate(texts):
        slow = model.nbest("▁" + t.replace(" ", "▁"), 2) if t and "▁" not in t else None
        got = rows[k]
        assert got.n_tokens == len(got.ids) and model.decode(got.ids) == t
        if slow:
            assert np.isclose(-got.best_score, slow[0][0]) and (got.next_score is None) == (len(slow) < 2)
            if len(slow) == 2:
                assert np.isclose(-got.next_score, slow[1][0]) and model.decode(got.next_ids) == t and got.next_ids != got.ids
        both = model.encode(t, 2)
        assert np.isclose(got.best_score, both[0][0]) and (got.next_score is None) == (len(both) < 2)
    back = decode_table(encode_table(docs, digest=False)).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
    assert all(PieceModel.load().decode(r.next_ids) == texts[r.doc_id] for r in back if r.next_ids is not None)


def test_divide_skip_against_all_sets():
    """Every probe finds what a comparison with every set finds, with few pops and probes where lists are long."""
    rng = np.random.default_rng(7)
    for common in (0, 30):
        base = [np.unique(rng.integers(100, 5000, rng.integers(5, 60))) for _ in range(40)]
        sets = []
        for b in base:
            for _ in range(3):
                own = b.copy()
                own[rng.integers(0, len(own), rng.integers(0, 4))] = rng.integers(5000, 9000)
                sets.append(np.unique(np.concatenate((own, np.arange(common)))).astype(np.uint64))
        index = ShardIndex.build(list(range(len(sets))), sets, 80, 0.05)
        for s in sets:
            slow = [k for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))]
            assert sorted(index.search(s)) == slow
        postings = sum(map(len, sets))
        assert 0 < index.pops < len(sets) * postings / 4
        if common:
            assert index.probes > 0 and index.pops < len(sets) * len(sets) * common


def test_shards_tell_a_forest():
    one = np.arange(20, dtype=np.uint64)
    index = ShardIndex.build(list(range(50)), [one] * 50, 80, 0.05)
    assert sum(len(index.links(k, one)) for k in range(50)) == 49


def test_common_lines_emit_few_rows(spark):
    """Documents of ten out of sixty common lines, none of which link: no links come out, by whatever way."""
    from synodic.llm.jaccard import JaccardConfig, jaccard_links

    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(60)]
    texts = [" ".join(rng.sample(lines, 10)) for _ in range(300)]
    _, sizes, links = jaccard_links(docs_of(spark, texts), JaccardConfig(crowd=8, shard=100))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    slow = {(i, j) for j in range(300) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} <= slow and sizes.count() == 300


def test_crowds_send_few_sets(spark, monkeypatch):
    """Texts of two to 45 out of sixty common lines: sets go only to shards that could hold a link, and none is lost."""
    from synodic.llm import jaccard

    rng = random.Random(8)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(60)]
    texts = [rng.sample(lines, rng.choice([2, 5, 12, 20, 30, 45])) for _ in range(300)]
    texts = [" ".join(t) for t in texts] + [" ".join(t[1:]) for t in texts[:60]]
    sent, real = [], jaccard.answered

    def counted(routes, *rest):
        sent.append(routes.filter("kind = 1").count())
        return real(routes, *rest)

    monkeypatch.setattr(jaccard, "answered", counted)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 8), "doc_id long, text string")
    rows = jaccard.jaccard_join(docs, jaccard.JaccardConfig(hot=4, crowd=4, shard=20)).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    slow = [(j, i) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(slow) > 20 and [r[2] for r in sorted(rows)] == roots(len(texts), slow)
    assert sum(sent) <= len(texts) // 2


def slow_bm25(index, stats_terms, own, threshold):
    total = Counter()
    for t in own:
        for item, score in zip(index.items[t].tolist(), index.scores[t].tolist(), strict=True):
            total[item] += score
    return {k: v for k, v in total.items() if v >= threshold}


def test_wand_against_exhaustive_scores():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(3, 40)))) for k in range(90)]
    for config in (DecontaminationConfig(), DecontaminationConfig(block=2, range=1), DecontaminationConfig(block=3, range=5, share=0.3)):
        index = ItemIndex.build(items, config)
        for _ in range(60):
            own = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 30)))
            got = dict(index.wand(own, config.share))
            slow = slow_bm25(index, None, own, config.share)
            assert got.keys() == slow.keys() and all(abs(got[k] - slow[k]) < 1e-9 for k in got)


def test_passages_against_exhaustive_scores():
    """The bounds over ranges pass no passage over that reaches the threshold with some item."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(150)]
    weights = [1 / (k + 2) for k in range(150)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(8, 70)))) for k in range(50)]
    config = DecontaminationConfig(share=0.45, window=16, stride=8)
    index = ItemIndex.build(items, config)
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 200))) + " " + rng.choice(items)[1] for _ in range(40)] + ["", "w1"]
    hashes, counts = plain(texts)
    got = index.passages(hashes, counts, config)
    slow, cuts = {}, np.concatenate(([0], np.cumsum(counts)))
    for k in range(len(texts)):
        own = hashes[cuts[k] : cuts[k + 1]]
        for start in range(0, max(len(own), 1), config.stride):
            known = [int(np.searchsorted(index.terms, h)) for h in np.unique(own[start : start + config.window]) if h in index.terms]
            for part, score in slow_bm25(index, None, known, config.share).items():
                key = (k, int(index.owner[part]))
                slow[key] = max(score, slow.get(key, 0.0))
    assert got.keys() == slow.keys() and all(abs(got[k] - slow[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("size", [5, 64, 127, 128, 500, 5000])
def test_items_of_any_length(spark, size):
    rng = random.Random(size)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 3) for k in range(3000)], k=n))
    item = text(size)
    items = spark.createDataFrame([(1, item), *[(k, text(40)) for k in range(2, 30)]], "item_id long, text string")
    docs = docs_of(spark, [item + " " + text(90), text(90) + " " + item, text(300)])
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(0, 1), (1, 1)}


def test_trees_against_slow_splits():
    """The first split of the first tree is the best of all cuts; trees of a step function fit it."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = (x[:, 1] >= 3).astype(float)
    config = ToxicityConfig(trees=1, depth=1)
    model = BoostedTrees().fit(x, y, config)
    p = y.mean()
    best = max(((sum_l := (y - p)[x[:, j] <= c].sum()) ** 2 / ((x[:, j] <= c).sum() * p * (1 - p) + 1) + sum_l**2 / ((x[:, j] > c).sum() * p * (1 - p) + 1), j, c) for j in range(3) for c in range(5))
    (feature, cut), = model.trees[0][0]
    assert best[1] == int(feature[0]) == 1
    left = model.binned(x)[:, 1] <= cut[0]
    assert np.array_equal(left, x[:, 1] <= best[2])
    full = BoostedTrees().fit(x, y, ToxicityConfig(trees=60, depth=2))
    assert np.array_equal(full.margins(x) > 0, y == 1)


def test_isotonic_against_slow_fit():
    """Pooled means equal the least-squares fit by minimum over maximum of averages."""
    rng = np.random.default_rng(8)
    score = rng.permutation(40).astype(float)
    label = (rng.random(40) < score / 40).astype(float)
    y = label[np.argsort(score)]
    slow = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    at, value = isotonic(score, label)
    assert (np.diff(value) >= 0).all()
    got = np.interp(np.sort(score), at, value)
    assert np.abs(got - slow).max() < 0.05  # up to the pseudo-counts


def slow_licenses(texts):
    import re

    out = []
    for t in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        out.append((len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    return out


def test_license_base_and_paragraphs(spark):
    rng = random.Random(1)
    pieces = ["CC BY", "cc-by", "General  Public License", "ALL rights\nreserved", "all rights", "é", "public license", "x1", "—", "cc", "by"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    rows = {r.doc_id: r for r in find_licenses(docs_of(spark, texts)).collect()}
    assert [tuple(rows[k])[1:6] for k in range(len(texts))] == slow_licenses(texts)
    # every paragraph is found, alone and among all others
    alone = [f"Copyright (c) 2020 Somebody. {text}." for text, _ in TEMPLATES.values()]
    every = docs_of(spark, [*alone, "\n\n".join(alone), *["plain words of a text"] * 30])
    rows = {r.doc_id: r for r in find_licenses(every).collect()}
    names = [n.split("#")[0] for n in TEMPLATES]
    assert all(n in rows[k].labels.split(",") for k, n in enumerate(names)) and set(names) <= set(rows[len(names)].labels.split(","))
    assert rows[len(names) + 1].labels == ""


def test_kneser_ney_against_slow_probabilities():
    texts = {"a": ["  abcab", "  bcab"], "b": ["  xyxx"]}
    order, discount = 3, 0.75
    counts = {k: Counter(t[i : i + order] for t in v for i in range(len(t) - order + 1)) for k, v in texts.items()}
    model = kneser_ney(counts, order, discount)
    signs = {g for c in counts.values() for g in c}
    alphabet = len({g[-1] for g in signs}) + 1

    def slow(name, gram):
        if not gram:
            return 1 / alphabet
        grams = counts[name]
        for _ in range(order - len(gram)):
            grams = Counter(g[1:] for g in grams)
        total = sum(c for g, c in grams.items() if g[:-1] == gram[:-1])
        below = slow(name, gram[1:])
        if not total:
            return below
        kinds = sum(g[:-1] == gram[:-1] for g in grams)
        return max(grams.get(gram, 0) - discount, 0) / total + discount * kinds / total * below

    text = "  abcxaby"
    code = np.array([ord(c) for c in text], dtype=np.uint32)
    logs = model.logs(code)
    for i in range(order - 1, len(text)):
        for k, name in enumerate(model.names):
            assert abs(float(logs[i, k]) - math.log(slow(name, text[i - order + 1 : i + 1]))) < 1e-4


def test_rejection_rate_and_columns(spark):
    """Of clean held-out documents at most one in two hundred is rejected; the caller's columns stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out and lang is not null and n_chars >= 20").collect()
    assert len(rows) > 200 and sum(r.rejected for r in rows) <= len(rows) / 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    own = docs_of(spark, ["the words of a text", None, "ok then"]).withColumnRenamed("a", "lang_pred")
    models = fit_language(docs)
    kept = known_language(own, models).collect()
    assert all(r.score == 0.5 and r.lang_pred == "x" for r in kept) and None not in {r.text for r in kept}
    with pytest.raises(ValueError):
        detect(own, models)


def test_many_languages(spark):
    rows = [(k, "some text of letters", f"l{k}", "s", 1, 0.5, "x") for k in range(300)] + [(1000 + k, "other words here", "en", "s", 1, 0.5, "x") for k in range(40)]
    got = language(spark.createDataFrame(rows, SCHEMA), LanguageConfig(max_languages=5)).collect()
    assert len(got) == 340 and len({r.lang_pred for r in got}) <= 5


def test_nbest_of_stretches():
    """Stretches of several segments merge to the n best of the whole."""
    rng = random.Random(9)
    names = [*"abc,", "ab", "bc", "abc", "▁", "▁a", "▁ab"]
    own = {n: (k, -rng.random() * 9) for k, n in enumerate(names)}
    model = PieceModel.build(own, [*names, *[f"<0x{b:02X}>" for b in range(256)]], list(range(len(names), len(names) + 256)))
    for _ in range(40):
        text = "".join(rng.choice("abc, ") for _ in range(rng.randint(1, 9)))
        whole = model.nbest("▁" + text.replace(" ", "▁"), 3)
        assert np.allclose([c for c, _ in whole], [-x for x, _ in model.encode(text, 3)])


@pytest.mark.parametrize("ties", [False, True])
def test_many_segments_at_once(ties):
    """The search of many segments gives what the search of each gives, ties and signs without a piece included."""
    rng = random.Random(4)
    names = [*"abcé", "ab", "bc", "abc", "cab", "bcab", "aa", "▁", "▁a", "▁ab"]
    own = {n: (k, -rng.choice((1.0, 2.0)) if ties else -rng.random() * 9) for k, n in enumerate(names)}
    model = PieceModel.build(own, [*names, *[f"<0x{b:02X}>" for b in range(256)]], list(range(len(names), len(names) + 256)))
    words = list({"".join(rng.choice("abc▁éx日😀") for _ in range(rng.randint(1, 20))) for _ in range(200)})
    costs, n1, ids1, others, n2, ids2 = two_best_of(model, Tree(model.root), words)
    for k, w in enumerate(words):
        (cost, ids), *rest = model.two_best(w)
        assert (costs[k], tuple(ids1[n1[:k].sum() : n1[: k + 1].sum()].tolist())) == (cost, ids)
        assert (others[k], tuple(ids2[n2[:k].sum() : n2[: k + 1].sum()].tolist())) == (rest[0] if rest else (float("inf"), ()))


def test_all_n_segmentations_of_a_table(spark):
    texts = ["", "plain words here", "Übergrößenträger, 12.5% off!", "a  b\n\tc ▁ x", "日本語のテキスト", "x" * 300]
    model, rows = PieceModel.load(), {}
    for digest in (False, True):
        rows[digest] = {r.doc_id: r for r in encode_table(docs_of(spark, texts), n=5, digest=digest).collect()}
    for k, t in enumerate(texts):
        got, slow = rows[False][k], model.encode(t, 5)
        found = [(got.best_score, got.ids), *([(got.next_score, got.next_ids)] if got.next_ids is not None else []), *[(o.score, o.ids) for o in got.others]]
        assert len(found) == len(slow) and np.allclose([s for s, _ in found], [s for s, _ in slow]) and len({tuple(i) for _, i in found}) == len(found)
        assert got.round_trip and all(model.decode(ids) == t for _, ids in found)
        assert [o.score for o in rows[True][k].others] == [o.score for o in got.others] and all(len(o.ids) == 64 for o in rows[True][k].others)


def test_round_trip_decodes_both_segmentations():
    """A second segmentation that does not give the text back is told."""
    model = PieceModel.load()
    store = Stretches(model)
    assert store.encoded(["plain words here"])[4] == [True]
    at = store.starts[1].held[store.known["▁words"]]
    store.ids.held[at] = (store.ids.held[at] + 1) % len(model.texts)
    for w in ("▁plain", "▁here"):
        store.loss.held[store.known[w]] = float("inf")
    assert store.encoded(["plain words here"])[4] == [False]


def test_generations_are_bounded():
    model = PieceModel.load()
    model.generation = 10
    text = " ".join(f"word{k}" for k in range(200))
    once = model.encode(text, 2)
    assert once == model.encode(text, 2) and all(len(v) <= 10 and len(v.old) <= 10 for v in model.caches.values())


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components(spark, few):
    from synodic.llm.components import components

    from .test_operators import roots

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(300 + k, 301 + k) for k in range(60)]
    slow = roots(400, links)
    edges = spark.createDataFrame([*links, *links[:20], (5, None), (None, None)], "a long, b long")
    got = {r.node: r.component for r in components(edges, few).collect()}
    assert got == {x: slow[x] for pair in links if pair[0] != pair[1] for x in pair}
