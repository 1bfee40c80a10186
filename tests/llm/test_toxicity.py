import random

import pytest
from pyspark.sql import functions as F

from gatehouse.llm import toxicity
from gatehouse.llm.toxicity import Matcher, Trie, edits_for, features

SCHEMA = "doc_id long, text string, lang string, score double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = ["moron", "worthless", "idiot", "trash", "scum", "disgusting", "ab"]
    trie = Trie([(t, False) for t in terms])
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "a", "o", "st"])
        word = "".join(word)
        best = min(((distance(word, t), t) for t in terms if word[:1] == t[0] and (word == t or (len(word) >= 4 and distance(word, t) <= min(edits_for(len(t)), edits_for(len(word) + 1))))), default=None)
        assert trie.match(word) == (best and (best[1], best[0])), word


def test_stems_and_first_letters_equal_prefix_edit_distance():
    rng = random.Random(4)
    terms = [("moron", False), ("worthles", True), ("worthlessness", False), ("idiot", True), ("tra", True), ("achlich", True), ("réeux", True), ("scum", False)]
    trie, weights = Trie(terms, any_first=True), {t: k + 1.0 for k, (t, _) in enumerate(terms)}
    matcher = Matcher([(t, stem, weights[t]) for t, stem in terms])
    for _ in range(6000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "a", "o", "st"])
        word = "".join(word) + rng.choice(["", "", "en", "haft" * 3, "x" * 70])
        exact = [t for t, stem in terms if word == t or (stem and word.startswith(t))]
        near = []
        for t, stem in terms:
            away = min(distance(word[:p], t) for p in range(min(len(word), len(t) + 3) + 1)) if stem else distance(word, t)
            if len(word) >= 4 and away <= min(edits_for(len(t)), edits_for(len(word) + 1)):
                near.append((away, t))
        wanted = (max(exact, key=len), 0) if exact else min(near)[::-1] if near else None
        assert trie.match(word) == wanted, word
        assert matcher[word] == (wanted and (weights[wanted[0]], wanted[1])), word


def test_misspellings_never_speak_for_a_text():
    assert toxicity._weights([(1.0, 0.0, 20, 1)] * 9 + [(0.0, 1.0, 20, 0)] * 9 + [(0.0, 0.0, 20, 0)] * 9)[1] >= 0
    assert toxicity._weights([(0.0, 0.0, 20, 1)] * 9 + [(1.0, 1.0, 20, 0)] * 9)[1] >= 0
    near = Matcher([("idiot", False, 1.0, 0.0)])
    assert features("an idiott here", near) == (0.0, 0.0, 3, 0, 0, 0)
    assert features("an idiott idiot", near)[0] == features("an other idiot", near)[0]
    ordinary = Matcher([("idiot", False, 1.0)], frozenset(["idiott"]))
    assert features("an idiott and idioth", ordinary)[1:5] == (0.5, 4, 0, 1)


def plain_features(text, terms, ordinary):
    """features by distances to every term, word by word."""
    words = toxicity.WORDS.findall(text.lower())
    hits = {}
    for i, word in enumerate(words):
        exact = max((t for t, stem, *_ in terms if word == t or (stem and word.startswith(t))), key=len, default=None)
        near = []
        for t, stem, *_ in terms:
            away = min(distance(word[:p], t) for p in range(len(word) + 1)) if stem else distance(word, t)
            if len(word) >= 4 and away <= min(edits_for(len(t)), edits_for(len(word) + 1)):
                near.append((away, t))
        of = {t: (w, *more, w)[:2] for t, _, w, *more in terms}
        if exact:
            hits[i] = (of[exact][0], 0)
        elif near and word not in ordinary and of[min(near)[1]][1]:
            hits[i] = (of[min(near)[1]][1], min(near)[0])
    quoted = toxicity._quoted(text.lower(), list(hits))
    score = [0.0, 0.0]
    for i, (w, e) in hits.items():
        others = sum(j != i and j not in quoted and abs(i - j) <= toxicity.WINDOW for j in hits)
        score[e > 0] += w * (0.25 if i in quoted else 1 + 0.5 * min(2, others)) / (1 + e)
    return (*score, len(words), sum(not e for _, e in hits.values()), sum(e > 0 for _, e in hits.values()), len(quoted))


def test_features_equal_a_plain_version():
    rng = random.Random(8)
    terms = [("moron", False, 1.0), ("worthless", False, 0.8), ("idiot", False, 0.9, 0.0), ("achlich", True, 0.5), ("scum", False, 1.0)]
    ordinary = frozenset(["morons"])
    pool = ["moron", "morons", "mroon", "worthles", "worthless", "idiott", "idiot", "achlichkeit", "schlich", "scun", "scum", "a", "the", "other", "words", "und"]
    matcher = Matcher(terms, ordinary)
    for _ in range(400):
        words = [rng.choice(pool) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(['"', "„", "“", "”"]))
        text = " ".join(words).replace('" ', '"')
        assert features(text, matcher) == pytest.approx(plain_features(text, terms, ordinary)), text


def test_misspellings_and_quotations_move_scores_of_a_fitted_model(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    matcher = model.matcher()
    score = lambda text: model.score(*features(text, matcher)[:3])
    assert score("you are worthles to us") > score("you are precious to us")
    assert score("you are worthless to us") > score("you are worthles to us")
    assert score("you are a stupid worthles idiott") > 0.5 > score("you are a clever precious friend")
    assert score('they wrote "you worthless moron" to us') < score("they wrote you worthless moron to us")
    known = docs.join(labels.where("toxic = 0 and doc_id is not null"), "doc_id", "left_semi").where(~toxicity.held_out(F.col("doc_id")))
    # Ordinary words that clean texts of the sample hold aren't taken for misspellings.
    assert toxicity.scored(known, model).where("n_misspelled > 0").count() <= 0.01 * known.count()
    held = toxicity.scored(docs, model).join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    wrong = sum((r.score >= 0.5) != bool(r.toxic) for r in held)
    assert len(held) > 500 and wrong <= 0.012 * len(held)
    print("held out", len(held), "wrong", wrong, "moved by misspellings", sum(r.n_misspelled > 0 for r in held))


def test_stems_windows_and_quotation():
    matcher = Matcher([("idiot", False, 1.0), ("lowei", True, 0.5)])
    assert features("Du loweischaft!", matcher)[2:] == (2, 1, 0, 0)
    assert features("an idiott here", matcher)[2:] == (3, 0, 1, 0)
    plain, quoted = features("he is an idiot so", matcher), features('he wrote "an idiot" so', matcher)
    assert quoted[5] == 1 and quoted[0] < plain[0]
    assert features("idiot idiot", matcher)[0] > 2 * plain[0]
    assert features("", matcher) == (0.0, 0.0, 0, 0, 0, 0)
    # An apostrophe is no quotation mark, nor is a place between two quotations quoted.
    assert features("you’re an idiot, don’t", matcher)[:2] == features("youre an idiot, don", matcher)[:2]
    assert features('"yes" idiot "no"', matcher)[5] == features("“yes” idiot “no”", matcher)[5] == 0
    assert [features(t, matcher)[5] for t in ("er sagte „du idiot“", "«idiot»", "»idiot«", "‘idiot’", "“an idiot’s idiot”", '"idiot')] == [1, 1, 1, 1, 2, 0]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows, labels = [], {}
    for d in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))]
        labels[d] = int(d % 6 == 0)
        if labels[d]:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "worthless", "qvex" + rng.choice(vocabulary)]))
        rows.append((d, " ".join(words), "en", 0.5))
    rows += [(1000, None, "en", 0.5), (1001, "", "en", 0.5), (1002, "idiot " * 30000, "en", 0.5), (None, "x", None, None), (1003, "you are a worthles idiot, idoit", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame([(d, 1, t) for d, t in labels.items()] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"idiot", "worthless", "qvex"} <= {t[0] for t in model.terms}
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows)
    assert all((got[d].score >= 0.5) == bool(t) for d, t in labels.items())
    assert got[1000].score == got[1001].score < 0.5 < got[1002].score
    assert got[1003].score >= 0.5 and got[1003].n_misspelled >= 1
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {d for d, t in labels.items() if not t} | {1000, 1001, None}
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, marks.limit(0)).score(5.0, 5.0, 9) < 0.5
