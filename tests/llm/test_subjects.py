import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm.subjects import Settings, areas, assign, composition, fit, lines_of, train

WORDS = {"law": ["court", "judge", "verdict", "trial", "jury", "bail"], "sport": ["match", "goal", "keeper", "team", "race", "cup"], "farming": ["cow", "wheat", "harvest", "barn", "plough", "milk"]}
COMMON = ["the", "was", "and", "of", "weather", "road", "town", "people", "monday", "said"]
FRENCH = {"le": "the", "etait": "was"}


def article(rng, subject, n):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS[subject]) if rng.random() < 0.35 else rng.choice(COMMON) for _ in range(8)))
    return out


def pages(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        k = rng.choice([0, 1, 1, 1, 2])
        subjects = rng.sample(sorted(WORDS), k)
        lines = [line for s in subjects for line in article(rng, s, 12)] + [" ".join(rng.choice(COMMON) for _ in range(8)) for _ in range(4)]
        other = rng.choice(sorted(WORDS))
        lines.insert(rng.randrange(len(lines)), f"the {rng.choice(WORDS[other])} of monday")  # something else in passing
        texts.append("\n".join(lines))
        labels.append({s: 1.0 for s in subjects})
    return texts, labels


def test_lines():
    assert lines_of("A libre- \ntto 0f\r\n\n77\nc0urt") == [["a", "libretto", "of"], ["court"]]
    assert lines_of(None) == [] and lines_of("") == [] and lines_of(" \n ") == []


def test_held_out_accuracy():
    c = fit(*(lambda t, v: (t, ["en"] * len(t), v))(*pages(1, 300)), sorted(WORDS))
    texts, votes = pages(2, 200)
    got = c.accepted(texts)
    want = np.array([[s in v for s in sorted(WORDS)] for v in votes])
    assert (got & want).sum() / got.sum() > 0.95 and (got & want).sum() / want.sum() > 0.95


def test_blank_null_and_long_texts():
    texts, votes = pages(1, 120)
    c = fit(texts, ["en"] * len(texts), votes, sorted(WORDS))
    rng = random.Random(9)
    long = "\n".join(article(rng, "law", 20_000))
    got = c.accepted([None, "", " \n\t", "12 34", long])
    assert not got[:3].any() and got[4].tolist() == [False, True, False]
    assert c.accepted([]).shape == (0, 3)


def filler(rng, n):
    return [" ".join(rng.choice(COMMON) for _ in range(8)) for _ in range(n)]


def test_length_of_a_page_and_place_of_an_article(spark):
    texts, votes = pages(1, 300)
    c = fit(texts, ["en"] * len(texts), votes, sorted(WORDS))
    rng = random.Random(3)
    for seed in range(5):
        law = article(random.Random(seed), "law", 12)
        rest = filler(rng, 2000)
        for at in (0, 700, 1988, 2000):  # in 2000 lines on nothing, at the beginning, inside and at the end
            assert c.accepted(["\n".join(rest[:at] + law + rest[at:])])[0].tolist() == [False, True, False], at
        near = [c.probabilities(["\n".join(law + rest[: n - 12])])[0] for n in range(140, 165)]
        assert max(np.abs(a - b).max() for a, b in zip(near, near[1:], strict=False)) < 0.02  # no jump at any length
        assert (c.accepted(["\n".join(rest)]) | c.accepted(["\n".join(rest[:100])])).sum() == 0


def test_page_that_changes_its_language():
    texts, votes = pages(1, 200)
    other = str.maketrans("aeiou", "eioua")
    c = fit(texts + [t.translate(other) for t in texts], ["en"] * len(texts) + ["de"] * len(texts), votes * 2, sorted(WORDS))
    law, farm = (article(random.Random(4), s, 30) for s in ("law", "farming"))
    assert c.accepted(["\n".join(farm), "\n".join(law).translate(other), "\n".join(farm) + "\n" + "\n".join(law).translate(other)]).tolist() == [[True, False, False], [False, True, False], [True, True, False]]


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_labels(spark):
    """Trained on two thirds of the labelled pages, on those of the others whose annotators agree."""
    given = defaultdict(lambda: defaultdict(set))
    for r in spark.read.parquet(f"{DATA}/subject_labels.parquet").collect():
        given[r.doc_id][r.annotator] |= {r.subject} - {None}
    docs = sorted(map(tuple, spark.read.parquet(f"{DATA}/documents.parquet").where("trim(text) <> ''").select("doc_id", "text", "lang").collect()))
    docs = [x for x in docs if x[0] in given]
    votes = [{s: n / len(given[i]) for s, n in Counter(s for a in given[i].values() for s in a).items()} for i, _, _ in docs]
    names = sorted({s for v in votes for s in v})
    train_at = [i for i in range(len(docs)) if i % 3]
    c = fit([docs[i][1] for i in train_at], [docs[i][2] for i in train_at], [votes[i] for i in train_at], names)
    agreed = [i for i in range(0, len(docs), 3) if len(given[docs[i][0]]) > 1 and len(set(map(frozenset, given[docs[i][0]].values()))) == 1]
    got = c.accepted([docs[i][1] for i in agreed])
    want = np.array([[s in votes[i] for s in names] for i in agreed])
    assert len(agreed) > 30 and (got & want).sum() / want.sum() >= 0.95 and (got & want).sum() / got.sum() >= 0.95


def test_frames(spark):
    texts, votes = pages(4, 150)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(1000, None, None, 1), (1001, "", "en", 1)], "doc_id bigint, text string, lang string, subject int")
    labels = spark.createDataFrame([(i, s, a) for i, v in enumerate(votes) for s in (v or {None: 1}) for a in (1, 2)] + [(1000, "law", 1), (5000, "law", 1)], "doc_id bigint, subject string, annotator int")
    subjects = spark.createDataFrame([(s, "x") for s in WORDS] + [("law", "x"), (None, "x")], "subject string, about string")
    c = train(docs, labels, subjects, Settings(pages=120))
    found = assign(docs, c)
    assert found.columns == ["doc_id", "subject"] and {r.subject for r in found.collect()} == set(WORDS)
    assert found.where("doc_id >= 1000").count() == 0
    total = {r.subject: r.pages for r in composition(areas(docs, c)).collect()}
    assert total[None] >= 2 and sum(v for k, v in total.items() if k) == found.count()
    assert assign(docs.where("false"), c).count() == 0
    none = train(docs, labels.where("false"), subjects)
    assert assign(docs, none).count() == 0
