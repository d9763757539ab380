import random
import zlib

import numpy as np

from tessella.llm import toxicity
from tessella.llm.toxicity import SubwordSoftmax, fit_toxicity, score_toxicity

CLEAN = ["river", "stone", "meadow", "walked", "under", "bright", "morning", "little", "garden", "house", "seven", "window"]
STEMS = ["zorgle", "blixum", "frabbo"]


def corpus(rng, n, share=0.3):
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < share
        for _ in range(1 + len(words) // 50 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(STEMS) + "".join(rng.choice("aeiounrt") for _ in range(rng.randrange(4)))
        out.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return out


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus(random.Random(2), 1500)
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, x, None) for i, _, x in rows if i % 3], "doc_id long, toxic int, text string")
    model = fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    fresh = [(i, x) for i, _, x in rows if got[i].held_out or i % 3 == 0]
    assert np.mean([got[i].predicted == x for i, x in fresh]) > 0.97
    long = " ".join(random.Random(4).choice(CLEAN) for _ in range(5000))
    assert model.score(np.array([model.margin(long + " zorgleqq " + long)]))[0] > 0.5 > model.score(np.array([model.margin(long)]))[0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (2, ""), (3, "x" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = score_toxicity(docs, fit_toxicity(docs, none)).collect()
    assert len(out) == 5 and all(r.score is not None and np.isfinite(r.score) for r in out)
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 7), (1, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in score_toxicity(docs, fit_toxicity(docs, one)).collect())
    assert score_toxicity(docs.limit(0), SubwordSoftmax()).count() == 0


def test_scores_do_not_depend_on_how_a_text_is_read(monkeypatch):
    model = SubwordSoftmax()
    model.weight = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    text = " ".join(random.Random(5).choice(CLEAN) + random.Random(i).choice([",", ".", "", "'s"]) for i in range(400))
    words = [np.frombuffer(model.words(w), np.float32)[0] for w in toxicity._WORD.findall(text.lower())]
    want = max(a + b for a, b in zip(words, words[1:])) / 2
    monkeypatch.setattr(toxicity, "segments", lambda t: [t[:1000], t[1000:]] if t[1000] == " " else [t])
    assert abs(model.margin(text) - want) < 1e-5
