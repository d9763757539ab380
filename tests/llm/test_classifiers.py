import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.langid import TrigramBayes, fit_language_model, identify_languages, keep_identified, pages_evidence
from tessella.llm.quality import STATISTICS, BoostedTrees, fit_quality, score_quality, statistics

SF = "/root/testdata/sf0.01"


def naive_score(model, row):
    out = model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        out += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-out))


def test_trees_learn_an_interaction_and_score_like_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(int)
    model = BoostedTrees(trees=30).fit(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert np.mean((score >= 0.5) == y[2000:]) > 0.97
    assert np.allclose(score[:50], [naive_score(model, r) for r in x[2000:2050]])
    assert np.allclose(BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).score(x[:3]), 0.5)
    assert BoostedTrees().score(np.zeros((0, 4))).shape == (0,)


def test_statistics_of_edge_texts(monkeypatch):
    for t in (None, "", " \n", "a", "é" * 10, "|" * 200_000):
        row = statistics(t)
        assert len(row) == len(STATISTICS) and np.isfinite(row).all()
    from tessella.llm import quality

    text = "One two two THREE | four.\nfive, six! six\nfive, six! six\n" * 40
    whole = statistics(text)
    monkeypatch.setattr(quality, "segments", lambda t: [t[:500], t[500:]] if t[500].isspace() else [t[: t.index(" ", 500)], t[t.index(" ", 500) :]])
    part = statistics(text)
    assert np.allclose(whole, part)
    monkeypatch.setattr(quality, "LINE", 7)
    assert np.allclose(whole, statistics(text))


def test_a_line_of_any_length_is_one_line():
    lines = STATISTICS.index("log_lines"), STATISTICS.index("distinct_lines")
    long = "word another " * 270_000
    for text, n, distinct in ((long, 1, 1), (long + "\n" + long, 2, 1), (long + "x\n\n" + long, 2, 2), ("a\nb\na\n", 3, 2)):
        row = statistics(text)
        assert np.isclose(row[lines[0]], np.log1p(n)) and np.isclose(row[lines[1]], distinct / n)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    words = ["river", "stone", "meadow", "walked", "under", "bright", "morning"]
    rows = []
    for i in range(1200):
        good = rng.random() < 0.7
        own = [rng.choice(words) for _ in range(rng.randint(8, 150))]
        text = " ".join(own).capitalize() + "." if good else rng.choice([" | ".join(own), " ".join([own[0]] * len(own)), " ".join(own).upper() + "!!"])
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _ in held) and np.mean([out[i].predicted == q for i, q in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in out.values())
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert score_quality(odd, fit_quality(docs, labels.limit(0))).count() == 3
    assert score_quality(odd.limit(0), BoostedTrees()).count() == 0


EN = "the of and to in that was with for this from have not are which you one were all there".split()
DE = "der die und das ist nicht ein eine mit von auf für werden sich auch nach wird einer über durch".split()


def lines(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_fusion(spark):
    rng = random.Random(3)
    rows = [(i, lines(rng, (EN, DE)[i % 2], rng.randint(5, 60)), ("en", "de")[i % 2], f"{('en', 'de')[i % 2]}.host{i % 5}.example.com", None) for i in range(400)]
    schema = "doc_id long, text string, lang string, source string, out_id string"
    docs = spark.createDataFrame(rows, schema)
    model = fit_language_model(docs)
    assert model.languages == ["de", "en", "und"]
    got = {r.doc_id: r for r in identify_languages(docs, model, host_col="source").collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, *_ in rows)

    extra = spark.createDataFrame(
        [(1000, None, None, "de.host1.example.com", "x"), (1001, "漢字 かな 漢字 кириллица текст", None, None, None), (1002, "", None, None, None), (None, "zxqj wvkq xxzq qqzx", "en", "new.example.org", None), (1003, lines(rng, DE, 20_000), None, "", None), (1003, lines(rng, EN, 8), None, "x.de", None)],
        schema,
    )
    both = docs.union(extra)
    out = identify_languages(both, model, host_col="source").where("doc_id >= 1000 or doc_id is null").collect()
    by = {(r.doc_id, r.n_words > 100): r for r in out}
    assert by[1000, False].language == "de" and by[1000, False].text_language == "und"  # the host decides
    assert by[1001, False].language == "und" and not by[1001, False].accepted
    assert by[None, False].language == "und"
    assert by[1003, True].language == "de" and by[1003, False].language == "en"
    assert identify_languages(both, model, host_col="source").count() == 406
    kept = keep_identified(both, model, host_col="source")
    assert kept.columns == docs.columns and kept.where("doc_id = 1001 or doc_id is null").count() == 0 and kept.where("doc_id < 400").count() == 400
    assert identify_languages(docs.limit(0), model, host_col="source").count() == 0
    assert not any(r.accepted for r in identify_languages(docs, TrigramBayes()).collect())


def test_host_prior_is_smoothed_and_leaves_the_document_out(spark):
    """Against a plain computation of the same posterior."""
    rng = random.Random(5)
    rows = [(i, lines(rng, EN if rng.random() < 0.4 else DE, rng.randint(0, 2)), rng.choice(["a.x.de", "b.x.de", "c.org", "src", None]), rng.choice(["en-US", "de", "fr", "", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, markup string")
    model = TrigramBayes().fit([lines(rng, EN, 300), lines(rng, DE, 300)], ["en", "de"])
    got = {r.doc_id: r for r in identify_languages(docs, model, host_col="host", markup_col="markup").collect()}
    logs = {i: model.likelihoods(t)[0] for i, t, *_ in rows}
    p = {i: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for i, v in logs.items()}
    every = (sum(p.values()) + 1) / (len(rows) + 3)
    for i, _, host, markup in rows:
        prior = every
        if host:
            if "." in host:
                dom = [p[j] for j, _, h, _ in rows if h and h.split(".")[-2:] == host.split(".")[-2:] and j != i]
                prior = (sum(dom, np.zeros(3)) + 10 * every) / (len(dom) + 10)
            own = [p[j] for j, _, h, _ in rows if h == host and j != i]
            prior = (sum(own, np.zeros(3)) + 10 * prior) / (len(own) + 10)
        score = logs[i] + np.log(prior)
        said = {"en-US": "en", "de": "de", "fr": "und"}.get(markup)
        if said:
            score += np.log([0.9 if k == said else 0.05 for k in model.languages])
        if host and host.endswith(".de"):
            score += np.log([0.7 if k == "de" else 0.15 for k in model.languages])
        q = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert got[i].language == model.languages[int(q.argmax())] and abs(got[i].posterior - q.max()) < 1e-6


def test_pages_evidence(spark):
    pages = spark.createDataFrame([(1, "HTTPS://u@Www.X.de:80/a?b", '<!DOCTYPE html><HTML class=a LANG="de-AT"><script>var t="</p>";x</script><p>Der&nbsp;Hund</p><!-- no --></html>'), (2, None, None), (3, "mailto:x", "plain")], "page_id long, url string, html string")
    a, b, c = pages_evidence(pages).orderBy("page_id").collect()
    assert (a.host, a.markup, a.text.split()) == ("www.x.de", "de-AT", ["Der", "Hund"])
    assert (b.host, b.markup, b.text) == (None, None, "") and (c.host, c.text) == (None, "plain")


FI = "ja on ei se että hän oli mutta joka niin kun minä sinä myös vain kuin nyt sitten olla tämä".split()


def test_rare_languages_are_kept_and_slips_take_nothing(spark):
    rng = random.Random(12)
    rows = [(i, lines(rng, (EN, DE)[i % 2], rng.randint(8, 30)), ("en", "de")[i % 2], "s") for i in range(3997)]
    rows += [(5000, lines(rng, FI, 30), "fi", "s"), (5001, lines(rng, FI, 25), "fi", "s"), (5002, lines(rng, EN, 12), "xx", "s"), (5003, "12 34", "yy", "s")]
    rows += [(5004, "zxqj wvkq xxzq qqzx kqwv jzxq vvkz", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = fit_language_model(docs)
    assert model.languages == ["de", "en", "fi", "xx", "yy", "und"]
    got = {r.doc_id: r for r in identify_languages(docs, model, host_col="source").collect()}
    # 2 of 4,001 labelled rows are 0.05 %
    assert all(got[i].language == "fi" and got[i].accepted for i in (5000, 5001))
    assert {5000, 5001} <= {r.doc_id for r in keep_identified(docs, model, host_col="source").collect()}
    assert all(got[i].language == k and got[i].accepted for i, _, k, _ in rows[:3997])
    assert got[5003].language in ("en", "de") and got[5004].language == "und"  # no words: the host decides


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_languages_of_rows_left_out_of_the_fit(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit_language_model(docs.where(~out))
    got = identify_languages(docs, model, host_col="source").join(docs.where(out), "doc_id")
    right, every = got.agg(F.count_if(F.col("language") == F.col("lang")), F.count(F.lit(1))).first()
    assert every and right >= 0.95 * every
