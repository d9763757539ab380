import os

import pytest

import __spark_entry__
import corpus_pipeline
from tessella.llm import langid, packing, toxicity
from tessella.llm.common import table
from tessella.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_match_plain_computations(spark, tmp_path):
    docs = table(spark, SF, "documents")
    cols = docs.columns
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"))
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        rows, kept = {r.doc_id: r.text for r in before.collect()}, docs.collect()
        outs.append(docs.count())
        if i < 4:
            assert docs.columns == cols
            ids = {r.doc_id for r in kept}
            assert all(rows[r.doc_id] == r.text for r in kept) and len(ids) == len(kept)
        if i == 0:
            assert ids == {d for d, t in rows.items() if model.score(model.margin(t)) < 0.5}
        elif i == 1:
            speech = langid.fit_language_model(before)
            assert ids == {r.doc_id for r in langid.identify_languages(before, speech, host_col="source").where("accepted").collect()}
        elif i == 2:
            best = {}
            for d, t in rows.items():
                key = (t or "").translate(AZ)
                best[key] = max(best.get(key, d), d)
            assert ids == set(best.values())
        elif i == 3:
            fps, up = {d: fingerprint(t) for d, t in rows.items()}, {d: d for d in rows}

            def root(d):
                while up[d] != d:
                    d = up[d]
                return d

            order = sorted(fps)
            for k, a in enumerate(order):
                for b in order[:k]:
                    if (fps[a] ^ fps[b]).bit_count() <= 2:
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
            assert ids == {d for d in order if root(d) == d}
        else:
            sizes = {d: len(packing.encoded(t, corpus_pipeline.tokenizer_path())) // 4 + 1 for d, t in rows.items()}
            got = {}
            for r in kept:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == sizes
            # every sequence is filled without gaps, up to 4096 tokens
            ends = {}
            for r in sorted(kept, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= 4096 and len(ends) <= 1.05 * -(-sum(sizes.values()) // 4096) + 1
    assert outs[0] > outs[2] and outs[3] <= outs[2]
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_take_odd_columns_nulls_repeats_and_empty_tables(spark):
    own = table(spark, SF, "documents")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", `a``b` string, `x.y` int, id long, text_sha256 string"

    def row(i, text, *more):
        return tuple({"doc_id": i, "text": text, "source": "src0", "lang": "en"}.get(c) for c in kinds) + more

    prose = own.where("lang = 'en'").orderBy("doc_id").first().text
    rows = [row(-1, prose, "b", 1, 7, "s"), row(-1, prose, "b", 1, 7, "s"), row(None, prose + " and more of it", None, None, None, None), row(-2, "", "c", 2, 8, None), row(-3, None, "c", 2, 8, None)]
    extra = spark.createDataFrame(rows, schema)
    docs = own.unionByName(extra, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name in ("toxicity", "language_id"):
            assert ids.count(-1) == 2 and None in ids, name
        elif name == "exact_dedup":
            # the row of the documents has the largest id of the equal texts; of the two that are empty, -2 stays
            assert -1 not in ids and None in ids and -2 in ids and -3 not in ids
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF)
    assert packed.where("doc_id in (-2, -3)").count() == 2 and packed.where("doc_id = -1 and piece = 0").count() == 2
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), SF).count() == 0
