"""The pipeline's stages, each against brute force on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, tmp_path):
    from tests.llm.test_operators import brute_components, brute_hits, texts_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_of(docs)
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language ID":
            assert len(ids) >= 0.99 * len(before)
        elif name == "near-dedup":
            assert ids == sorted(r[0] for r in brute_components(before) if r[3])
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in brute_hits(before, bench) if not r[2])
        elif name == "mixing":
            assert set(ids) <= {i for i, _ in before} and max(map(ids.count, set(ids))) <= 2
        else:
            assert ids == sorted(i for i, _ in before)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(ids)


def test_stages_on_odd_rows(spark, sf_dir):
    from collections import Counter

    from tests.llm.test_operators import DOCS, brute_components, brute_hits, odd_rows, texts_of

    odd, none = spark.createDataFrame(odd_rows(), DOCS), spark.createDataFrame([], DOCS)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = Counter(texts_of(odd))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        made = stage(spark, odd, sf_dir)
        if name == "token files":
            assert Counter(r["doc_id"] for r in made.collect()) == Counter(i for i, _ in before.elements())
            continue
        assert made.schema == odd.schema or [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in odd.schema]
        after = Counter(texts_of(made))
        if name == "language ID":
            assert after and after <= before and all(any(map(str.isalpha, t)) for _, t in after)
        elif name == "near-dedup":
            assert after <= before and {(i, t) for i, t in before if not t.split()} <= set(after)
            assert {i for i, _ in after if i is not None} == {r[0] for r in brute_components(texts_of(odd)) if r[3] and r[0] is not None}
        elif name == "decontamination":
            assert after == Counter({r: n for r, n in before.items() if not brute_hits([r], bench)[0][2]})
        else:
            assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())


def test_unclear_languages_go(spark, sf_dir):
    """A text of which no part was ever seen has the same evidence for every language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.select("lang").where("lang IS NOT NULL").distinct().count() >= 4
    odd = docs.limit(1).selectExpr(*(f"CAST({v} AS {docs.schema[c].dataType.simpleString()}) AS {c}" for c, v in zip(docs.columns, ("-5" if c == "doc_id" else "'жжж щщщ'" if c == "text" else "NULL" for c in docs.columns), strict=True)))
    kept = corpus_pipeline.by_language(spark, docs.unionByName(odd), sf_dir)
    assert kept.where("doc_id = -5").count() == 0 and kept.count() >= 0.99 * docs.count()
