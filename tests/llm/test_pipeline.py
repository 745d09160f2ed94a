"""The pipeline's stages against their operators' own decisions and against brute force."""

from collections import Counter

import pytest
from llm.conftest import messy_rows, prose
from llm.test_rows import FOLD, components, contaminated

import corpus_pipeline as pipeline
from aerolattice.llm import toxicity
from aerolattice.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Messy documents with ids of their own, a benchmark, and labels."""
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", None, len(t or "")) for i, t, *_ in messy_rows()]
    rows += [(100 + k, prose(k, 60) + (" blorgh you" if k % 3 == 0 else ""), "en", "s", 1) for k in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 3 == 0)) for k in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 60)), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_each_stage_keeps_what_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]

    bad = {r.doc_id for r in toxicity.toxicity(docs, marks).where("score >= 0.3").collect()} - {None}
    kept = pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    assert Counter(texts(kept)) == Counter((i, t) for i, t in texts(docs) if i not in bad)
    assert len([i for i in bad if i >= 100 and (i - 100) % 3 == 0]) >= 25 and not [i for i in bad if (i - 100) % 3]

    rows = texts(kept)
    unique = pipeline.drop_copies(spark, kept, folder)
    best = {}
    for i, t in rows:
        old = best.get(t.translate(FOLD), (None, None))
        best[t.translate(FOLD)] = max(old, (i, t), key=lambda x: -(10**9) if x[0] is None else x[0])
    assert unique.columns == docs.columns
    assert Counter((i, t.translate(FOLD)) for i, t in texts(unique)) == Counter((i, t) for t, (i, _) in best.items())

    rows = texts(unique)
    apart = pipeline.drop_near_copies(spark, unique, folder)
    root = {i: c for (i, _, c) in components(rows, 5, 80)}
    assert Counter(texts(apart)) == Counter((i, t) for i, t in rows if i is None or root[i] == i)

    rows = texts(apart)
    clean = pipeline.drop_benchmark(spark, apart, folder)
    items = [("1", prose(2, 60)), ("2", None)]
    dirty = {k[0] for k in contaminated(rows, items) if k[5]}
    assert dirty and Counter(texts(clean)) == Counter((i, t) for i, t in rows if i not in dirty or i is None)

    packed = pipeline.pack(spark, clean, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in texts(clean))
    assert Counter(tuple(r) for r in packed) == Counter(tuple(r) for r in pipeline.run(spark, folder).collect())


def test_tokenizer_file_is_not_in_the_repository():
    assert "public_tokenizers" in byte_bpe()
