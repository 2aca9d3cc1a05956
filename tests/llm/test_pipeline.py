"""The corpus pipeline, stage by stage, against plain versions."""

from collections import Counter

import brute
from tokenizers import Tokenizer

import corpus_pipeline
from locusframe.llm import bpe, language, mixing, quality


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}

    model = language.learned(docs)
    ids = list(text)
    names, shares = model.score([text[d] for d in ids])
    kept = {d for d, n, s in zip(ids, names, shares, strict=True) if n != "und" and s >= corpus_pipeline.SURE}
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, sf_dir).collect()} == kept

    own = {r["doc_id"] for r in quality.op9_quality_rules(spark, sf_dir).filter("kept").collect()}
    assert not any(brute.quality(text[d])[-1] for d in own)
    kept &= own

    groups = brute.jaccard_components({d: text[d] for d in kept}, 5, 80)
    kept = {d for d in kept if groups[d][1] == d}

    sizes = {d: len(brute.WORD.findall(text[d])) for d in kept}
    total = Counter()
    for d in kept:
        total[source[d]] += sizes[d]
    target = brute.mix_targets(dict(total))
    draws = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.draw(docs["doc_id"]).alias("u")).collect()}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for d in kept:
        rate = float(target[source[d]]) / total[source[d]]
        tokens = library.encode(text[d], add_special_tokens=False).ids
        want[d, len(tokens), ",".join(map(str, tokens))] += int(rate) + (draws[d] < rate - int(rate))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
