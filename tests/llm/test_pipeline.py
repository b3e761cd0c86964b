"""The corpus pipeline: every stage on its own input, against brute force where the stage is exact."""

import collections
import re

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import quality, toxicity
from gridloom.llm.common import table, written

from .test_operators import brute_components, brute_contamination


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, sf_dir), name)
        assert docs.columns == columns
        seen[name] = ([(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]

    before, after = seen["quality"]
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scores = {r.id: r.score for r in quality.score(table(spark, sf_dir, "documents"), model).collect()}
    assert {d for d, _ in after} == {d for d, _ in before if scores[d] >= 0.5}

    before, after = seen["exact_dedup"]
    least = {}
    for d, t in sorted(before):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    assert sorted(d for d, _ in after) == sorted(least.values())

    before, after = seen["near_dedup"]
    assert sorted(d for d, _ in after) == sorted({c for _, _, c in brute_components(before, 5, 80)})

    before, after = seen["decontaminate"]
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert sorted(d for d, _ in after) == sorted(d for d, _, hit, _ in brute_contamination(before, bench) if not hit)

    before, after = seen["mix"]
    copies = collections.Counter(d for d, _ in after)
    assert max(copies.values()) <= 3 and set(copies) <= {d for d, _ in before}


def test_stages_in_odd_cases(spark, sf_dir, edge_docs, no_docs):
    """Nulls, ties, repeated rows, odd texts: each stage keeps the rows that it should of what its predecessor kept."""
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    model = quality.train(edge_docs, table(spark, sf_dir, "labels"))
    order = lambda i: (i is None, i or 0)
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        scores = collections.Counter((r.id, r.score >= 0.5) for r in quality.score(docs, model).collect()) if name == "quality" else None
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == edge_docs.columns
        after = collections.Counter(r.doc_id for r in docs.collect())
        if name == "quality":
            assert after == collections.Counter({i: n for (i, good), n in scores.items() if good})
        elif name == "exact_dedup":
            least = {}
            for d, t in sorted(before, key=lambda x: order(x[0])):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
            assert after == collections.Counter(least.values())
        elif name == "near_dedup":
            assert after == collections.Counter({c for _, _, c in brute_components(before, 5, 80)})
        elif name == "decontaminate":
            assert after == collections.Counter(d for d, _, hit, _ in brute_contamination(before, bench) if not hit)
        else:
            assert set(after) <= {d for d, _ in before} and max(after.values()) <= 3
        if name == "quality":  # go on with all rows, so that the next stages meet the odd ones
            docs = edge_docs
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == edge_docs.columns and docs.count() == 0


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Names that operators use themselves, in the documents and in the labels."""
    names = ["__id", "__print", "__plan", "__source", "__copy", "__label", "__fold", "__rows", "row", "id", "print", "key", "size", "copies", "label", "score", "block", "odd_id", "a.b"]
    docs = table(spark, sf_dir, "documents").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    labels = table(spark, sf_dir, "labels").withColumn("__id", F.lit("x")).withColumn("text", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in stages[name](spark, docs, sf_dir).collect())
    kept = quality.keep_good(wide, quality.train(wide, labels))
    assert kept.columns == wide.columns and all(r["__id"] == f"__id {r.doc_id}" for r in kept.collect())
    marks = toxicity.weak_categories(wide, labels)
    assert toxicity.score(wide, toxicity.train(wide, marks, ["insult", "contempt", "toxic"])).count() == 60
