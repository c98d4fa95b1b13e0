

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import decontaminate, neardup, pii
from marginalia.llm.registry import TOKENIZER

from .conftest import ODD
from .test_neardup import brute
from .test_scans import WORD, base_spans, low, windows

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).persist()
        assert after.columns == columns and after.schema == docs.schema, name
        assert after.count() <= before.count()
        if name == "quality classifier":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            assert 0 < after.count() < before.count()
            assert after.join(labels.filter("quality = 0"), "doc_id").count() <= 2
        if name == "near-dedup":
            found = neardup.near_duplicates(before, 5).filter("kept").select("doc_id")
            assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in after.collect())
            assert neardup.near_duplicates(after, 5).filter("NOT kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contamination(after, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("contaminated").count() == 0
        if name == "pii":
            assert pii.report(after).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert after.filter("n_chars <> length(text)").count() == 0
        before = after
    assert corpus_pipeline.run(spark, FOLDER).count() == before.count()


def test_odd_rows_pass_all_stages(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and an empty table: every stage gives its columns."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(d, t, None if k % 2 else "en", None, None if k % 3 else 5) for k, (d, t) in enumerate(ODD * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("doc_id < 60").union(odd), FOLDER)
        rows = out.collect()
        if name == "near-dedup":
            assert len([r for r in rows if (r.text or "").startswith("same words")]) == 1 and len({(r.doc_id, r.text or "") for r in rows}) == len(rows)
        if name == "decontamination":
            assert len([r for r in rows if r.text is None]) == 4
        if name == "pii":
            assert len([r for r in rows if r.text == "x" * 200_000]) == 2 and len(rows) == docs.filter("doc_id < 60").count() + len(ODD) * 2
        if name == "bpe":
            assert len([r for r in rows if r.n_tokens == 0]) >= 6
        assert name == "bpe" or out.columns == docs.columns
        if name != "near-dedup":
            assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_against_brute_force(spark):
    """Near-duplicates, contamination, masking and encoding of whole documents worked out again in plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {d for d, _, _, k in brute(sorted(texts.items()), 5) if k}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()} == kept
    items = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    clean = set()
    for doc_id, text in texts.items():
        w, hit = WORD.findall(low(text)), set()
        for n in {len(k) for k in items}:
            hit |= {p for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in items for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(doc_id)
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, FOLDER).collect()} == clean
    weights = pii.fitted()
    for r in corpus_pipeline.pii_redaction(spark, docs, FOLDER).collect():
        spans = pii.find([texts[r.doc_id]], weights)[1][0]
        assert set(base_spans(texts[r.doc_id])) <= set(spans) and r.text == pii.masked(texts[r.doc_id], spans) and r.n_chars == len(r.text)
    library = Tokenizer.from_file(TOKENIZER)
    for r in corpus_pipeline.bpe_encoding(spark, docs, FOLDER).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1 AND toxic = 0")
    clean = docs.join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.quality_classifier(spark, docs, FOLDER).join(labels, "doc_id", "left_semi")
    assert kept.count() >= 0.97 * clean.count()
