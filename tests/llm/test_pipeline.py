"""Every stage of the pipeline against a brute-force version, each on what the one before kept."""

import hashlib
import os
import sys

import corpus_pipeline
from tallyrook.llm import bpe, lang_id, registry

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_dedup import components, removed  # noqa: E402
from test_words_and_scans import contamination  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !!", None, "x", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if name != "byte_bpe":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            models = lang_id.learn(docs, lang_id._remainder(3) != 1)
            keep = {r.doc_id for r, (_, _, gone, _) in zip(before, models.predict([r.text for r in before]), strict=True) if not gone}
            assert {r.doc_id for r in rows} == keep == {r.doc_id for r in before} - {10**6, 10**6 + 1}
        elif name == "near_copies":
            assert {r.doc_id for r in rows} == {c for _, _, c in components(list(map(tuple, before)))} and len(rows) < len(before)
        elif name == "repeats":
            gone = {i: (n, sha) for i, _, n, sha in removed(list(map(tuple, before)))}
            texts = {r.doc_id: r.text for r in before}
            for r in rows:
                n, sha = gone[r.doc_id]
                assert hashlib.sha256(r.text.encode()).hexdigest() == sha if n else r.text == texts[r.doc_id]
            assert len(rows) == len(before)
        elif name == "decontamination":
            hit = {before[i].doc_id for i, *_, bad in contamination([r.text for r in before], items) if bad}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - hit and hit
        else:
            whole = bpe.codec(*registry.ranks())[0]
            texts = {r.doc_id: r.text for r in before}
            assert len(rows) == len(before)
            for r in rows:
                ids = whole.encode_ordinary(texts[r.doc_id] or "")
                assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        docs = after
