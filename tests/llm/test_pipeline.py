from collections import defaultdict

import corpus_pipeline
from tapewright.llm import minhash, packing, toxicity


def test_stages_work_on_what_is_kept(spark, documents, labels, tmp_path):
    at = f"file://{tmp_path}"
    own = documents.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    pieces = corpus_pipeline.run(spark, at).collect()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, at)
        assert docs.columns == own.columns, name
        assert docs.count() < before.count(), name
    got = defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert set(got) == {r["doc_id"] for r in docs.collect()}
    encode = packing.encoder(packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for r in docs.collect():
        if r["doc_id"] is not None:
            assert got[r["doc_id"]] == len(encode(r["text"])) + 1
    toxic = {r["doc_id"] for r in toxicity.score(own, labels).where("predicted = 1").collect()}
    assert not toxic & set(got)
    classes = minhash.near_duplicates(docs).collect()
    assert all(r["kept"] for r in classes)
