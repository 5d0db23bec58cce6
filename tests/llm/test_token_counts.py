import public_tokenizers

from cadenza.llm.shared import fresh_path
from cadenza.llm.token_counts import count_tokens, load_tokenizer


def test_counts_and_cache(spark, docs, odd_docs, no_docs):
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = str(public_tokenizers.path(name))
        encode, cache = load_tokenizer(path), fresh_path(spark, "cache-test")
        for table in (odd_docs, docs, docs):
            rows = [(r.doc_id, r.text or "") for r in table.collect()]
            want = sorted(((i, len(t.encode()), len(encode([t])[0]), len(encode([t])[0]) > 20) for i, t in rows), key=str)
            got = count_tokens(table, tokenizer=path, cache=cache, limit=20).collect()
            assert sorted(map(tuple, got), key=str) == want
        cached = spark.read.parquet(cache)
        texts = {r.text or "" for t in (docs, odd_docs) for r in t.collect()}
        assert cached.count() == cached.select("digest").distinct().count() == len(texts)
        assert count_tokens(no_docs, tokenizer=path, cache=cache).count() == 0
