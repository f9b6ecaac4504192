"""Operations for training-data pipelines: sharding, packing, token counts,
toxicity, fingerprints, exact top-k search, BPE, near-duplicates, quality and
chat formatting.  Nothing outside this folder imports it."""
