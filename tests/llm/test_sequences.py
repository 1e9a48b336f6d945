"""Random access to token sequences without copies."""

import numpy as np
import pyarrow as pa
import pytest

from spiketide.llm import binary


def test_sequences_are_views_of_the_file(spark, tmp_path):
    import public_tokenizers

    texts = [(i, f"word{i} " * (3 + i % 50) + "Ends with marks!? $$$ (x-1)") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = f"file://{tmp_path}/tokens"
    manifest = binary.write(docs, out, public_tokenizers.path("byte_bpe_50k.json"), sequence=16, file_rows=10_000)
    name, tokens = manifest.select("file", "tokens").first()
    every = np.concatenate([r["ids"] for r in binary.read(manifest, out).orderBy("start").collect()])
    s = binary.Sequences(f"{out}/{name}.arrow")
    assert len(s) == -(-tokens // 16) > binary.BATCH and len(every) == tokens
    with pa.memory_map(f"{tmp_path}/tokens/{name}.arrow") as f:
        size = f.size()
    before = pa.total_allocated_bytes()
    held = [s[k] for k in range(len(s))]
    assert pa.total_allocated_bytes() == before  # no buffer was copied
    low = min(ids.buffers()[1].address for ids, _ in held)
    assert all(low <= ids.buffers()[1].address < low + size for ids, _ in held)
    for k in (0, 1, 255, 256, 300, len(s) - 1):
        ids, mask = held[k]
        view = ids.to_numpy(zero_copy_only=True)
        kept = np.asarray(mask.to_pylist())
        assert len(ids) == len(mask) == 16 and view[kept].tolist() == every[16 * k : 16 * k + 16].tolist()
    assert sum(sum(m.to_pylist()) for _, m in held) == tokens
    for k in (-1, len(s)):
        with pytest.raises(IndexError):
            s[k]
