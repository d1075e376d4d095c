"""The pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from glyphgate.llm import bytebpe, mixing
from tests.llm.test_operators import make_docs, slow_components, slow_fingerprint, slow_quality, slow_spans


def redacted(text):
    out, at = "", 0
    for a, _, _, b in slow_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    secret = "token = 0123456789abcdef0123456789abcdef0123"
    docs = make_docs(spark)
    docs = docs.unionByName(spark.createDataFrame([(5_000 + i, f"{secret} " + " ".join(f"v{i}x{k}" for k in range(40)), "en", f"s{i % 3}", 1, 1, "x", "y") for i in range(12)], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        steps.append(now.collect())
        now = spark.read.parquet(str(tmp_path / name))
    raw, good, single, clean, mixed = steps
    verdicts, often = slow_quality(raw)
    assert not often and sorted((v[0] for v in verdicts if v[7]), key=str) == sorted((r.doc_id for r in good), key=str)
    component = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(set(component.values()))
    assert sorted((r.doc_id, redacted(r.text)) for r in single) == sorted((r.doc_id, r.text) for r in clean)
    assert any("[SECRET]" in r.text for r in clean)
    times = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix(spark.createDataFrame(clean)).collect() if r.size}
    expected = sorted(r.doc_id for r in clean for _ in range(times.get((r.doc_id, len(r.text.split())), 0)))
    assert sorted(r.doc_id for r in mixed) == expected and mixed[0].__fields__ == docs.columns
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    want = []
    for r in mixed:
        ids = encoding.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, now.collect())) == sorted(want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)
