"""The pipeline against plain versions of its stages on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_native_ops import base_counts, words
from tests.llm.test_python_ops import brute_classes
from unionlake.llm import quality


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rated, q = quality.rate(docs, quality.language_references(docs))
    kept = {r.doc_id: r.text for r in rated.collect() if r[q].kept}
    assert all(not base_counts(t)[-1] for t in kept.values()) and len(kept) > 150
    seen, rows = [], []
    for d, t in sorted(kept.items()):
        stay = []
        for x in t.split("\n"):
            s = set(words(x))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                stay.append(x)
            if s:
                seen.append(s)
        rows.append((d, "\n".join(stay)))
    rows = [(d, t) for (d, t), (_, c) in zip(rows, sorted(brute_classes(rows))) if d == c]
    runs = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [runs(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    flat = lambda w: " " + " ".join(w) + " "
    rows = [(d, t) for d, t in rows if not any(flat(i) in flat(runs(t)) for i in items)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want.update((d, k, at, len(p := ids[at : at + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
