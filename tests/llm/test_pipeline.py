import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from . import conftest
from .test_decontamination import brute as brute_hits
from .test_exact_dedup import normal
from .test_near_dedup import brute as brute_near


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = conftest.awkward_texts(9) + ["1234 ?!", "keep p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 end"]
    rows = [(i, t, "en" if i % 4 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    items = [(1, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, texts[5])]
    spark.createDataFrame(rows, conftest.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    first = {}
    for i, t in left:
        first.setdefault(normal(t), i)
    left = [(i, t) for i, t in left if first[normal(t)] == i]
    near = brute_near(left)
    left = [(i, t) for i, t in left if near[i][2]]
    hits = {r[0] for r in brute_hits(left, items) if r[2]}
    left = [(i, t) for i, t in left if i not in hits]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(e.ids), hashlib.sha256(t.encode()).hexdigest()) for (i, t), e in zip(left, library.encode_batch([t for _, t in left], add_special_tokens=False), strict=True)}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, tmp_path, awkward):
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == awkward.columns, name
    assert len(corpus_pipeline.STAGES) == 5
