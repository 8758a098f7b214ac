"""The corpus pipeline stage by stage."""

import corpus_pipeline
from fieldspark.llm.kernels import Block
from fieldspark.llm.quality import train_quality
import numpy as np
import pyarrow as pa

from test_minhash import exact
from test_packing_mixing import check_packing
from test_repeats import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    tables, cached = {}, []
    try:
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL).cache()
            cached.append(out)
            tables[name] = (docs.collect(), out.collect())
            if name != "pack":
                assert out.columns == columns
                assert out.schema.simpleString() == docs.schema.simpleString()
                docs = out
    finally:  # the session is shared with the other tests
        for out in cached:
            out.unpersist(blocking=True)
    before, after = tables["quality"]
    model = train_quality(spark.read.parquet(f"{SMALL}/documents.parquet"),
                          spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = model.tails(model.score(Block(pa.array([r.text for r in before]))))[:, -1] >= 0.5
    assert {r.doc_id for r in after} == {r.doc_id for r, g in zip(before, good) if g}
    before, after = tables["near_dedup"]
    comp = exact({r.doc_id: r.text for r in before})
    assert {r.doc_id for r in after} == {k for k, (_, c) in comp.items() if k == c}
    before, after = tables["suffix_dedup"]
    texts = {r.doc_id: r.text.encode() for r in before}
    flags = brute(texts, 100)
    for r in after:
        kept = bytes(b for b, f in zip(texts[r.doc_id], flags[r.doc_id]) if not f)
        assert r.text == kept.decode(errors="ignore") and r.n_chars == len(r.text)
    before, after = tables["mix"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert np.bincount([r.doc_id for r in after]).max() <= 3
    before, after = tables["pack"]
    many = {}
    for r in before:
        many.setdefault(r.doc_id, []).append(r.text)
    once = {k: v[0] for k, v in many.items() if len(v) == 1}
    assert len({(r.sequence_id, r.offset) for r in after}) == len(after)
    sizes = {}
    for r in after:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 1024 and set(once) <= {r.doc_id for r in after}


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert check_packing


def test_stages_on_odd_rows(spark):
    """NULLs everywhere, empty and long texts, repeated rows, clashing names,
    and an empty table."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _row string, "
              "_id string, kept boolean, copies int, `a.b` string")
    more = (None, "x", None, 1, "y")
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (3, text, "en", "s", 9, *more),
            (3, text, "en", "s", 9, *more), (None, text + " ü" * 90, "en", None, 9, *more),
            (4, "long text " * 20000, "de", "t", 1, *more), (5, text, "en", "t", 9, *more)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "pack":
                assert out.columns == docs.columns
            n = out.count()
            assert (n > 0) == bool(data), name
            if name != "pack":
                docs = out
