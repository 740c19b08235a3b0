import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest_llm import table

from quillon.llm import bpe, common, quality, secrets, simhash
from quillon.llm.queries import QUERIES

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def test_stages(spark, sf):
    """Each stage against a brute-force version of it, on what the stage before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontamination", "secret_scan", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    # quality: the same network over single texts
    out = stage["quality_filter"](spark, docs, sf)
    assert out.columns == columns
    net = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    net.freeze()
    data, offsets = common.blob(pa.array(list(texts.values())))
    good = {i for i, p in zip(texts, net.score(data, offsets), strict=True) if p >= quality.THRESHOLD}
    kept = {r.doc_id for r in out.collect()}
    assert kept == good and 0 < len(kept) < len(texts)
    # near copies: one of each component of the graph of all pairs within the radius; what the tables miss may stay
    docs = common.written(out)
    out = stage["near_dedup"](spark, docs, sf)
    assert out.columns == columns
    ids = sorted(kept)
    at, p = simhash.fingerprint(*common.blob(pa.array([texts[i] for i in ids])))
    p = p.view(np.uint64)
    far = np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) + np.bitwise_count(p[:, None, 1] ^ p[None, :, 1])
    root = list(range(len(at)))
    while True:
        new = [min(root[j] for j in np.flatnonzero(far[i] <= simhash.RADIUS)) for i in range(len(at))]
        if new == root:
            break
        root = new
    want = {ids[at[i]] for i in range(len(at)) if root[i] == i} | {i for k, i in enumerate(ids) if k not in set(at.tolist())}
    kept = {r.doc_id for r in out.collect()}
    assert want <= kept and len(kept - want) <= 0.1 * max(1, len(ids) - len(want))
    # benchmark: thirteen words in common
    docs = common.written(out)
    out = stage["decontamination"](spark, docs, sf)
    assert out.columns == columns
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(r.text)
        grams |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    want = {i for i in kept if not any(tuple(w[k : k + 13]) in grams for w in [WORD.findall(texts[i])] for k in range(len(w) - 12))}
    kept = {r.doc_id for r in out.collect()}
    assert kept == want
    # secrets: replaced where they stand, all else as it was
    docs = common.written(out)
    out = stage["secret_scan"](spark, docs, sf)
    assert out.columns == columns and out.dtypes == docs.dtypes
    mark = secrets.MASK.decode()
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean == {i: re.sub(r"(?<![\w+/-])(?:[0-9a-f]{40}|AKIA[A-Z0-9]{16})(?![\w+/-])", mark, texts[i]) for i in kept}
    assert all(r.n_chars == len(r.text) for r in out.collect())
    # tokens
    docs = common.written(out)
    codec = bpe.Codec(open(bpe.VOCABULARY, "rb").read())
    got = {r.doc_id: r.tokens for r in stage["tokens"](spark, docs, sf).collect()}
    assert got == {i: codec.bpe.encode_ordinary(t) for i, t in clean.items()}
    # and all in one
    assert {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, sf).collect()} == got


def test_edges(spark, edge, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "é é")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, empty, table(spark, [(None, None, None)])):
        for name, f in corpus_pipeline.STAGES:
            out = common.written(f(spark, docs, str(tmp_path)))
            if name != "tokens":
                assert out.columns == docs.columns
            docs = out


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", q).group() for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
