import numpy as np
import pyarrow as pa
from conftest_llm import prose, rows, table

from quillon.llm import common, quality


def naive(net, text):
    """The network by its definition."""
    if not text:
        return 0.0
    p, n = net.p, len(text)
    data = np.frombuffer(text + bytes(quality.WIDTH), np.uint8)
    out = np.array([sum(p["filters"][j][data[i + j]] for j in range(quality.WIDTH)) for i in range(n)])
    blocks = [out[i : i + quality.BLOCK].max(0) for i in range(0, n, quality.BLOCK)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks[:-1], blocks[1:], strict=True)] or blocks
    act = np.maximum(np.array(chunks) + p["bias"], 0)
    h = np.maximum(np.concatenate([act.max(0), act.mean(0)]) @ p["hidden"] + p["hidden_bias"], 0)
    return 1 / (1 + np.exp(-(h @ p["out"] + p["out_bias"][0])))


def random_net(seed=0, filters=5):
    rng = np.random.default_rng(seed)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, filters)), rng)
    net.p["bias"] = rng.normal(size=filters).astype(np.float32)
    return net


def test_forward_pass():
    texts = [prose(i, n).encode() for i, n in enumerate((1, 3, 90, 400, 1000))] + [b"", b"z", prose(9, 85).encode()[:512], prose(8, 200).encode()[:1024]]
    net = random_net().freeze()
    got = net.score(*common.blob(pa.array(texts, pa.binary())))
    assert np.allclose(got, [naive(net, t) for t in texts], atol=1e-4)


def test_gradient():
    texts = [prose(i, n).encode() for i, n in enumerate((2, 100, 300))]
    keep, weight = np.array([True, False, True]), np.array([1.0, 2.0, 0.5], np.float32)
    net = random_net(1, 4)

    def loss():
        p = np.array([naive(net, t) for t in texts])
        return float((-weight * np.where(keep, np.log(p), np.log(1 - p))).mean())

    grad = quality.gradient(net, texts, keep, weight)
    rng = np.random.default_rng(5)
    for name in ("bias", "hidden", "hidden_bias", "out", "out_bias", "filters"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for i in [*rng.integers(0, len(flat), 3), int(np.abs(g).argmax())]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            slope = g[i] - (1e-4 * old if name == "hidden" else 0)
            assert abs((up - down) / (2 * step) - slope) < 2e-2 * max(1, abs(slope))


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    net = quality.train(docs, labels.where("doc_id % 4 <> 0"), epochs=20)
    held = labels.where("doc_id % 4 = 0").toPandas().set_index("doc_id")
    got = quality.scores(docs, net).toPandas().set_index("doc_id").accepted.reindex(held.index)
    bad = (held.quality == 0) | (held.toxic == 1)
    assert got[~bad].mean() > 0.9 and (~got[bad]).mean() > 0.7


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (9, 1, 1), (5, None, None), (2, 0, 1), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.train(edge, labels, epochs=2)
    got = quality.scores(edge, net)
    assert got.count() == edge.count()
    assert {r.doc_id: r.accepted for r in got.collect() if r.doc_id in (2, 3)} == {2: False, 3: False}
    assert got.where("doc_id = 1").distinct().count() == 1
    kept = quality.accepted(edge, net)
    assert kept.columns == edge.columns and kept.where("text is null or text = ''").count() == 0
    assert quality.train(edge, labels.where("toxic = 9")) is None
    assert quality.accepted(edge, None).count() == edge.where("text <> ''").count()
    assert rows(quality.scores(empty, net)) == [] and quality.train(empty, labels) is None


def test_seeds_of_odd_samples():
    rng = np.random.default_rng(0)
    data, offsets = common.blob(pa.array(["a", "", "bc"]))
    assert quality.seeds(data, offsets, np.array([True, False, False]), rng).shape == (quality.WIDTH, 256, quality.FILTERS)
