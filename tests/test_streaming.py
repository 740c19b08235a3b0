import json
import os
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_sources import post, user

from quillon.operators import similarity
from quillon.sources import posts
from quillon.streaming import clustering, protomemes, windows


def made(seed=0, steps=6, per=12):
    """Protomemes of three topics, each with words of its own."""
    r = random.Random(seed)
    out = []
    for s in range(steps):
        for i in range(per):
            t = i % 3
            words = {f"t{t}w{r.randint(0, 5)}": r.randint(1, 3) for _ in range(4)}
            out.append({"step": s, "type": "hashtag", "marker": f"t{t}m{r.randint(0, 9)}", "posts": [s * 100 + i], "users": {f"u{t}{r.randint(0, 4)}": 1}, "words": words, "diffusion": [f"u{t}"], "topic": t})
    return list({(p["step"], p["marker"]): p for p in out}.values())


def test_sequential_clusters_find_topics():
    c = clustering.Clusterer(k=6, steps=4)
    data = made()
    for s in range(6):
        c.step([p for p in data if p["step"] == s])
    members = c.members()
    assert members and all(2 <= step <= 5 for _, step, *_ in members) and len(c.clusters) <= 6
    topics = {}
    for number, _, _, marker in members:
        topics.setdefault(number, set()).add(marker[:2])
    assert all(len(t) == 1 for t in topics.values())
    for cl in c.clusters.values():  # centroids are the sums of what is in the window
        for x in clustering.PARTS:
            total = {}
            for v in cl.members.values():
                for k, n in v[x].items():
                    total[k] = total.get(k, 0) + n
            assert dict(cl.centroid[x]) == total


def test_known_markers_expiry_and_late_rows():
    c = clustering.Clusterer(k=3, steps=2)
    p = lambda s, m, w: {"step": s, "type": "url", "marker": m, "posts": [s], "users": {}, "words": {w: 1}, "diffusion": []}
    c.step([p(0, "a", "x"), p(0, "b", "y")])
    c.step([p(1, "a", "quite other")])
    assert len({n for n, _, _, m in c.members() if m == "a"}) == 1 and len(c.members()) == 3
    c.step([p(2, "c", "z")])
    c.step([p(0, "late", "x")])  # its step has left the window
    assert c.dropped == 1 and ("url", "b") not in c.markers and all(s > 0 for _, s, _, _ in c.members())
    c.step([p(9, "d", "z")])
    assert [m[3] for m in c.members()] == ["d"]


def test_outliers_replace_the_least_recent():
    c = clustering.Clusterer(k=2, steps=100)
    for s, w in enumerate("abcd"):
        c.step([{"step": s, "type": "url", "marker": w, "posts": [s], "users": {}, "words": {w: 1}, "diffusion": []}])
    assert sorted(m[3] for m in c.members()) == ["c", "d"]


def test_ties_go_to_the_least_number():
    c = clustering.Clusterer(k=5, steps=5)
    one = lambda m: {"step": 0, "type": "url", "marker": m, "posts": [1], "users": {}, "words": {}, "diffusion": []}
    c.start([(4, one("x")), (2, one("y"))])
    assert c.best(clustering.vectors(one("z")))[0] == 2


def test_parallel_agrees_with_sequential(spark):
    data = made(5)
    keys = ["step", "type", "marker", "posts", "users", "words", "diffusion"]
    table = spark.createDataFrame([tuple(p[k] for k in keys) for p in data], "step long, type string, marker string, posts array<long>, users map<string,long>, words map<string,long>, diffusion array<string>")
    got = clustering.cluster_all(table, k=6, steps=4)
    c = clustering.Clusterer(k=6, steps=4)
    for s in range(6):
        c.step([p for p in data if p["step"] == s])
    want = spark.createDataFrame(c.members(), got.schema)
    cover = lambda d: d.select(F.concat_ws("|", "step", "type", "marker").alias("item"), "cluster")
    assert {r.item for r in cover(got).collect()} == {r.item for r in cover(want).collect()}
    assert similarity.lfk_nmi(cover(got), cover(want)).first().nmi > 0.5
    assert got.groupBy("cluster").agg(F.count_distinct(F.substring("marker", 1, 2)).alias("topics")).where("topics > 1").count() == 0
    empty = clustering.Clusterer()
    empty.batch(table.limit(0))
    assert empty.members() == []


def test_similarity_is_the_greatest_of_four():
    a = {"posts": {"1": 1}, "users": {"u": 2}, "words": {"x": 10**10, "y": 1}, "diffusion": {}}
    b = {"posts": {"2": 1}, "users": {"v": 2}, "words": {"x": 10**10}, "diffusion": {"d": 1}}
    assert clustering.similarity(a, b) == pytest.approx(1.0)  # products of large counts don't overflow
    assert clustering.cosine({}, {"a": 1}) == 0


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    ann, bob = user(7, "Ann"), user(8, "Bob")
    lines = [post(i, f"wizards brewing #Potion{i % 2} @u8 strong potions", ann if i % 3 else bob, f"Wed Jun 06 20:{i % 60:02}:{i * 7 % 60:02} +0000 2012", [f"Potion{i % 2}"], [8], ["http://x.y"] if i % 4 == 0 else []) for i in range(40)]
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, lines[k::4])))
    return folder


def test_protomemes(spark, feed):
    flat = posts.flatten(posts.read_json(spark, str(feed)))
    got = protomemes.protomemes(protomemes.features(flat), 600, ("potion1",)).collect()
    kinds = {(r.type, r.marker) for r in got}
    assert ("hashtag", "potion0") in kinds and ("hashtag", "potion1") not in kinds and ("mention", "8") in kinds and ("url", "http://x.y/long") in kinds and ("phrase", "wizard brew strong potion") in kinds
    whole = [r for r in got if r.marker == "8"]
    assert sum(len(r.posts) for r in whole) == 40 and all(sum(r.users.values()) == len(r.posts) == r.words["potion"] for r in whole)
    assert all(r.earliest <= r.latest and set(r.diffusion) <= {"7", "8"} for r in whole)
    assert {len({x.step for x in got})} == {4}


def test_stream_equals_batch(spark, feed):
    from quillon.model import post_schema

    stream = windows.read_stream(spark, str(feed), post_schema(), files_per_trigger=1)
    timed = lambda d: d.select("id", F.col("user.id").alias("user_id"), posts.post_time(F.col("created_at")).alias("ts"))
    batch = timed(posts.read_json(spark, str(feed)))
    for args in (("5 minutes",), ("10 minutes", "5 minutes")):
        want = windows.counts(batch, *args, by=("user_id",))
        got = windows.drain(windows.counts(timed(stream), *args, late="1 hour", by=("user_id",)))
        assert rows(got) == rows(want) and want.count() > 3
    assert windows.sessions(batch, "2 minutes", "user_id").agg(F.sum("n")).first()[0] == 40


def test_late_rows_are_dropped(spark, tmp_path):
    schema = spark.createDataFrame([], "ts timestamp, k int").schema
    for n, (stamp, k) in enumerate([("2024-01-01T10:00:00Z", 1), ("2024-01-01T12:00:00Z", 2), ("2024-01-01T12:10:00Z", 3), ("2024-01-01T10:00:30Z", 4), ("2024-01-01T14:00:00Z", 5)]):
        p = tmp_path / f"{n}.json"
        p.write_text(json.dumps({"ts": stamp, "k": k}))
        os.utime(p, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
    stream = windows.read_stream(spark, str(tmp_path), schema, files_per_trigger=1)
    got = windows.drain(windows.counts(stream, "1 minute", late="10 minutes"), "append")
    assert {(r.start.hour, r.n) for r in got.collect()} >= {(10, 1), (12, 1)} and got.where(F.hour("start") == 10).agg(F.sum("n")).first()[0] == 1


def test_online_clustering_of_a_stream(spark, feed, tmp_path):
    from quillon.model import post_schema

    state = clustering.Clusterer(k=5, steps=20)
    stream = windows.read_stream(spark, str(feed), post_schema(), files_per_trigger=1)

    def each(rows_, batch_id):
        state.batch(protomemes.protomemes(protomemes.features(posts.flatten(rows_.drop("_corrupt"))), 600), batch_id)

    query = stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination()
    assert len({m[3] for m in state.members()}) >= 4 and len(state.clusters) <= 5


def test_echo_and_replay(spark, feed, tmp_path):
    from quillon.model import post_schema

    q = windows.echo(windows.read_stream(spark, str(feed), post_schema()).select("id"), str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    t = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    assert rows(windows.replay(t, "1970-01-01 00:00:20", 30, 2).select("id", "step")) == [(2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1)]


def test_adjusted_deviations():
    c = clustering.Clusterer(deviations=2.0, adjust=0.5, total=1.0, squares=1.0, n=10)  # mean 0.1, deviation 0.3
    seen = []
    for _ in range(5):
        c.adapt()
        seen.append(c.now)
    assert seen == [1.5, 1.0, 0.5, 0.0, 0.0]
    c.total, c.squares = 9.0, 8.2  # mean 0.9, deviation 0.1
    for _ in range(6):
        c.adapt()
    assert c.now == 2.0 and c.threshold() == pytest.approx(0.7)


def test_results_as_lines(spark, tmp_path):
    c = clustering.Clusterer(k=4, steps=5)
    c.step(made(3, 3))
    (tmp_path / "clusters.txt").write_text("\n".join(c.lines()))
    assert rows(clustering.read_lines(spark.read.text(str(tmp_path / "clusters.txt")))) == sorted(c.members(), key=repr)


def test_following_a_folder(spark, feed, tmp_path):
    from quillon.store import Store

    live, whole = Store(spark, str(tmp_path / "live")), Store(spark, str(tmp_path / "whole"))
    live.follow(str(feed), 1).awaitTermination()
    whole.load(f"{feed}/*.json")
    assert live.tables() == whole.tables()
    for t in ("posts", "index_memes", "index_text"):
        key = "post_id" if t == "posts" else "key"
        assert rows(live.table(t).groupBy(key).count()) == rows(whole.table(t).groupBy(key).count())
    live.follow(str(feed)).awaitTermination()  # nothing is loaded twice
    assert live.table("posts").count() == 40


def test_comparing_costs_what_the_protomeme_has():
    class Unscanned(dict):
        def values(self):
            raise AssertionError("a centroid is gone through")

        items = values

    c = clustering.Clusterer(k=3, steps=5)
    data = [p for p in made(7, 2) if p["step"] == 0]
    c.start([(i % 3, p) for i, p in enumerate(data)])
    want = max((clustering.similarity(clustering.vectors(data[0]), x.centroid), -x.number) for x in c.clusters.values())
    for x in c.clusters.values():
        assert x.squares == clustering.squares(x.centroid)
        x.centroid = {part: Unscanned(v) for part, v in x.centroid.items()}
    assert c.best(clustering.vectors(data[0])) == (-want[1], pytest.approx(want[0]))


def test_clusters_of_a_table_leave_its_vectors_there(spark, monkeypatch):
    data = made(9, 8)
    keys = ["step", "type", "marker", "posts", "users", "words", "diffusion"]
    table = spark.createDataFrame([tuple(p[k] for k in keys) for p in data], "step long, type string, marker string, posts array<long>, users map<string,long>, words map<string,long>, diffusion array<string>")
    state = clustering.Clusterer(k=5, steps=3)
    for s in range(0, 8, 2):
        state.batch(table.where(F.col("step").isin(s, s + 1)))

    def none(_):
        raise AssertionError("vectors on the driver")

    monkeypatch.setattr(clustering, "vectors", none)
    assert rows(clustering.cluster_all(table, k=5, steps=3, per_batch=2)) == sorted(state.members(), key=repr)
    assert clustering.cluster_all(table.limit(0)).count() == 0


def test_protomemes_by_loops(spark):
    """Against loops over random posts, some without a user."""
    r = random.Random(4)
    data = []
    for i in range(120):
        names = r.sample("abcde", r.randint(0, 2))
        words = r.choices("vwxyz", k=r.randint(0, 3))
        data.append((i, r.choice([None, 1, 2, 3, 4]), r.randint(0, 2) * 60, r.sample(["p", "q"], r.randint(0, 2)), [str(r.randint(1, 6)) for _ in names], [], words, "", r.choice([None, "2", "9"])))
    table = spark.createDataFrame(data, "post_id long, user_id long, s long, hashtags array<string>, mentions array<string>, urls array<string>, words array<string>, phrase string, reshared_user string").withColumn("ts", F.timestamp_seconds("s"))
    met, want = {}, {}
    for _, u, s, _, names, _, _, _, other in data:
        for o in [*names, *([other] if other else [])]:
            if u is not None:
                met.setdefault((s // 60, str(u)), set()).add(o)
                met.setdefault((s // 60, o), set()).add(str(u))
    for i, u, s, tags, names, _, words, _, _ in data:
        for key in {(s // 60, "hashtag", t) for t in tags} | {(s // 60, "mention", n) for n in names}:
            p = want.setdefault(key, (set(), {}, {}, set()))
            p[0].add(i)
            for w in words:
                p[2][w] = p[2].get(w, 0) + 1
            if u is not None:
                p[1][str(u)] = p[1].get(str(u), 0) + 1
                p[3].update({str(u)} | met.get((key[0], str(u)), set()))
    got = protomemes.protomemes(table, 60).collect()
    assert {(p.step, p.type, p.marker): (set(p.posts), p.users, p.words, set(p.diffusion)) for p in got} == want and all(p.diffusion == sorted(p.diffusion) and p.posts == sorted(p.posts) for p in got)
