"""Operators on small fixtures: nulls, ties, empty tables, repeated rows, extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewave.operators import catalog, dedupe, feedback, knn, matching, rank, tags, timeseries

TRACK = "ord bigint, path string, artist string, title string, bpm double, camelot string, rating int, added string, duration int, bitrate int, mytags array<string>, tags array<string>, samples double, genre string, subgenre string"


def track(ord, path=None, artist=None, title=None, bpm=None, camelot=None, rating=None, added=None, duration=None, bitrate=None, mytags=None, tags_=None, samples=None):
    return (ord, path or f"/m/{ord}.mp3", artist, title, bpm, camelot, rating, added, duration, bitrate, mytags, tags_, samples, None, None)


def test_latest_and_counts(spark):
    t = spark.createDataFrame([track(1, "/a"), track(2, "/a", bpm=120.0, camelot="8A"), track(3, "/b", bpm=0.0, camelot="1A")], TRACK)
    assert sorted(r.ord for r in catalog.latest(t).collect()) == [2, 3]
    v = spark.createDataFrame([(2,), (2,), (9,)], "ord bigint")
    assert tuple(catalog.counts(t, v).first()) == (3, 1, 1)
    assert tuple(catalog.counts(t.limit(0), v).first()) == (0, 0, 0)


def test_search_is_literal(spark):
    t = spark.createDataFrame([track(1, title="100%_x"), track(2, title="100 x"), track(3, mytags=[None, " Night ", ""])], TRACK)
    assert [r.ord for r in catalog.search(t, "%_").collect()] == [1] and [r.ord for r in catalog.search(t, "NIGHT").collect()] == [3] and catalog.search(t, " ").count() == 3


def test_folder_rules(spark):
    t = spark.createDataFrame([track(1, "/Base/Nested/x"), track(2, "/base/y"), track(3, "/other"), track(4, None)], TRACK)
    rules = catalog.upsert_rule([("/base/nested", "stems"), ("/base", "baseline")], "/BASE", "full")
    assert rules == [("/BASE", "full"), ("/base/nested", "stems")]
    assert [r["mode"] for r in catalog.folder_mode(t, rules, "none").orderBy("ord").collect()] == ["full", "full", "none", "none"]


def test_playlist(spark):
    t = spark.createDataFrame([track(1, rating=3, mytags=["Peak"]), track(2, mytags=["Peak"], added="x"), track(3, rating=5, mytags=["peak"])], TRACK)
    assert [r.ord for r in catalog.playlist(t, "Peak", 3).collect()] == [1] and catalog.playlist(t, rating_min=0).count() == 3 and catalog.playlist(t, since="2030-01-01").count() == 3


def test_duplicates(spark):
    t = spark.createDataFrame([track(1, "/a/x.mp3", "A", "S", duration=200, bitrate=320), track(2, "/b/x.flac", " a ", "s", duration=200, bitrate=100), track(3, "/c/x.mp3", "A", "s", duration=200, bitrate=320), track(4, artist="B", title="s")], TRACK)
    from cratewave.functions import text as T

    keyed = dedupe.names_key(t.withColumn("lossless", T.is_lossless(F.col("path"))))
    pairs = dedupe.keep_best(keyed)
    assert sorted((r.keep, r.lose) for r in pairs.collect()) == [(2, 1), (2, 3)]
    plan = dedupe.stage_plan(t.join(pairs.select(F.col("lose").alias("ord")), "ord"), "/stage")
    assert [r.target for r in plan.orderBy("ord").collect()] == ["/stage/x.mp3", "/stage/x_1.mp3"]
    assert dedupe.keep_best(keyed.limit(0)).count() == 0


def brute(x, q, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - x @ x[q], 9)
    d[q] = np.inf
    return sorted(range(len(x)), key=lambda i: (d[i], i))[:k]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_blocks_find_the_nearest(spark, parts):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).round(3)
    x[50] = x[7]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord bigint, v array<double>")
    got = knn.nearest_for_all(df.where("ord % 10 = 7"), df, 5, parts).collect()
    for q in range(7, 120, 10):
        assert [r.ord for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == brute(x, q, 5)


def test_numbering_and_index(spark):
    rows = spark.createDataFrame([(i * 7 % 101, f"/{i}") for i in range(101)], "ord bigint, path string")
    assert [r.position for r in knn.number(rows, "ord").orderBy("ord").collect()] == list(range(1, 102))
    assert knn.number(rows.limit(0), "ord").count() == 0
    old = spark.createDataFrame([(0, "/1"), (1, "/gone")], "label bigint, path string")
    new = knn.extend_index(old, rows.where("ord < 21"))
    labels = {r.path: r.label for r in new.collect()}
    assert labels["/1"] == 0 and labels["/gone"] == 1 and sorted(labels.values()) == list(range(len(labels)))
    assert knn.extend_index(new, rows.where("ord < 21")).count() == new.count()


def test_current_vectors(spark):
    import datetime as dt

    d = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 1, [1.0, 0.0], d(1)), (2, 1, [0.0, 1.0], d(2)), (3, 1, [0.0, 0.0], d(3)), (4, 2, [1.0, 1.0], None), (5, None, [1.0, 1.0], d(1)), (6, 3, None, d(1))]
    df = spark.createDataFrame(rows, "vec_id bigint, ord bigint, embedding array<float>, built_at timestamp")
    assert sorted((r.ord, r.vec_id) for r in knn.current_vectors(df, 2).collect()) == [(1, 2), (2, 4)]


def test_recommend_rules_and_pool(spark):
    rng = np.random.default_rng(3)
    n = 40
    rows = [(i, i, f"/{i}", "a", "t", f"{i % 12 + 1}A" if i % 5 else None, 100.0 + i if i % 7 else None, 0.5, rng.normal(size=4).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "label bigint, ord bigint, path string, artist string, title string, camelot string, bpm double, samples double, v array<double>")
    seed = rank.resolve_seed(df, "/3")
    assert seed["ord"] == 3 and rank.resolve_seed(df, "%") is None
    got = rank.recommend(df, seed, top=5, extra=10).collect()
    x = np.array([r[-1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x[3]
    pool = [i for i in sorted(range(n), key=lambda i: (d[i], i))[:15] if i != 3]
    from tests.test_functions import rule

    def tempo(b):
        return not b or any(abs(t - b) <= t * 0.06 for t in (103.0, 206.0, 51.5))

    want = [i for i in pool if rule("4A", rows[i][5])[0] and tempo(rows[i][6])][:5]
    assert [r.ord for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_profiles_and_suggestions(spark):
    rng = np.random.default_rng(5)
    base = {"a": rng.normal(size=6), "b": rng.normal(size=6)}
    rows, vecs = [], []
    for i in range(30):
        tag = "ab"[i % 2]
        v = base[tag] + 0.1 * rng.normal(size=6)
        rows.append(track(i, mytags=[tag] if i < 20 else None))
        vecs.append((i, v.tolist()))
    t, v = spark.createDataFrame(rows, TRACK), spark.createDataFrame(vecs, "ord bigint, v array<double>")
    p = tags.profiles(t, v)
    got = {r.tag: r for r in p.collect()}
    for tag, k in (("a", 0), ("b", 1)):
        u = np.array([np.array(x) / np.linalg.norm(x) for i, x in vecs if i < 20 and i % 2 == k])
        c = u.mean(axis=0)
        c /= np.linalg.norm(c)
        s = u @ c
        assert got[tag].samples == 10 and np.allclose(got[tag].centroid, c) and abs(got[tag].threshold - (s.mean() - s.std())) < 1e-9
    best = tags.suggest(v.where("ord >= 20"), p, margin=0.1, top_k=1).collect()
    assert {r.ord: r.tag for r in best} == {i: "ab"[i % 2] for i in range(20, 30)}
    assert tags.profiles(t.limit(0), v).count() == 0
    picks = [r.ord for r in tags.diverse(v.join(spark.createDataFrame([(i, float(i % 7)) for i in range(30)], "ord bigint, uncertainty double"), "ord"), 4).orderBy("pick").collect()]
    x = np.array([a for _, a in vecs])
    want = [6]
    while len(want) < 4:
        d = np.min(np.linalg.norm(x[:, None] - x[want][None], axis=2), axis=1).round(9)
        want.append(max((i for i in range(30) if i not in want), key=lambda i: (d[i], -i)))
    assert picks == want


def test_uncertainty_strategies(spark):
    s = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.1), (2, "x", 0.5), (2, "y", 0.5), (3, "x", -0.5), (3, "y", 1.0)], "ord bigint, tag string, score double")
    assert [r.ord for r in tags.uncertainty(s, "margin").collect()] == [2, 1, 3]
    assert [r.ord for r in tags.uncertainty(s, "entropy").collect()][-1] == 3  # NaN last
    with pytest.raises(ValueError):
        tags.uncertainty(s, "luck")


def test_feedback(spark):
    tt = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (2, 0, "a")], "ord bigint, pos int, tag string")
    assert sorted(map(tuple, feedback.tag_pairs(tt).collect())) == [("a", "a", 1), ("a", "b", 2)]
    users = spark.createDataFrame([("/1", "a")], "path string, tag string")
    sugg = spark.createDataFrame([("/1", "b", 0.9), ("/2", "c", 0.2)], "path string, tag string, confidence double")
    act = spark.createDataFrame([("/1", "b"), ("/9", "z")], "path string, tag string")
    new, rest, log = feedback.accept(users, sugg, act)
    assert sorted(map(tuple, new.collect())) == [("/1", "a"), ("/1", "b")] and rest.count() == 1 and log.count() == 1
    rest, log = feedback.reject(sugg, act.withColumn("reason", F.lit("no")))
    assert rest.count() == 1 and log.first().reason == "no"
    usage = spark.createDataFrame([("B", 5), ("c", 1)], "tag string, n bigint")
    swaps = spark.createDataFrame([("b", "B")], "tag string, user_chose string")
    bent = feedback.adjust(sugg, swaps, usage).collect()
    assert [(r.path, r.tag, r.confidence) for r in bent] == [("/1", "B", 1.0)]
    store = spark.createDataFrame([("/1", ["x"]), ("/2", ["y"])], "path string, tags array<string>")
    change = spark.createDataFrame([("/1", []), ("/3", ["z", "z"])], "path string, tags array<string>")
    assert sorted((r.path, r.tags) for r in feedback.set_tags(store, change).collect()) == [("/2", ["y"]), ("/3", ["z"])]
    empty = spark.createDataFrame([], "log_id bigint, logged_at timestamp, track string, action string, tag string, confidence double, reason string, user_chose string")
    assert feedback.accuracy(empty).first().accuracy == 0.0 and feedback.substitutions(empty).count() == 0


def test_mirror_playlist(spark):
    t = spark.createDataFrame([track(1, artist="The Xylo Band", title="Night Drive (Mix)"), track(2, artist="Xylo", title="Night"), track(3), track(4, artist="ab", title="cd")], TRACK)
    rows = [(10, "xylo", " night "), (11, "", "drive"), (12, "zz", "night"), (13, "A", "c"), (14, "Xylo", "NIGHT")]
    r = spark.createDataFrame(rows, "row_id bigint, artist string, title string")

    def brute(rows):
        out = {}
        for o, a, ti in ((1, "the xylo band", "night drive (mix)"), (2, "xylo", "night"), (3, "", ""), (4, "ab", "cd")):
            hit = [i for i, x, y in rows if x.strip().lower() in a and y.strip().lower() in ti]
            if hit:
                out[o] = min(hit)
        return out

    assert {x.ord: x.first_row for x in matching.mirror_playlist(r, t).collect()} == brute(rows)
    blank = [(1, "", "")]
    assert {x.ord: x.first_row for x in matching.mirror_playlist(spark.createDataFrame(blank, "row_id bigint, artist string, title string"), t).collect()} == brute(blank)


def walk(b, mode, drift, bars):
    def tempo(x):
        g = np.diff(x)
        return 60.0 / np.median(g) if len(g) and np.median(g) > 0 else 0.0

    w = max(4, 4 * bars)
    if mode == "fixed" or tempo(b) <= 0:
        return [(0.0, max(tempo(b), 0.0))]
    out, start, seg = [], 0, tempo(b[: min(len(b), w)])
    for i in range(w, len(b)):
        local = tempo(b[max(0, i - w) : i])
        if seg > 0 and abs(local - seg) / seg * 100 > drift:
            out.append((b[start], seg))
            start, seg = max(0, i - w), local
    return [*out, (b[start], seg)]


@pytest.mark.parametrize("mode", ["fixed", "dynamic"])
def test_segments(spark, mode):
    rng = np.random.default_rng(9)
    series = {"/a": np.cumsum(np.concatenate([np.full(40, 0.5), np.full(40, 0.4)])), "/b": np.cumsum(rng.uniform(0.3, 0.7, 60)), "/c": np.array([1.0]), "/d": np.array([1.0, 1.0, 1.0])}
    df = spark.createDataFrame([(p, i, float(t)) for p, b in series.items() for i, t in enumerate(b)], "path string, i int, t double")
    got = timeseries.segments(df, mode, 5.0, 1).collect()
    for p, b in series.items():
        mine = [(r.start, r.bpm) for r in sorted((r for r in got if r.path == p), key=lambda r: r.segment)]
        assert np.allclose(mine, walk(b, mode, 5.0, 1)), p
    assert timeseries.segments(df.limit(0), mode).count() == 0


def test_hot_keys_are_not_lost(spark):
    n = 3000
    t = spark.range(n).select(F.col("id").alias("ord"), F.lit("/same.mp3").alias("path"), F.lit("x").alias("artist"), F.lit("y").alias("title"), F.lit(1).alias("duration"), F.lit(0).alias("lossless"), F.lit(1).alias("bitrate"))
    assert dedupe.keep_best(dedupe.names_key(t)).count() == n - 1 and catalog.latest(t).count() == 1


def test_no_seed_no_rows(spark):
    df = spark.createDataFrame([], "label bigint, ord bigint, path string, artist string, title string, camelot string, bpm double, samples double, v array<double>")
    seed = rank.resolve_seed(df, "x")
    assert seed is None and rank.recommend(df, seed).count() == 0 and rank.discover(df, seed, rank.RankingSpec()).count() == 0
    assert rank.sequence(df, df).count() == 0 and knn.nearest_for_all(df, df, 3).count() == 0


def test_series_at_equality(spark):
    rows = [("a", i, float(x)) for i, x in enumerate((5, 1, 1, 5, 0, 5, 2))]
    s = spark.createDataFrame(rows, "path string, i int, x double")
    assert [(r.i, r.x) for r in timeseries.minima(s, 1.0, 5).orderBy("rank").collect()] == [(4, 0.0), (6, 2.0)]  # the plateau is none
    t = spark.createDataFrame([("a", 15.0, 9.0), ("a", 16.0, 3.0), ("a", 17.0, 3.0), ("b", 15.0, 2.0), ("b", 1.0, 1.0)], "path string, t double, strength double")
    assert {r.path: r.t for r in timeseries.drop_time(t).collect()} == {"a": 16.0, "b": 15.0}
    x = t.withColumnRenamed("strength", "x")
    assert {r.path: r.t for r in timeseries.first_crossing(x, 3.0).collect()} == {"a": 15.0, "b": 1.0}  # above, not at; never: the first
    assert timeseries.first_crossing(x, 9.0).where("path = 'a'").first().t == 15.0


def test_exact_mean(spark):
    from cratewave.functions.scores import exact_mean

    df = spark.createDataFrame([("h", 0.522212), ("h", 0.522213), ("n", None), ("one", 0.1)], "k string, x double")
    assert {r.k: r.m for r in df.groupBy("k").agg(exact_mean(F.col("x")).alias("m")).collect()} == {"h": 0.522213, "n": None, "one": 0.1}


def test_scores_stay_in_their_batch(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0], 0.5), ("b", [0.0, 1.0], 0.5), ("c", [0.6, 0.8], 0.9)], "tag string, centroid array<double>, threshold double")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "ord bigint, v array<double>")
    assert [(r.ord, r.rank, r.tag) for r in tags.suggest(rows, p).orderBy("ord", "rank").collect()] == [(1, 1, "a"), (2, 1, "b")]
    assert "Exchange" not in tags.suggest(rows, p)._jdf.queryExecution().executedPlan().toString()
    for strategy in tags.STRATEGIES:
        short, long = tags.least_clear(rows, p, strategy).collect(), tags.uncertainty(tags.scored(rows, p), strategy).collect()
        assert [(r.ord, r.top_tags, r.reason) for r in short] == [(r.ord, r.top_tags, r.reason) for r in long]
    assert tags.least_clear(rows, p).where("ord = 1").first().reason == "I'm 100% sure it's 'a' but 60% sure it's 'c'. Which is it?"
    assert tags.bootstrap(rows, p, "c", 1).first().ord == 2 and tags.bootstrap(rows, p, "none").count() == 0
    assert [(r.ord, r.tag) for r in tags.near_threshold(rows, p, 0.11).orderBy("ord").collect()] == [(2, "c")]


def test_intermediate_tables(spark):
    from cratewave.storage import discard, materialize

    t = materialize(spark.range(3), "gone")
    discard(t, None)
    import os

    assert not os.path.exists(t._table_path.removeprefix("file://"))


def test_short_texts_name_tracks(spark):
    t = spark.createDataFrame([(1, "Abba", "SOS"), (2, "X", None), (3, None, "So")], "ord bigint, artist string, title string")
    for rows, want in (([(1, "x", "")], {2: 1}), ([(1, "b", "o")], {1: 1}), ([(1, None, "so"), (2, "", "os")], {1: 1, 3: 1}), ([(4, None, " "), (5, "", "sos")], {1: 4, 2: 4, 3: 4}), ([], {})):
        r = spark.createDataFrame(rows, "row_id bigint, artist string, title string")
        assert {x.ord: x.first_row for x in matching.mirror_playlist(r, t).collect()} == want
