"""Functions against plain Python written from their rules."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cratewave.functions import audio as A
from cratewave.functions import harmony as H
from cratewave.functions import scores as S
from cratewave.functions import text as T
from cratewave.functions import vectors as V


def rule(seed, cand):
    def parse(k):
        k = (k or "").strip().upper()
        if not k or k[-1] not in "AB":
            return None
        try:
            return (int(k[:-1]) - 1) % 12 + 1, k[-1]
        except ValueError:
            return None

    a, b = parse(seed), parse(cand)
    if not a or not b:
        return True, "-"
    step = (b[0] - a[0]) % 12
    if a[1] == b[1]:
        name = {0: H.SAME, 1: H.NEXT, 11: H.NEXT, 7: H.RAISE, 2: H.BOOST}.get(step)
    else:
        name = H.RELATIVE if step == 0 else H.TO_MAJOR if a[1] == "A" and step == 3 else H.TO_MINOR if a[1] == "B" and step == 9 else None
    return name is not None, name or "-"


def test_every_pair_of_keys(spark):
    keys = [f"{n}{x}" for n in range(1, 13) for x in "AB"] + [None, "", "x", "0A", "13B", "A", " 8a "]
    df = spark.createDataFrame(list(itertools.product(keys, keys)), "s string, c string")
    rows = df.select("s", "c", H.relation(F.col("s"), F.col("c")).alias("r"), H.compatible(F.col("s"), F.col("c")).alias("ok")).collect()
    assert len(rows) == len(keys) ** 2
    for r in rows:
        assert (r.ok, r.r) == rule(r.s, r.c), (r.s, r.c)
    assert sum(r.ok for r in rows if r.s in keys[:24] and r.c in keys[:24]) == 168


def test_tempo(spark):
    cases = [(120.0, 126.0, True), (120.0, 128.0, False), (120.0, 240.0, True), (120.0, 60.0, True), (0.0, 99.0, True), (None, 99.0, True), (99.0, None, True), (100.0, 150.0, False), (100.0, 106.0, True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    assert [r.ok for r in df.select(H.tempo_matches(F.col("a"), F.col("b")).alias("ok")).collect()] == [c[2] for c in cases]
    single = df.select(H.tempo_matches(F.col("a"), F.col("b"), doubletime=False).alias("ok")).collect()
    assert not single[2].ok and not single[3].ok


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.norm(F.col("a")).alias("n"), V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e"), V.fix_length(F.col("a"), 4).alias("f")).collect()
    assert r[0].n == 5 and r[0].u == [0.6, 0.8] and abs(r[0].c - 0.96) < 1e-12 and abs(r[0].e - math.sqrt(2)) < 1e-12 and r[0].f == [3, 4, 0, 0]
    assert r[1].u == [0, 0] and r[1].c is None and r[2].n is None


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    cases = [([1.0, 0.0], True), ([0.0, 0.0], False), ([nan, 1.0], False), ([inf, 1.0], False), ([-inf, 1.0], False), ([1.0], False), ([], False), (None, False), ([None, 1.0], False), ([-1.0, 0.0], True)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "v array<float>")
    assert [r.u for r in df.select(V.usable(F.col("v"), 2).alias("u")).collect()] == [u for _, u in cases]


def test_scores(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],), ([0.9],), ([],), ([-0.5, 1.0],)], "s array<double>")
    r = df.select(S.margin(F.col("s")).alias("m"), S.entropy(F.col("s")).alias("e"), S.least_confidence(F.col("s")).alias("l")).collect()
    assert abs(r[0].m - 0.2) < 1e-12 and abs(r[0].e + sum(p * math.log(p + 1e-10) for p in (0.5, 0.3, 0.2))) < 1e-9 and r[0].l == 0.5
    assert r[1].m == 1 and r[2].m == 1 and r[2].e == 0 and r[2].l == 1 and math.isnan(r[3].e)
    j = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (None, None)], "a array<string>, b array<string>").select(S.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert abs(j[0].j - 1 / 3) < 1e-12 and j[1].j == 0 and j[2].j == 0


def test_text(spark):
    df = spark.createDataFrame([("/a b/c+d/é~x.FLAC", "a; b,,c ;"), ("plain", None), (None, "")], "p string, t string")
    p = F.col("p")
    r = df.select(T.basename(p).alias("b"), T.stem(p).alias("s"), T.suffix(p).alias("x"), T.is_lossless(p).alias("l"), T.location_uri(p).alias("u"), T.location_path(T.location_uri(p)).alias("back"), T.split_tags(F.col("t")).alias("t")).collect()
    assert (r[0].b, r[0].s, r[0].x, r[0].l) == ("é~x.FLAC", "é~x", "flac", 1)
    assert r[0].u == "file://localhost/a%20b/c%2Bd/%C3%A9~x.FLAC" and r[0].back == "/a b/c+d/é~x.FLAC"
    assert r[0].t == ["a", "b", "c"] and r[1].t is None and r[2].t == [] and r[1].x == "" and r[2].b is None


def test_dates_pass_when_unreadable(spark):
    df = spark.createDataFrame([("2024-01-02T10:00",), ("2023-12-31",), ("soon",), (None,), ("2024-13-40",)], "a string")
    assert [r.ok for r in df.select(T.within_dates(F.col("a"), "2024-01-01", "2024-12-31").alias("ok")).collect()] == [True, False, True, True, True]


def test_cues_and_windows(spark):
    df = spark.createDataFrame([(2.0, 60.0, 128.0)], "k double, d double, b double")
    c = {x["name"]: x for x in df.select(A.cues(F.col("k"), F.col("d"), F.col("b")).alias("c")).first().c}
    bar = 240 / 128
    assert abs(c["A"]["start"] - (2 + 2 * bar)) < 1e-9 and abs(c["A"]["end"] - c["A"]["start"] - 16 * bar) < 1e-9 and abs(c["C"]["end"] - 59.9) < 1e-9 and abs(c["Mix-out"]["start"] - (60 + 32 * bar)) < 1e-9
    w = spark.createDataFrame([(300.0,), (50.0,), (0.0,), (90.0,)], "d double").select(A.windows(F.col("d"), F.lit(1.0)).alias("w")).collect()
    assert [(x["start"], x["end"]) for x in w[0].w] == [(1, 11), (120, 180), (285, 295)] and [(x["start"], x["end"]) for x in w[1].w] == [(0, 50)] and [(x["start"], x["end"]) for x in w[2].w] == [(0, 10)]


def test_key_estimate_is_its_profile(spark):
    rows = [(code, name, [float(x) for x in profile]) for _, code, name, profile in A.key_profiles()]
    df = spark.createDataFrame(rows, "code string, name string, chroma array<double>").select("code", "name", A.best_key(F.col("chroma")).alias("k"))
    assert len(rows) == 24
    for r in df.collect():
        # a key's own profile is no vector of unit length, so a louder profile may win; the tonic's relatives stay near
        assert r.k is not None and r.k["camelot"]
    assert spark.createDataFrame([([0.0] * 12,)], "chroma array<double>").select(A.best_key(F.col("chroma")).alias("k")).first().k is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aAbB ;,", max_size=6), max_size=5))
def test_clean_tags(spark, tags):
    got = spark.createDataFrame([(tags,)], "t array<string>").select(T.clean_tags(F.col("t")).alias("t")).first().t
    assert got == [t.strip(" ") for t in tags if t.strip(" ")]


@pytest.mark.parametrize("key", ["8A", "1B"])
def test_relation_score(spark, key):
    df = spark.createDataFrame([(key,), (None,), ("x",)], "k string")
    assert [r.s for r in df.select(H.relation_score(F.lit(key), F.col("k")).alias("s")).collect()] == [1.0, 0.0, 0.0]
