"""Preparation, cleaning, joins, profiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenc.functions import cleaning as C
from tenc.operators import prepare as P
from tenc.operators import profile, relate
from tenc.operators.rank import first_by_hash, hash_cuts, hash_position


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"), [("7", 7), (" 7 ", 7), ("-12", -12), ("3.5", None), ("x", None), (None, None)]
)
def test_lenient_int_of_text(spark, value, expected):
    assert one(spark, value, "string", C.lenient_int) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [(7.9, 7), (-3.7, -3), (math.nan, None), (math.inf, None), (None, None), (1e300, None)],
)
def test_lenient_int_of_numbers(spark, value, expected):
    assert one(spark, value, "double", lambda c: C.lenient_int(c, "double")) == expected


def test_cleaning_expressions(spark):
    assert one(spark, "a b", "string", lambda c: C.replace_text(c, {" ": " "})) == "a b"
    assert one(spark, "(none assigned)", "string", lambda c: C.sentinel_to_null(c, ["(none assigned)"])) is None
    assert one(spark, "70%", "string", C.without_last_character) == 70.0
    assert one(spark, "1,234", "string", lambda c: F.ln(C.number_with_separators(c))) == pytest.approx(math.log(1234))
    assert one(spark, "09/22/1986", "string", C.year_of) == 1986
    assert one(spark, "tomorrow", "string", C.year_of) is None
    assert one(spark, "PrivacySuppressed", "string", lambda c: C.int_unless_containing(c, "Privacy")) is None
    assert one(spark, "30500", "string", lambda c: C.int_unless_containing(c, "Privacy")) == 30500
    assert one(spark, None, "string", C.normalise_text) == " nan "
    assert one(spark, 0.0, "double", C.log_shifted) == pytest.approx(math.log(1e-10))


def test_strict_dates_raise(spark):
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        one(spark, "tomorrow", "string", lambda c: C.year_of(c, strict=True))


def test_positive_logs(spark):
    df = spark.createDataFrame([(-10.0,), (1.0,), (0.0,), (0.5,), (math.nan,), (None,)], "v double")
    assert [r.t for r in C.keep_positive_log(df, "v", "t").collect()] == pytest.approx([math.log(10)])


def test_filters_keep_missing_values(spark):
    df = spark.createDataFrame([(3,), (None,), (2,)], "v int")
    assert {r.v for r in df.where(C.differs_from(F.col("v"), 3)).collect()} == {None, 2}


def test_recode_keeps_or_drops_unmapped(spark):
    df = spark.createDataFrame([(20,), (99,)], "v int")
    assert [r[0] for r in df.select(C.recode(F.col("v"), {20: "old"})).collect()] == ["old", "99"]
    dropped = df.select(C.recode(F.col("v"), {20: "old"}, keep_unmapped=False))
    assert [r[0] for r in dropped.collect()] == ["old", None]


ROLES = {"gone": "Delete", "num": "Numerical", "cat": "Special", "y": "y"}


def test_preparation_order(spark):
    rows = [(1, "q", 1.0, "Ab", 1.0), (2, "q", None, "b", 0.0), (3, "q", 2.0, None, 1.0), (4, "q", 3.0, "C", None)]
    df = spark.createDataFrame(rows, "k long, gone string, num double, cat string, y double")
    with pytest.warns(UserWarning) as caught:
        out = P.prepare(df, ROLES, "k")
    assert sum("are missing" in str(w.message) for w in caught) == 3
    kept = [(r.num, r.cat, r.y) for r in out.orderBy("k").collect()]
    assert kept == [(1.0, " ab ", 1.0), (2.0, " na ", 1.0)]
    raw = P.prepare(df, ROLES, "k", normalise=False, check_missing=False, n_rows=1, shuffle=True)
    assert raw.count() == 1 and "row_pos" in raw.columns


def test_roles():
    columns = P.resolve_roles({**ROLES, "more": "Special"})
    assert columns.features == ("num", "cat", "more")
    assert columns.target == "y" and columns.special == "cat"
    with pytest.raises(ValueError):
        P.resolve_roles({"a": "Special"})


def test_missing_share_at_the_limit_is_no_warning(spark):
    df = spark.range(20).select(F.when(F.col("id") >= 3, F.col("id")).alias("v"))
    row = P.missing_fractions(df, ["v"]).first()
    assert row.fraction == pytest.approx(0.15) and not row.exceeds


def test_nan_counts_as_missing_when_dropping(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "v double")
    assert P.drop_missing(df, ["v"]).count() == 1


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))


def test_positions_equal_a_plain_ranking(spark, numbered, monkeypatch):
    from tenc.operators import rank

    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", 50)
    found = {r.k: r.row_pos for r in hash_position(numbered, "k").collect()}
    import hashlib

    plain = sorted(found, key=lambda k: hashlib.md5(f"{k}|5".encode()).hexdigest())
    assert [found[k] for k in plain] == list(range(1, 20_001))


@pytest.mark.parametrize("n", [1, 2, 777, 19_999])
def test_sample_size_is_exact_and_stable(numbered, n):
    first = {r.k for r in first_by_hash(numbered, "k", n).collect()}
    again = {r.k for r in first_by_hash(numbered.repartition(5, "g"), "k", n).collect()}
    assert len(first) == n and first == again


def test_sample_larger_than_the_table(numbered):
    assert first_by_hash(numbered, "k", 30_000).count() == 20_000
    assert first_by_hash(numbered, "k", 0).count() == 0


def test_cuts_far_from_their_expected_place(spark):
    """Hashes that are not uniform at all: the window has to grow."""
    rows = [(0, f"ffff{i:028x}") for i in range(500)]
    df = spark.createDataFrame(rows, "g int, _hash string")
    sizes = spark.createDataFrame([(0, 500, 100)], "g int, n long, take long")
    assert hash_cuts(df, ["g"], sizes).first()["cut"] == rows[99][1]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None)], "k string, o int, v string")
    out = {(r.k, r.o, r.v) for r in relate.first_per_key(df, ["k"], "o").collect()}
    assert out == {("a", 1, "y"), ("b", 2, None)}


def test_suffixed_join(spark):
    left = spark.createDataFrame([(1, "l"), (2, "m"), (1, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "r", "p"), (1, "s", None)], "k int, v string, w string")
    out = relate.left_join_suffixed(left, right, ["k"], "_l", "_r")
    assert out.columns == ["k", "v_l", "v_r", "w"] and out.count() == 5
    kept = relate.left_join_suffixed(left, right, ["k"], "_l", "_r", ["w"])
    assert kept.count() == 2
    assert "LeftOuter" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_profile_worked_values(spark):
    df = spark.createDataFrame([("a",)] * 20 + [("b",)] * 3 + [("c",)], "c string")
    row = profile.category_profile(df, ["c"]).first()
    assert (row.n_rows, row.n_categories, row.n_most_frequent) == (24, 3, 20)
    assert (row.n_median, row.n_under_mean5) == (3.0, 1)


def test_rank_curve_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(profile, "_CHUNK", 3)
    df = spark.createDataFrame([(i,) for i in range(10)] + [(0,), (0,), (1,)], "c int")
    rows = profile.rank_frequency(df, ["c"]).orderBy("rank").collect()
    assert [(r["rank"], r.n) for r in rows] == list(enumerate([3, 2] + [1] * 8, start=1))


@pytest.mark.parametrize("k", [1, 2, 3, 17, 1000, 2500])
def test_resampled_curve_equals_interpolation(spark, k):
    df = spark.range(k).select("id", F.explode(F.sequence(F.lit(1), (F.col("id") % 9 + 1))).alias("_"))
    rows = profile.rank_frequency_resampled(df.select("id"), ["id"], 101).orderBy("point").collect()
    counts = sorted((i % 9 + 1 for i in range(k)), reverse=True)
    at = np.linspace(0, 1, 101)
    expected = np.interp(at, np.linspace(0, 1, k), counts) if k > 1 else [counts[0]] * 101
    assert [r.point for r in rows] == list(range(101))
    assert [r.frequency for r in rows] == pytest.approx(list(expected))


def test_target_kinds(spark):
    kind = lambda values, t: profile.target_kind(spark.createDataFrame([(v,) for v in values], f"y {t}"), "y").first().kind
    assert kind([0.0, 1.0, 1.0], "double") == "binary"
    assert kind([0.0, 1.0, 2.0], "double") == "multiclass"
    assert kind([0.5, 1.0], "double") == "continuous"
    assert kind(["a", "b", "c"], "string") == "multiclass"
