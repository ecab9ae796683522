from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from stagewise.functions import age_label, age_sort_key, as_text, hour_segment, mean, pct, pct_capped, pct_sql


def _ref_pct(n: int, d: int, scale: int) -> Decimal | None:
    """n / d * 100 rounded half away from zero, by exact rational arithmetic."""
    if d == 0:
        return None
    num = n * 100 * 10**scale
    sign = -1 if num < 0 else 1
    r = (2 * abs(num) + d) // (2 * d)
    return (Decimal(sign * r) / Decimal(10**scale)).quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)


@settings(max_examples=25, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(-10**9, 10**9), st.integers(0, 10**9)),
        min_size=1,
        max_size=40,
    )
)
def test_pct_matches_exact_rational_rounding(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", pct("n", "d", 2).alias("p2"), pct("n", "d", 1).alias("p1")).collect()
    for r in got:
        assert r.p2 == _ref_pct(r.n, r.d, 2)
        assert r.p1 == _ref_pct(r.n, r.d, 1)


def test_pct_ties_round_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (1, 3), (2, 3), (1, 0), (None, 5), (5, None)], "n long, d long")
    rows = df.select(pct("n", "d", 1).alias("p")).collect()
    assert [r.p for r in rows] == [Decimal("12.5"), Decimal("-12.5"), Decimal("33.3"), Decimal("66.7"), None, None, None]
    rows = df.select(pct("n", "d", 2).alias("p")).collect()
    assert rows[0].p == Decimal("12.50")
    # 1/8*100 = 12.5 exactly; at 0 places it rounds up
    assert df.select(pct("n", "d", 0).alias("p")).first().p == Decimal("13")


def test_pct_capped_and_text(spark):
    df = spark.createDataFrame([(5, 4), (3, 4), (3, None), (0, 0)], "n long, d long")
    rows = df.select(
        pct_capped("n", "d", 2, 100).alias("c"), as_text(pct_sql("n", "d", 2)).alias("t")
    ).collect()
    assert [r.c for r in rows] == [Decimal("100.00"), Decimal("75.00"), Decimal("100.00"), Decimal("100.00")]
    assert [r.t for r in rows] == ["125.00%", "75.00%", "%", "%"]


def test_mean(spark):
    df = spark.createDataFrame([(1788, 8), (1397, 6), (7, 0)], "s long, n long")
    assert [r.m for r in df.select(mean("s", "n", 2).alias("m")).collect()] == [
        Decimal("223.50"),
        Decimal("232.83"),
        None,
    ]


def test_age_label_and_sort(spark):
    df = spark.createDataFrame([("18-24",), ("None",), (None,), ("Unknown",), ("55-64",)], "a string")
    rows = df.select(age_label("a").alias("l")).select("l", age_sort_key("l").alias("k")).collect()
    assert [(r.l, r.k) for r in rows] == [
        ("18-24", 18),
        ("GDPR data", 100),
        ("GDPR data", 100),
        ("Unknown", None),
        ("55-64", 55),
    ]


def test_hour_segments_first_match_wins(spark):
    df = spark.createDataFrame([(h,) for h in [0, 7, 8, 9, 10, 15, 16, 19, 20, 23, None]], "h int")
    labels = [r.s for r in df.select(hour_segment("h").alias("s")).collect()]
    assert labels[0] == labels[1] == "Morning-(0:00 - 7:00 hours) Less rush"
    assert labels[2] == labels[3] == "Morning-(8:00 - 9:00 hours) peak hours"
    assert labels[4] == labels[5] == "Afternoon-(10:00 - 15:00 hours) moderate rush"
    assert labels[6] == labels[7] == "Evening-(16:00 - 19:00 hours) Heavy rush"
    assert labels[8] == labels[9] == labels[10] == "Late Evening-(19:00 - 00:00 hours) Casual rides"
