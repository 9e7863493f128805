from __future__ import annotations

import math
import random
from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from scorewright.functions import dates, distributions, numbers, text


@pytest.mark.parametrize(
    ("raw", "parsed"),
    [
        ("3/22/99", date(1999, 3, 22)),
        ("8/2/39", date(2039, 8, 2)),
        ("1/2/70", date(1970, 1, 2)),
        ("1/2/69", date(2069, 1, 2)),
        ("1/2/2019", date(2019, 1, 2)),
        ("01/05/19", date(2019, 1, 5)),
        ("2/29/2020", date(2020, 2, 29)),
        ("2/29/2019", None),
        ("19/24/2019", None),
        ("1/2 x/19", None),
        ("1/2T/19", None),
        ("1/2/019", None),
        ("1/2/20190", None),
        ("1/2/19/3", None),
        ("2019", None),
        ("x", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_month_day_year(spark, raw, parsed):
    frame = spark.createDataFrame([(raw,)], "d string")
    assert frame.select(dates.parse_month_day_year("d")).first()[0] == parsed


def _python_date(text):
    parts = text.split("/")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        return None
    month, day, year = parts
    if not (len(month) <= 2 and len(day) <= 2 and len(year) in (2, 4)):
        return None
    century = "" if len(year) == 4 else "19" if year >= "70" else "20"
    try:
        return date(int(century + year), int(month), int(day))
    except ValueError:
        return None


def test_parse_random_dates(spark):
    rng = random.Random(3)
    pick = lambda *choices: rng.choice(choices)
    texts = [
        f"{pick('', '0', ' ') if rng.random() < 0.1 else ''}{rng.randint(0, 14)}{pick('/', '/', '/', '-')}"
        f"{rng.randint(0, 33)}/{pick(rng.randint(0, 99), rng.randint(1900, 2100), f'{rng.randint(0, 99):02}')}"
        for _ in range(4000)
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "d string")
    rows = frame.select("d", dates.parse_month_day_year("d").alias("parsed")).collect()
    assert sum(r["parsed"] is not None for r in rows) > 1000
    assert [(r["d"], r["parsed"]) for r in rows] == [(r["d"], _python_date(r["d"])) for r in rows]


def test_seasons(spark):
    frame = spark.sql("select make_date(2019, id, 15) as d from range(1, 13) t(id)")
    plain = [r[0] for r in frame.orderBy("d").select(dates.season(F.col("d"))).collect()]
    assert plain == (
        ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["fall"] * 3 + ["winter"]
    )
    label = frame.orderBy("d").select(dates.day_label(F.col("d"))).first()[0]
    assert label == "01-15"


def test_text_helpers(spark):
    frame = spark.createDataFrame(
        [("ab ", '"732"'), ('cd"', "2006??"), ("ef", "-12"), ("gh", "5")], "id string, p string"
    )
    rows = frame.select(
        text.show_spaces(F.col("id")),
        text.strip_chars(F.col("id"), text.ID_DIRT),
        text.strip_chars(F.col("p"), text.SCORE_DIRT).cast("int"),
        text.has_illegal_chars(F.col("p")),
        text.truncate(F.col("id"), 1),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("ab\\s", "ab", 732, True, "a"),
        ('cd"', "cd", 2006, True, "c"),
        ("ef", "ef", -12, False, "e"),
        ("gh", "gh", 5, False, "g"),
    ]


def test_rounding_is_half_up_on_the_true_quotient(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    lit = F.lit
    assert one(numbers.ratio(lit(201), lit(200), 2)) == 1.01
    assert one(numbers.ratio(lit(-201), lit(200), 2)) == -1.01
    assert one(numbers.ratio(lit(147), lit(365), 4)) == 0.4027
    assert one(numbers.percent(lit(980), lit(1100), 2)) == 89.09
    assert one(numbers.percent(lit(147), lit(365), 2)) == 40.27
    assert one(numbers.percent(lit(795), lit(980), 2)) == 81.12
    assert one(numbers.ratio(lit(9 * 10**15), lit(7), 4)) == round(9 * 10**15 / 7, 4)
    assert one(numbers.scaled(lit(506_176))) == 5.06


def test_normal_quantile(spark):
    points = [1e-12, 1e-6, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.6, 0.925, 0.999, 1 - 1e-9]
    frame = spark.createDataFrame([(p,) for p in points], "p double")
    rows = distributions.with_normal_quantile(frame, F.col("p"), "z").collect()
    for row in rows:
        assert math.isclose(row["z"], NormalDist().inv_cdf(row["p"]), rel_tol=1e-12, abs_tol=1e-13)


def test_tails_match_tables():
    close = lambda a, b: math.isclose(a, b, rel_tol=1e-6)
    assert close(distributions.t_two_sided(2.228138852, 10), 0.05)
    assert close(distributions.t_two_sided(-12.706204736, 1), 0.05)
    assert close(distributions.t_quantile(0.975, 10), 2.228138852)
    assert close(distributions.t_quantile(0.975, 1), 12.706204736)
    assert close(distributions.t_quantile(0.995, 30), 2.749995654)
    assert close(distributions.f_upper(4.102821015, 2, 10), 0.05)
    assert close(distributions.f_upper(3.325834530, 5, 10), 0.05)
    assert close(distributions.chi2_upper(3.841458821, 1), 0.05)
    assert close(distributions.chi2_upper(18.307038053, 10), 0.05)
    # Two degrees of freedom have the tail exp(-x / 2), however far out.
    for x in (0.1, 5.0, 61.0, 63.0, 200.0, 1000.0):
        assert close(distributions.chi2_upper(x, 2), math.exp(-x / 2))
    # Two numerator degrees of freedom have a closed tail as well.
    for f in (0.5, 3.0, 50.0):
        assert close(distributions.f_upper(f, 2, 997), (997 / (997 + 2 * f)) ** 498.5)
