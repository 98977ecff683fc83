"""Property checks: typed value -> untidy text (every quirk the files show) -> cleaner
gives the value back. One Spark job per generated batch."""

import datetime as dt
import decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from cartwise.functions import clean as C

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
PADS = ["", " ", "  ", "\t", " ", "　 "]

ints = st.tuples(st.integers(0, 2**40), st.sampled_from(PADS), st.sampled_from(PADS),
                 st.integers(0, 6))
money = st.tuples(st.decimals(min_value=0, max_value=99999999, places=2, allow_nan=False),
                  st.sampled_from(PADS), st.booleans())
dates = st.tuples(st.dates(dt.date(1970, 1, 1), dt.date(2069, 12, 31)), st.sampled_from(PADS),
                  st.booleans(), st.booleans())


def int_text(v, left, right, zeros):
    return f"{left}{'0' * zeros}{v}{right}"


def money_text(v, pad, drop_zero):
    s = f"{v:.2f}"
    if drop_zero and s.startswith("0."):
        s = s[1:]
    return f"{pad}{s}"


def date_text(d, pad, lower, short_day):
    day = str(d.day) if short_day else f"{d.day:02d}"
    mon = MONTHS[d.month - 1]
    return f"{pad}{day}-{mon.lower() if lower else mon}-{d.year % 100:02d}{pad}"


@settings(max_examples=4, deadline=None)
@given(st.lists(ints, min_size=1, max_size=40), st.lists(money, min_size=1, max_size=40),
       st.lists(dates, min_size=1, max_size=40))
def test_roundtrip(spark, i_vals, m_vals, d_vals):
    n = max(len(i_vals), len(m_vals), len(d_vals))
    rows = []
    for k in range(n):
        iv = i_vals[k % len(i_vals)]
        mv = m_vals[k % len(m_vals)]
        dv = d_vals[k % len(d_vals)]
        rows.append((int_text(*iv), money_text(*mv), date_text(*dv)))
    df = spark.createDataFrame(rows, "i string, m string, d string")
    got = df.select(C.parse_int("i"), C.parse_money("m"), C.parse_oracle_date("d")).collect()
    for k, (gi, gm, gd) in enumerate(got):
        assert gi == i_vals[k % len(i_vals)][0]
        assert gm == decimal.Decimal(m_vals[k % len(m_vals)][0]).quantize(decimal.Decimal("0.01"))
        assert gd == d_vals[k % len(d_vals)][0]
