"""Dense numbers, line ids and pages: same answers whatever the partitions, and no row passes one task."""

import contextlib
import hashlib
import io
import random

import pytest

from cartwise.operators import numbering as N
from cartwise.operators import pull as P
from cartwise.session import stage

LINE = ["hshd_num", "basket_num", "spend"]


def formatted_plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def lines(spark):
    """A household with most of the lines, one basket with many, equal lines."""
    rng = random.Random(6)
    rows = [(10 if rng.random() < 0.7 else rng.randrange(30), rng.randrange(40), str(rng.randrange(25))) for _ in range(4000)]
    rows += [(10, 7, "3")] * 300
    return spark.createDataFrame(rows, "hshd_num long, basket_num long, spend string"), rows


def test_dense_index(spark, lines):
    df, rows = lines
    for parts in (1, 3, 11):
        items = df.select("spend").distinct().repartition(parts)
        got = {r["spend"]: r["index"] for r in N.dense_index(items, ["spend"]).collect()}
        assert got == {s: i for i, s in enumerate(sorted({r[2] for r in rows}))}
    assert N.dense_index(df.limit(0), ["spend"]).count() == 0


def test_line_ids_depend_on_the_lines_alone(spark, lines):
    df, rows = lines
    seen, want = {}, set()
    for r in rows:
        seen[r] = seen.get(r, 0) + 1
        want.add(hashlib.md5("|".join([*map(str, r), str(seen[r])]).encode()).hexdigest())
    for parts, ranges in ((1, 4), (9, 1), (5, 13)):
        ids = [r["line_id"] for r in N.with_line_id(df.repartition(parts), LINE, ranges).select("line_id").collect()]
        assert len(ids) == len(rows) and set(ids) == want


@pytest.mark.parametrize("ranges", [1, 6])
def test_pages_are_seeks(spark, lines, ranges):
    df, rows = lines
    stored = stage(N.in_ranges(df, LINE, ranges), "test-pages")
    index = stage(P.page_index(stored), "test-index")
    own = sorted(r for r in rows if r[0] == 10)
    for page, size in ((1, 50), (2, 50), (len(own) // 50 + 1, 50), (17, 200), (3, 7), (10_000, 50)):
        got = [tuple(r)[:3] for r in P.read_page(stored, index, 10, page, size).collect()]
        assert got == own[(page - 1) * size:page * size]
    assert P.read_page(stored, index, 999, 1, 50).count() == 0


def test_page_plan_reads_by_place(spark, lines):
    """A far page: the scan is filtered by range and place, and nothing but the page is sorted."""
    df, _ = lines
    stored = stage(N.in_ranges(df, LINE, 4), "test-pages")
    index = stage(P.page_index(stored), "test-index")
    plan = formatted_plan(P.read_page(stored, index, 10, 40, 50))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "_pos" in pushed and "_part" in pushed and "EqualTo(hshd_num,10)" in pushed
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan
