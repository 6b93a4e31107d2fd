"""Walk-forward queries forecast every season that has an earlier one."""

import pytest

from fieldglass import registry
from fieldglass.operators import boosting, models
from fieldglass.plans import models as plans

COLUMNS = "Season int, strength double, offense double, defense double, y int"


def league(spark, seasons):
    rows = [(s, float(i % 5 - 2), float(i % 3), float(i % 7), int(i % 5 + i % 2 > 2)) for s in seasons for i in range(30)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name", ["walk_forward_logistic", "walk_forward_boosted"])
def test_all_seasons_but_the_first_are_forecast(spark, monkeypatch, name):
    df = league(spark, [1997, 1998, 1999, 2001]).selectExpr("*", "'M' as Gender", "1 as GameNo")
    monkeypatch.setattr(plans, "matrix", lambda spark, d: df)
    got = {(r.Season, r["count"]) for r in registry.queries()[name](spark, "").groupBy("Season").count().collect()}
    assert got == {(1998, 30), (1999, 30), (2001, 30)}


@pytest.mark.parametrize("walk", [models.walk_forward, boosting.walk_forward_boosted])
@pytest.mark.parametrize("seasons", [[], [1997]])
def test_no_rows_where_no_season_has_an_earlier_one(spark, seasons, walk):
    df = league(spark, seasons)
    got = walk(df, plans.FEATURES, "Season")
    assert got.columns == [*df.columns, "p"] and got.count() == 0
