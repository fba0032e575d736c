"""Term table, dated readings and the bundle's newer sets."""

import datetime as dt
import json

import pytest

from fixwright.plans import bundle
from fixwright.sources import terms


def test_terms_are_read_from_one_array(spark, tmp_path):
    path = tmp_path / "terms.json"
    path.write_text(json.dumps([
        {"vendor": "a", "tenor_years": 1, "price_ratio": 0.6, "source_url": "u", "as_of": "2026-01-02", "note": "n"},
        {"vendor": "a", "tenor_years": 3, "price_ratio": 0.4},
    ]))
    rows = terms.read_terms(spark, str(path)).orderBy("tenor_years").collect()
    assert [(r.vendor, r.tenor_years, r.price_ratio, r.as_of) for r in rows] == [("a", 1.0, 0.6, dt.date(2026, 1, 2)), ("a", 3.0, 0.4, None)]


def test_readings_are_dated_and_kept(spark, tmp_path):
    root = str(tmp_path)
    curve = lambda x, gone: spark.createDataFrame(
        [("1m", "2026-10-01", x, False, []), ("1y", None, None, gone, ["too thin"])],
        "tenor string, settles string, expected double, withheld boolean, refusals array<string>",
    )
    terms.write_reading(curve(2.5, True), root, "2026-09-01T10:00:00", 0.25)
    terms.write_reading(curve(2.7, True), root, "2026-09-02T10:00:00", 0.25)
    with pytest.raises(Exception, match="(?i)exist"):
        terms.write_reading(curve(9.9, False), root, "2026-09-02T11:00:00", 0.25)
    assert terms.read_readings(spark, root).count() == 2
    points = spark.createDataFrame([("a", 1.0, 0.6), ("a", 3.0, 0.4)], "vendor string, tenor_years double, price_ratio double")
    quotes = spark.createDataFrame([("x", 6, 2.52), ("x", 12, 2.30)], "curve string, tenor int, rate double")
    sets = bundle.forward(points, terms.read_readings(spark, root), quotes)
    ladders = {r.tenor: r for r in sets["forward_implied"].collect()}
    assert ladders["1m"].expected == 2.7 and ladders["1y"].withheld and ladders["1y"].refusals == ["too thin"]
    assert sets["forward_band"].count() == 6 and sets["forward_strip"].count() == 2 and sets["forward_consistency"].count() == 1
