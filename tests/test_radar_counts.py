"""Counts by score are over all rated symbols, not over the listed ones alone."""

from tapewright.plans import desks


def test_counts_go_beyond_the_list(spark, monkeypatch):
    n = 450
    panel = spark.range(n).selectExpr("concat('Brand#', lpad(id, 3, '0')) symbol", "-0.7D dd_ath", "2.0D volreg", "0.4D ret6", "0.1D ret3", "0.5D ret12", "100.0D turn20", "200 bars", "10.0D price")
    shares, sector = panel.selectExpr("symbol", "1e8D shares"), panel.selectExpr("symbol", "'1' sector")
    held = spark.createDataFrame([], "symbol string, date date, promoter_pct double")
    monkeypatch.setattr(desks, "radar_inputs", lambda *_: (panel, shares, sector, held, panel.select("symbol").limit(0)))
    monkeypatch.setattr(desks.R, "measures", lambda p: p)
    assert desks.radar_list(spark, "").count() == 400
    assert [r["n"] for r in desks.radar_counts(spark, "").collect()] == [n]
