"""Typed feeds, daily streams, versioned tables, keyed state, archives, document walks and dates."""

import datetime
import gzip
import io
import json
import random
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapewright.functions.dates import day_of
from tapewright.operators import desk, feeds, sessions
from tapewright.sources import archives, exchange
from tapewright.streaming import feeds as streams
from tapewright.streaming import state
from tapewright.streaming.tables import VersionedTable, merge_stream


@pytest.mark.parametrize(("text", "day"), [
    ("2024-03-05", "2024-03-05"), ("05-MAR-2024", "2024-03-05"), ("5-mar-2024 15:30:00", "2024-03-05"), ("05-03-2024", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("25/03/2024", "2024-03-25"), ("03/25/2024", "2024-03-25"),
    ("20240305", "2024-03-05"), (" 5 Mar 2024 ", "2024-03-05"), ("5.3.2024", "2024-03-05"), ("05-Mar-24", "2024-03-05"), ("2024-03-05T10:00:00", "2024-03-05"), ("31-02-2024", None), ("soon", None), ("", None), (None, None), ("2024-13-01", None),
])
def test_days(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(day_of(F.col("t"))).first()[0]
    assert (got and got.isoformat()) == day


def test_walk_is_that_of_a_parser(spark):
    rng = random.Random(2)

    def tree(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind == 3:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 4:
            return {rng.choice(["symbol", "a", "b", 'q"uote']): tree(depth - 1) for _ in range(rng.randrange(5))}
        return rng.choice(["x", 'the "symbol": "no"', "", 3, 2.5, None, True, 0, False])

    docs = [{"top": tree(5), "symbol": f"S{i}"} for i in range(60)]

    def symbols(x):
        if isinstance(x, dict):
            s = x.get("symbol")
            if s and not isinstance(s, dict | list):
                yield str(s) if s is not True else "true"
            for v in x.values():
                yield from symbols(v)
        elif isinstance(x, list):
            for v in x:
                yield from symbols(v)

    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id int, doc string")
    got = sorted((r["id"], r["symbol"]) for r in feeds.harvest(d, "doc").collect())
    assert got == sorted((i, s) for i, x in enumerate(docs) for s in symbols(x))


def table(spark, path, **more):
    schema = spark.createDataFrame([], "k string, at int, v string").schema
    return VersionedTable(spark, f"file://{path}/table", schema, ["k"], "at", **more)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, at int, v string")


def held(t):
    return {r["k"]: (r["at"], r["v"]) for r in t.read().collect()}


def test_a_table_keeps_newest_or_first(spark, tmp_path):
    for first in (False, True):
        t = table(spark, tmp_path / str(first), first=first)
        assert held(t) == {}
        t.merge(rows(spark, ("a", 1, "x"), ("b", 5, "y"), (None, 1, "z")), 0)
        t.merge(rows(spark, ("a", 2, "w"), ("b", 4, "u")), 1)
        assert held(t) == ({"a": (1, "x"), "b": (4, "u"), None: (1, "z")} if first else {"a": (2, "w"), "b": (5, "y"), None: (1, "z")})


def test_parts_grow_with_the_table(spark, tmp_path):
    t = table(spark, tmp_path, rows=50)
    for n in range(6):
        t.merge(spark.range(n * 60, n * 60 + 60).select(F.col("id").cast("string").alias("k"), F.lit(n).alias("at"), F.lit("v").alias("v")), n)
    found = t.manifest()
    assert found["parts"] >= 4 and sum(found["counts"].values()) == 360 == t.read().count()
    folders = {p.name for p in (tmp_path / "table" / "data").iterdir()}
    assert folders == {f.split("/")[1] for n in t.numbers() for f in t.manifest(n)["folders"].values()} and len(t.numbers()) == 2


@pytest.mark.parametrize("lost", ["write", "commit"])
def test_what_is_lost_before_the_commit_leaves_the_snapshot_before(spark, tmp_path, lost, monkeypatch):
    rows(spark, ("a", 1, "x"), ("b", 1, "y")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    source = lambda: streams.stream(spark, f"file://{tmp_path}/in")
    t, at = table(spark, tmp_path), f"file://{tmp_path}/checkpoint"
    merge_stream(source(), t, at)
    before = held(t)
    rows(spark, ("a", 2, "z"), ("c", 1, "w")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    with monkeypatch.context() as m:
        if lost == "commit":
            m.setattr(VersionedTable, "commit", lambda self, found: 1 / 0)
        else:
            m.setattr(VersionedTable, "write", lambda self, batch, n, whole=VersionedTable.write: (whole(self, batch, n), 1 / 0))
        with pytest.raises(StreamingQueryException):
            merge_stream(source(), t, at)
    assert held(t) == before
    merge_stream(source(), t, at)
    assert held(t) == {"a": (2, "z"), "b": (1, "y"), "c": (1, "w")}
    t.merge(rows(spark, ("a", 9, "again")), 1)  # a batch that was committed
    assert held(t)["a"] == (2, "z")


def history(spark, runs):
    rng, out = random.Random(4), []
    for run in range(runs):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(7 * run)
        out += [(run, day, f"S{i}", None if rng.random() < 0.1 else rng.uniform(0, 100)) for i in range(40) if rng.random() < 0.8]
    return spark.createDataFrame(out, "run int, asof date, symbol string, score double")


def test_deltas_arrive_run_by_run_and_after_a_restart(spark, tmp_path):
    h, at = history(spark, 12), f"file://{tmp_path}"
    with state.rocks(spark):
        for low, high in ((0, 0), (1, 6), (7, 11)):
            h.where(F.col("run").between(low, high)).write.mode("append").parquet(f"{at}/in")
            streams.drain(state.score_deltas(streams.stream(spark, f"{at}/in", h.schema)), f"{at}/out")
    got = {(r["symbol"], r["asof"]): (r["d1"], r["d5"]) for r in spark.read.parquet(f"{at}/out/table").collect()}
    of = {(r["symbol"], r["run"]): r for r in h.collect()}
    assert len(got) == len(of)
    for (s, run), r in of.items():
        ago = lambda back: None if run == 0 or r["score"] is None or (s, back) not in of or of[s, back]["score"] is None else r["score"] - of[s, back]["score"]  # noqa: B023, E731
        assert got[s, r["asof"]] == pytest.approx((ago(run - 1), ago(max(0, run - 5))))
    newest = {r["symbol"]: (r["d1"], r["d5"]) for r in desk.deltas(h.withColumns({"sector": F.lit("x"), "price": F.lit(1.0), "passes": F.lit(True)})).collect()}
    last = max(r["asof"] for r in of.values())
    for s, (d1, d5) in newest.items():
        assert (None if got[s, last][0] is None else round(got[s, last][0], 1)) == d1 and (got[s, last][1] is None) == (d5 is None)


def test_a_daily_feed_asks_for_each_day_once(spark, tmp_path):
    for d in (1, 2, 3, 5, 8, 9):
        body = {"data": [{"symbol": "A", "date": f"0{d}-JAN-2024", "purpose": "Results"}, {"symbol": "B", "date": "01-JAN-2024", "purpose": "Old"}]}
        (tmp_path / f"x_0{d}012024.json").write_text(json.dumps(body))
    url, at = f"file://{tmp_path}/x_{{day:%d%m%Y}}.json", f"file://{tmp_path}/out"
    one = streams.feed_table(streams.daily(spark, url, "2024-01-01", "2024-01-03"), "events", at)
    assert {(r["symbol"], str(r["day"]), str(r["fetched"])) for r in one.collect()} == {("A", f"2024-01-0{d}", f"2024-01-0{d}") for d in (1, 2, 3)} | {("B", "2024-01-01", "2024-01-01")}
    (tmp_path / "x_01012024.json").unlink()  # not asked for again
    two = streams.feed_table(streams.daily(spark, url, "2024-01-01", "2024-01-09"), "events", at)
    assert two.count() == 7 and two.where("symbol = 'B'").first()["fetched"] == datetime.date(2024, 1, 1)


def test_typed_feeds(spark):
    parse = lambda name, *bodies: [r.asDict() for r in exchange.parse(spark.createDataFrame([(b if isinstance(b, str) or b is None else json.dumps(b),) for b in bodies], "body string"), name).collect()]
    got = parse("insider", {"data": [{"symbol": "A", "date": None, "intimDt": "05-MAR-2024 10:00", "acqName": " X ", "secAcq": "1,250", "secVal": "-"}, {"acqName": "no symbol"}]}, "broken {", None, [{"symbol": "B", "secAcq": 7}], {"other": 1})
    assert sorted((r["symbol"], r["person"], r["shares"], r["value"], str(r["day"])) for r in got if r["symbol"] == "A") == [("A", "X", 1250.0, None, "2024-03-05")] and len(got) == 2
    deals = parse("deals", {"BULK_DEALS_DATA": [{"symbol": "A", "qty": "10"}], "BLOCK_DEALS_DATA": None, "SHORT_DEALS_DATA": [{"symbol": "B", "qty": "x"}]})
    assert {(r["symbol"], r["tag"], r["qty"]) for r in deals} == {("A", "bulk", 10.0), ("B", "short", None)}
    held = parse("shareholding", {"symbol": "A", "data": [{"date": "31-MAR-2024", "pr_and_prgrp": "51.2"}]})
    assert [(r["symbol"], str(r["day"]), r["promoter_pct"]) for r in held] == [("A", "2024-03-31", 51.2)]
    lines = exchange.statements(spark.createDataFrame([(json.dumps({"symbol": "A", "fetched": "2024-01-01", "inc_a": {"EBIT": {"2023-03-31": 5.0, "2022-03-31": None}}}),)], "body string")).collect()
    assert [(r["stmt"], r["item"], r["value"]) for r in lines] == [("inc_a", "EBIT", 5.0)]
    assert exchange.parse(spark.createDataFrame([], "body string"), "bars").count() == 0


def test_archives_are_cut_into_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("folder")
        z.writestr("folder/a.csv", 'k, v\n1,"x, ""y""\nz"\n')
        z.writestr("b.csv", "k,v\n" + "".join(f"{i},w\n" for i in range(50_000)), zipfile.ZIP_STORED)
        z.writestr("c.csv", "v\nlone\n", zipfile.ZIP_BZIP2)
        z.writestr("empty.csv", "")
        z.comment = b"a comment after the directory"
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    files = archives.contents(spark, f"file://{tmp_path}")
    assert archives.zip_members(files).count() == 4
    got = archives.zipped_csv(files, ["k", "v"], 3)
    assert got.where("member = 'folder/a.csv'").first()[2:] == ("1", 'x, "y"\nz') and got.where("member = 'c.csv'").first()[2:] == (None, "lone")
    assert got.groupBy("member").count().where("member = 'b.csv'").first()[1] == 50_000 and got.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="method"):
        archives.Inflated(b"", 99)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_bundles_are_cut_as_they_are_read(chunk):
    doc = {"built": "now, [1]", "n": 12, "neg": -1.5e3, "universe": [{"s": 'a"}]'}, 3, "x", [1, [2]]], "fundamentals": {"é}": {"a": {"b": ["]"]}}, "B": None, "C": 12}, "none": {}, "empty": [], "end": 7}
    for indent in (None, 2):
        got = list(archives.Records(io.BytesIO(json.dumps(doc, indent=indent, ensure_ascii=False).encode()), chunk))
        want = [("built", None, doc["built"]), ("n", None, 12), ("neg", None, -1500.0), *(("universe", None, x) for x in doc["universe"]), *(("fundamentals", k, v) for k, v in doc["fundamentals"].items()), ("end", None, 7)]
        assert [(s, k, json.loads(t)) for s, k, t in got] == want
    assert list(archives.Records(io.BytesIO(b"[1]"))) == [] == list(archives.Records(io.BytesIO(b"")))


def test_bundle_tables(spark, tmp_path):
    data = {"built": "now", "universe": [{"symbol": "A", "mcap": 1.0}], "fundamentals": {"A": {"info": {"sector": "x"}, "inc_a": {"EBIT": {"2020-12-31": 5.0, "bad": 1.0}}}, "B": {}}}
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(data).encode()))
    records = archives.bundle_records(archives.contents(spark, f"file://{tmp_path}/b.json.gz"))
    assert archives.bundle_universe(records).first()[:3] == ("A", None, 1.0)
    assert {(r["item"], str(r["period_end"]), r["value"]) for r in archives.bundle_lines(records).collect()} == {("EBIT", "2020-12-31", 5.0), ("EBIT", "None", 1.0)}


def test_open_interest_stands_on_the_cash_calendar(spark):
    day = lambda k: datetime.date(2024, 1, k)
    cash = spark.createDataFrame([("A", day(1), 1.0), ("A", day(3), 2.0), ("B", day(2), 3.0)], "symbol string, date date, close double")
    oi = spark.createDataFrame([("A", day(1), 5.0), ("A", day(1), 7.0), ("A", day(2), 8.0), ("A", day(4), 9.0), ("X", day(1), 1.0)], "symbol string, date date, oi double")
    got = {(r["symbol"], r["date"].day): (r["close"], r["oi"]) for r in sessions.onto_cash(cash, oi, ["oi"]).collect()}
    assert got == {("A", 1): (1.0, 6.0), ("A", 2): (None, 8.0), ("A", 3): (2.0, None), ("B", 2): (3.0, None)}


def test_pages_and_reports(spark, tmp_path):
    from tapewright.sources import sinks

    tests = spark.createDataFrame([("longterm", 3, 0.5, None)], "variant string, cohorts int, top_cagr double, note string")
    got = sinks.page("<script>a=__DATA__;b=__BT__;c=__RADAR__</script>", {"x": "</script>"}, tests)
    assert got == '<script>a={"x": "<\\/script>"};b={"variants": [{"variant": "longterm", "cohorts": 3, "top_cagr": 0.5, "note": null}]};c=null</script>'
    sides = ("top", "bottom", "universe", "bench")
    kinds = ("total", "cagr", "avg", "max_dd", "pos")
    total = spark.createDataFrame([("m", 1, "2000-01-03", "2000-04-03", *[0.1] * 20, 0.5, 0.25, 0.01, None, 0.02, 0.03)], "mode string, cohorts int, first string, last_exit string, " + ", ".join(f"{s}_{k} double" for s in sides for k in kinds) + ", hit_rate double, beat_rate double, excess_universe double, excess_bench double, ic_mean double, spread_avg double")
    rows = spark.createDataFrame([("m", "2000-01-03", "2000-04-03", 30, 0.1, -0.1, 0.05, None, 0.6)], "mode string, cohort string, exit string, n_elig int, top double, bottom double, universe double, bench double, hit double")
    text = sinks.backtest_report(rows, total, "Backtest", ["prices alone"])
    assert "| 2000-01-03 | 2000-04-03 | 30 | +10.0% | -10.0% | +5.0% | – | +60.0% |" in text and text.endswith("- prices alone\n") and "| Deepest fall | +10.0% | +10.0%" in text
    measured = spark.createDataFrame([("A", 2.0), ("B", None)], "symbol string, ath double")
    back = sinks.radar_bundle(spark, f"file://{tmp_path}/radar", measured, F.lit("2024-01-01").cast("date"), {"shares": spark.createDataFrame([("A", 5.0)], "symbol string, shares double")})
    assert [tuple(r) for r in back["ath"].collect()] == [("A", 2.0, datetime.date(2024, 1, 1))] and back["shares"].first()[1] == 5.0
