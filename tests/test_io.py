"""Readers, sinks and streams over small files."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tapewright.functions.stored import cached
from tapewright.sources import archives, readers, remote, sinks
from tapewright.streaming import feeds as streams


def test_csv_readers(spark, tmp_path):
    for i in range(2):
        with gzip.open(tmp_path / f"shard{i}.csv.gz", "wt") as f:
            f.write(f"symbol,date,open,high,low,close,volume\nS{i},2024-01-0{i + 1},1,2,0.5,1.5,10\nS{i},bad,x,2,1,1,1\n")
    got = readers.price_csv(spark, f"file://{tmp_path}").orderBy("symbol", "date").collect()
    assert len(got) == 4 and got[0]["date"] is None and got[0]["open"] is None and got[1]["close"] == 1.5


def test_exchange_files(spark, tmp_path):
    for day, series in (("2024-01-02", " EQ"), ("2024-01-03", " EQ"), ("2024-01-04", " BE")):
        (tmp_path / f"sec_{day}.csv").write_text(f"SYMBOL, SERIES, CLOSE_PRICE, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER\nA,{series}, 10.5, 100, 50, -\n")
    raw = readers.dated_files(readers.header_csv(spark, f"file://{tmp_path}"))
    rows = readers.bhavcopy(raw).orderBy("file_date").collect()
    assert [str(r["file_date"]) for r in rows] == ["2024-01-02", "2024-01-03"] and rows[0]["deliv_per"] is None and rows[0]["close"] == 10.5
    assert readers.newest(raw, 2).select("file_date").distinct().count() == 2


def test_json_readers(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text('{"symbol":"A","n":1}\nnot json\n{"symbol":"B"}\n')
    assert {(r["symbol"], r["n"]) for r in readers.json_lines(spark, f"file://{tmp_path}/feed.jsonl", "symbol string, n int").collect()} == {("A", 1), ("B", None)}
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "X.json").write_text(json.dumps({"fetched": "2024-01-01"}, indent=1))
    (folder / "Y.json").write_text("{broken")
    assert [r["file_symbol"] for r in readers.json_folder(spark, f"file://{folder}", "fetched string").where("fetched is not null").collect()] == ["X"]
    data = {"built": "now", "mcap_floor_cr": 1000, "universe": [{"symbol": "A", "mcap": 1.0}], "fundamentals": {"A": {"info": {"sector": "x"}, "inc_a": {"EBIT": {"2020-12-31": 5.0, "bad": 1.0}}}}}
    (tmp_path / "bundle.json.gz").write_bytes(gzip.compress(json.dumps(data).encode()))
    b = readers.bundle(spark, f"file://{tmp_path}/bundle.json.gz")
    assert readers.universe(b).first()["symbol"] == "A"
    lines = readers.statement_lines(b).collect()
    assert {(r["item"], str(r["period_end"]), r["value"]) for r in lines} == {("EBIT", "2020-12-31", 5.0), ("EBIT", "None", 1.0)}


def test_zip_reader(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("fo.csv", "FinInstrmTp, TckrSymb,OpnIntrst\nSTF,A,10\nOPT,B,5\n")
    (tmp_path / "fo.zip").write_bytes(buffer.getvalue())
    got = readers.derivatives(archives.zipped_csv(archives.contents(spark, f"file://{tmp_path}/fo.zip"), ["FinInstrmTp", "TckrSymb", "OpnIntrst", "none"])).collect()
    assert [(r["TckrSymb"], r["OpnIntrst"], r["none"]) for r in got] == [("A", "10", None)]


def test_fallback_patch_and_top_up(spark):
    small, large = spark.range(3), spark.range(600)

    def fails():
        raise OSError("gone")

    assert readers.first_that_works([fails, lambda: small, lambda: large]).count() == 600
    with pytest.raises(ValueError, match="no source"):
        readers.first_that_works([lambda: small])
    old = spark.createDataFrame([("A", "d1", 1.0), ("B", "d1", 1.0), ("B", "d2", 2.0)], "symbol string, date string, close double")
    extra = spark.createDataFrame([("A", "d2", 9.0), ("B", "d2", 9.0), ("C", "d2", 9.0)], "symbol string, date string, close double")
    assert {tuple(r) for r in readers.patch(old, extra, F.lit("d2")).collect()} == {("A", "d1", 1.0), ("B", "d1", 1.0), ("B", "d2", 2.0), ("A", "d2", 9.0)}
    assert {tuple(r) for r in readers.top_up(old, extra).where("symbol = 'B'").collect()} == {("B", "d1", 1.0), ("B", "d2", 9.0)}


def test_stale_records(spark):
    rows = [("A", "2024-01-01", False), ("B", "2024-03-01", True), ("C", None, False), ("D", "2024-03-01", False)]
    d = spark.createDataFrame(rows, "symbol string, fetched string, empty boolean").withColumn("fetched", F.to_date("fetched"))
    assert [r["symbol"] for r in readers.stale(d, F.lit("2024-03-05").cast("date"), most=2).collect()] == ["C", "A"]


def test_http_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    spark.dataSource.register(remote.HttpFeed)
    got = spark.read.format("http_feed").option("urls", f"file://{tmp_path}/a.txt").load().collect()
    assert [r["body"] for r in got] == ["hello"]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return b"ok"

    assert remote.retry(flaky, wait=waits.append) == b"ok" and waits == [1.0, 1.5]
    with pytest.raises(OSError):
        remote.retry(lambda: (_ for _ in ()).throw(OSError()), tries=2, wait=waits.append)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("A", 1.5, None), ("B", None, "</script>")], "symbol string, score double, note string")
    sinks.csv(d, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2
    sinks.parquet(d, f"file://{tmp_path}/pq", ["symbol"])
    assert spark.read.parquet(f"file://{tmp_path}/pq").count() == 2
    assert json.loads(sinks.document(d).orderBy("doc").first()["doc"]) == {"symbol": "A", "score": 1.5}
    assert "| A | 1.5 | – |" in sinks.markdown(d, "t")
    assert sinks.embed("<script>__DATA__</script>", {"x": "</script>"}) == '<script>{"x": "<\\/script>"}</script>'
    scored = spark.createDataFrame([("A", [], 1.0), ("B", ["x"], 9.0), ("C", [], 2.0)], "symbol string, gates_m array<string>, score_m double")
    assert [r["symbol"] for r in sinks.ranked_list(scored, "m").collect()] == ["C", "A", "B"]
    run = spark.createDataFrame([("d1", "A", 1.0, 1.0, True)], "asof string, symbol string, price double, score double, passes boolean")
    both = sinks.history(run, run.withColumn("asof", F.lit("d2")), 1)
    assert both.select("asof").distinct().count() == 2 and sinks.history(None, run).count() == 1
    feed = sinks.append_feed(run.withColumn("_fetched", F.lit("t0")), run.unionByName(run.withColumn("symbol", F.lit("B"))), ["asof", "symbol"], F.lit("t1"))
    assert {(r["symbol"], r["_fetched"]) for r in feed.collect()} == {("A", "t0"), ("B", "t1")}
    assert sinks.variants({"a": d, "b": d}).count() == 4


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    rows = lambda ids: spark.createDataFrame([(i, f"k{i % 3}") for i in ids], "id long, k string")
    rows(range(5)).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = streams.merge_newest(streams.stream(spark, f"file://{tmp_path}/in", files=1), at, ["k"], "id")
    assert {r["k"]: r["id"] for r in got.collect()} == {"k0": 3, "k1": 4, "k2": 2}
    rows([9]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = streams.merge_newest(streams.stream(spark, f"file://{tmp_path}/in", files=1), at, ["k"], "id")
    assert {r["k"]: r["id"] for r in got.collect()} == {"k0": 9, "k1": 4, "k2": 2}


def test_cached_tables_are_built_once_a_setting(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3 + len(built))

    root = f"file://{tmp_path}"
    assert [cached(spark, root, {"weights": {"a": w}}, build).count() for w in (1, 1, 2, 1)] == [4, 4, 5, 4] and len(built) == 2
    done = [p for p in tmp_path.iterdir() if len(list(p.glob("part-*"))) > 0]
    for p in done:
        (p / "_SUCCESS").unlink()  # as a lost run leaves it
    assert cached(spark, root, {"weights": {"a": 1}}, build).count() == 6


def test_freshness_gate_asks_twice_then_fills(spark):
    day = F.lit("2024-01-03").cast("date")
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    old, new = frame([("A", "2024-01-02", 1.0), ("B", "2024-01-02", 1.0)]), frame([("A", "2024-01-03", 2.0), ("B", "2024-01-03", 2.0)])
    asked = []

    def source(*answers):
        def fetch():
            asked.append(1)
            return answers[min(len(asked), len(answers)) - 1]

        asked.clear()
        return fetch

    never = lambda: pytest.fail("no patch is wanted")
    assert {r["close"] for r in readers.fresh_bars(source(new), never, day).collect()} == {2.0} and len(asked) == 1
    assert {r["close"] for r in readers.fresh_bars(source(old, new), never, day).collect()} == {2.0} and len(asked) == 2
    assert readers.fresh_bars(source(old), lambda: new.union(frame([("C", "2024-01-03", 2.0)])), day).count() == 4 and len(asked) == 2
    assert readers.fresh_bars(source(old.limit(0)), lambda: new, day).count() == 0


def test_a_folder_of_documents_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(0, 60, 1, 1).select(F.to_json(F.struct(F.concat(F.lit("S"), "id").alias("symbol"))).alias("value"))
    sinks.json_folder(docs, str(tmp_path / "docs"), files=10)
    names = [f.name for f in (tmp_path / "docs").glob("part-*")]
    assert len(names) == 60 and len({n.split("-")[1] for n in names}) > 1
    assert readers.json_folder(spark, str(tmp_path / "docs"), "symbol string").select("symbol").distinct().count() == 60
