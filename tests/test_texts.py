"""Small documents and rules: odd texts."""

from pyspark.sql import functions as F

from wayloom.functions import texts as T
from wayloom.operators import stores


def test_states_and_waypoints(spark):
    rows = spark.createDataFrame([(1, "sequenceNumber=5\r\ntimestamp=a\\:b"), (2, ""), (3, None), (4, "timestamp=x"), (5, "xsequenceNumber=5\ntimestamp=x"), (6, "sequenceNumber=\ntimestamp=x")], "id long, t string")
    got = {r.id: r.s and tuple(r.s) for r in rows.select("id", T.update_state(F.col("t")).alias("s")).collect()}
    assert got == {1: (5, "a:b"), 2: None, 3: None, 4: None, 5: None, 6: None}
    lists = spark.createDataFrame([(1, '[{"name":"a","lat":1,"lon":2},{"name":"b","lat":3,"lon":4}]'), (2, '[{"name":"a","lat":1,"lon":2}]'), (3, "no list"), (4, None), (5, '[{"name":"a","lat":1},{"name":"b","lat":3,"lon":4}]'), (6, "[]")], "id long, t string")
    assert {r.id: r.w and len(r.w) for r in lists.select("id", T.waypoints(F.col("t")).alias("w")).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_place_json_reads_back(spark):
    rows = spark.createDataFrame([(1, 'a "b" \\ c', 60.0, 10.25)], "id long, n string, lat double, lon double")
    doc = T.place_json(F.col("n"), F.col("lat"), F.col("lon"), F.lit("hut"))
    r = rows.select(doc.alias("d"), F.from_json(doc, "name string, lat double, lon double, kind string").alias("j")).first()
    assert tuple(r.j) == ('a "b" \\ c', 60.0, 10.25, "hut") and '"lat":60,' in r.d


def test_reports(spark):
    one = spark.range(1)
    r = one.select(T.car_range(F.lit(3.6e6), F.lit(None).cast("double")).alias("r")).first().r
    assert (r.capacity_wh, round(r.draw_wh, 3), round(r.pct, 4)) == (60_000.0, 1176.471, 1.9608)
    line = lambda steep: one.select(T.ebike_report(F.lit(3.6e5), 500.0, 0.8, F.lit(85.0), F.lit(12.0), F.lit(steep), F.lit(18.0), F.lit(40.0)).alias("t")).first().t
    assert line(0).endswith("ebike_climb_ok=true\n") and "ebike_pct_of_capacity=25.0" in line(0) and "steepest: 18% over 40 m" in line(2)


def test_tiles_of_a_job(spark):
    jobs = spark.createDataFrame([(1, -0.5, 179.2, 0.5, 179.9), (2, 60.0, 10.0, 60.0, 10.0)], "job long, south double, west double, north double, east double")
    assert sorted((r.job, r.tile_id) for r in stores.new_tiles(jobs, "job").collect()) == [(1, "N00E179"), (1, "S01E179"), (2, "N60E010")]
    assert stores.new_tiles(jobs.limit(0), "job").count() == 0


def test_diff_addresses_keep_all_digits(spark):
    rows = spark.createDataFrame([(1_234_567,), (12_345_678_901,), (0,), (None,)], "n long")
    got = [r.u and r.u.partition("-updates/")[2] for r in rows.select(T.diff_url(F.lit("europe/r1"), F.col("n")).alias("u")).collect()]
    assert got == ["001/234/567.osc.gz", "12345/678/901.osc.gz", "000/000/000.osc.gz", None]
