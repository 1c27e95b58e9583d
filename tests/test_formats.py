"""Readers, field matching, exports and streaming imports on small inputs written out here."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from seismolake.functions import mechanism, stations, text
from seismolake.operators import catalogues, search, statistics
from seismolake.plans import fields
from seismolake.sinks import formats
from seismolake.sources import delimited, fdsn, files, json_files, quakeml, rows
from seismolake.streaming import imports

CSV = 'time,latitude,longitude,magnitude,depth,region\n2024-01-01T00:00:00Z,-41.5,174.5,5.2,12.5,"Cook Strait, north"\n\n2024-01-02T00:00:00Z,95,174.5,4.0,10,x\n2024-01-03,1,2\nbad,-41,174,abc,,y\n'
QUAKEML = """<?xml version="1.0"?>
<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2"><eventParameters>
<event publicID="smi:nz/1"><preferredOriginID>o2</preferredOriginID><description><text>Cook Strait</text></description>
<origin publicID="o1"><time><value>2024-01-01T00:00:00Z</value></time><latitude><value>1</value></latitude><longitude><value>2</value></longitude></origin>
<origin publicID="o2"><time><value>2024-01-01T00:00:05.123Z</value></time><latitude><value>-41.5</value><uncertainty>0.1</uncertainty></latitude><longitude><value>174.5</value></longitude><depth><value>25000</value></depth><quality><azimuthalGap>90</azimuthalGap></quality></origin>
<magnitude publicID="m1"><mag><value>5.5</value></mag><type>Mw</type></magnitude>
<focalMechanism publicID="f"><nodalPlanes><nodalPlane1><strike><value>10</value></strike><dip><value>45</value></dip><rake><value>90</value></rake></nodalPlane1></nodalPlanes></focalMechanism></event>
<event publicID="smi:nz/2"></event>
</eventParameters></q:quakeml>"""


def lines(spark, text_):
    return spark.createDataFrame([(x,) for x in text_.split("\n")], "value string").coalesce(1)


def test_delimited_rows_pass_or_fail(spark):
    events = delimited.read_lines(lines(spark, CSV))
    good = rows.accepted(events).collect()
    assert [(r.latitude, r.depth, r.magnitude, r.region) for r in good] == [(-41.5, 12.5, 5.2, "Cook Strait, north")]
    bad = {r.line[:10]: {(f.name, f.field) for f in r.failures} for r in rows.rejected(events).collect()}
    assert bad == {"2024-01-02": {("out_of_range", "latitude")}, "2024-01-03": {("width", "line")}, "bad,-41,17": {("invalid_format", "time"), ("invalid_type", "magnitude")}}
    assert delimited.read_lines(lines(spark, "")).count() == 0


def test_delimiters_and_date_orders():
    assert delimited.detect_delimiter(["a;b;c", "1;2,5;3"]) == ";" and delimited.detect_delimiter(["a\tb", "1\t2"]) == "\t" and delimited.detect_delimiter(["word"]) == ","
    assert delimited.detect_order(["2024-01-02"] * 9 + ["01/02/2024"])[0] == "iso"
    assert delimited.detect_order(["25/01/2024"])[0] == "international" and delimited.detect_order(["01/25/2024"])[0] == "us" and delimited.detect_order(["01/02/2024"]) == ("international", 0.3)
    assert delimited.split_head('a,"b,c", d ', ",") == ["a", "b,c", "d"] and delimited.split_head("a   b", " ") == ["a", "b"]


TIMES = {
    "2024-01-02T03:04:05.678Z": "2024-01-02 03:04:05.678", "2024-01-02 03:04:05": "2024-01-02 03:04:05", "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05+01:00": "2024-01-02 02:04:05", "25/01/2024 10:00:00": "2024-01-25 10:00:00",
    "01/02/2024 10:00:00": "2024-01-02 10:00:00", "20240102030405": "2024-01-02 03:04:05", "20240102": "2024-01-02 00:00:00", "2024-032": "2024-02-01 00:00:00", "2024032": "2024-02-01 00:00:00", "1704164645": "2024-01-02 03:04:05", "1704164645000": "2024-01-02 03:04:05",
    "2024.01.02 03:04:05.1239": "2024-01-02 03:04:05.123", "yesterday": None, "": None, "2024-13-45": None, "0999-01-01": None, "99/99/2024": None,
}


def test_times(spark):
    frame = spark.createDataFrame([(k,) for k in TIMES], "t string").select("t", text.timestamp(F.col("t")).cast("string").alias("got"))
    assert {r.t: r.got for r in frame.collect()} == TIMES
    parts = spark.range(1).select(text.timestamp_of_parts(*[F.lit(x) for x in ("2024", "2", "3", "4", "5", "6.7891")]).cast("string").alias("t"), text.timestamp_of_parts(F.lit("2024"), F.lit(""), F.lit("3")).alias("none")).first()
    assert parts.t == "2024-02-03 04:05:06.789" and parts.none is None


def test_numbers(spark):
    cases = {"5.0abc": 5.0, " -3.5 ": -3.5, "1e3": 1000.0, ".5": 0.5, "nan": None, "": None, "x1": None}
    frame = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in frame.collect()} == cases


def test_field_matching():
    got = {m.source: (m.field, round(m.confidence, 2)) for m in fields.match_fields(["Lat", "evlo", "depth", "Origin Time", "mag", "azgap", "latitudee", "colour"])}
    assert got["Lat"] == ("latitude", 0.95) and got["evlo"] == ("longitude", 0.95) and got["depth"] == ("depth", 1.0) and got["Origin Time"][0] == "time" and got["azgap"] == ("azimuthal_gap", 0.95)
    assert "colour" not in got and "latitudee" not in got
    assert fields.match_field("foo_Z", [fields.Rule("depth", "^foo", True, 80), fields.Rule("id", "(", True, 90)]) == fields.Match("foo_Z", "depth", 0.8)
    assert fields.missing_required(["time", "latitude"]) == ["longitude", "magnitude"] and fields.edit_distance("kitten", "sitting") == 3
    assert fields.lookup(["LAT", "lat", "Long"]) == {"latitude": "LAT", "longitude": "Long"}


def test_json_shapes(spark):
    record = '{"id": "a", "time": "2024-01-01T00:00:00Z", "lat": 1, "lon": 2.5, "mag": 4}'
    texts = spark.createDataFrame([(f"[{record}]",), ('{"data": [' + record + ', {"id": "b", "depth": 7}]}',), ('{"other": 1}',)], "value string")
    got = json_files.read_records(texts)
    assert sorted(r.id for r in rows.accepted(got).collect()) == ["a", "a"] and [r.id for r in rows.rejected(got).collect()] == ["b"]
    features = spark.createDataFrame([('{"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [174, -41, 0]}, "properties": {"time": 1704067200000, "magnitude": 0}}',), ('{"type": "Feature", "geometry": {"type": "LineString", "coordinates": []}, "properties": {}}',)], "value string")
    got = rows.accepted(json_files.read_features(features)).first()
    assert (got.id, got.longitude, got.depth, got.magnitude, got.time) == ("p", 174.0, 0.0, 0.0, dt.datetime(2024, 1, 1))


def test_large_documents_are_read_in_parts(spark, tmp_path):
    """Documents of one line, whose strings hold braces, quotes and brackets, in splits of some hundred bytes."""
    import json

    made = [{"id": f"e{k}", "time": "2024-01-01T00:00:00Z", "lat": k % 90, "lon": k % 180 / 2, "mag": 4 + k % 3, "note": ['}{"', '\\"}, {', "[]", '"events": [', "ü\\"][k % 5], "more": {"data": [{"x": k}]}} for k in range(90)]
    points = [{"type": "Feature", "id": m["id"], "geometry": {"type": "Point", "coordinates": [m["lon"], m["lat"], 5]}, "properties": {"time": m["time"], "magnitude": m["mag"], "note": m["note"]}} for m in made]
    (tmp_path / "a.json").write_text(json.dumps(made))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {"events": "none", "n": {"x": [1]}}, "events": made, "paging": {"next": {"id": "no"}}}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": points}))
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text('{"other": {"x": 1}}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = lambda name: f"file://{tmp_path}/{name}.json"
        assert json_files._pieces(spark, path("a")).rdd.getNumPartitions() > 10
        for name in ("a", "b", "c"):
            got = [json.loads(r.value) for r in json_files.record_texts(spark, path(name)).collect()]
            want = points if name == "c" else made
            assert sorted(got, key=lambda x: x["id"]) == sorted(want, key=lambda x: x["id"])
        assert json_files.record_texts(spark, path("d")).count() == json_files.record_texts(spark, path("e")).count() == 0
        names = lambda f: sorted(r.id for r in rows.accepted(f).select("id").collect())
        assert names(json_files.read_large_records(spark, path("b"))) == names(json_files.read_large_features(spark, path("c"))) == sorted(m["id"] for m in made)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quakeml(spark, tmp_path):
    texts = spark.createDataFrame([(QUAKEML,)], "value string")
    got = {r.event_public_id: r for r in quakeml.read_events(quakeml.event_texts(texts)).collect()}
    one = got["smi:nz/1"]
    assert (one.latitude, one.depth, one.magnitude, one.region, one.azimuthal_gap, one.rake, one.time) == (-41.5, 25.0, 5.5, "Cook Strait", 90.0, 90.0, dt.datetime(2024, 1, 1, 0, 0, 5, 123000))
    assert {"no_origin", "no_magnitude"} <= {f.name for f in got["smi:nz/2"].failures}
    broken = spark.createDataFrame([(QUAKEML,), (QUAKEML.replace("</event>", "", 1),), ("<catalogue/>",)], "value string")
    assert [{p.name for p in r.problems} for r in quakeml.document_problems(broken).collect()] == [set(), {"unbalanced"}, {"no_root", "no_events", "no_namespace"}]
    path = tmp_path / "a.xml"
    path.write_text(QUAKEML)
    assert rows.accepted(files.read_file(spark, f"file://{path}")).count() == 1


def test_fdsn(spark):
    url = fdsn.Request(minmagnitude=3.0).around_new_zealand().recent(dt.datetime(2024, 1, 2), 24).url("https://service/query")
    assert "starttime=2024-01-01T00%3A00%3A00" in url and "minlatitude=-47.5" in url and "maxmagnitude" not in url
    answer = "#" + "|".join(fdsn.COLUMNS) + "\na|2024-01-01T00:00:00|-41|174|x|net|ML|3.1|here\n# more\n"
    got = rows.accepted(fdsn.read_answers(lines(spark, answer))).collect()
    assert [(r.id, r.depth, r.magnitude_type, r.location_name) for r in got] == [("a", None, "ML", "here")]


def test_documents_and_names():
    assert formats.document(['{"a": 1}', '{"a": 2}'], "geojson", "x").count('"a"') == 2
    assert formats.file_name("A b/c?", "quakeml", dt.date(2024, 1, 2)) == "A_b_c_2024-01-02.xml"
    assert formats.csv_head("n", {"k": 1}).startswith("# Catalogue: n\n# k: 1\nid,time")


def test_store_and_quoting(spark, tmp_path):
    rows_ = [(1, 0, dt.datetime(2024, 1, 1), -41.0, 174.0, 5.0, 4.0), (2, 1, dt.datetime(2024, 1, 1), -41.0, 174.0, None, 4.0)]
    events = spark.createDataFrame(rows_, "id long, catalogue_id long, time timestamp, latitude double, longitude double, depth double, magnitude double")
    formats.write_store(events, f"file://{tmp_path}/store")
    assert sorted(d for d in os.listdir(tmp_path / "store") if d.startswith("cat")) == ["catalogue_id=0", "catalogue_id=1"]
    with pytest.raises(Exception, match="out of range"):
        formats.write_store(events.withColumn("latitude", F.lit(99.0)), f"file://{tmp_path}/bad")
    assert spark.range(1).select(formats.csv_field(F.lit('a"b,c')).alias("x")).first().x == '"a""b,c"'


def test_streaming_import(spark, tmp_path):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    header = "id,time,latitude,longitude,depth,magnitude"

    def run():
        events = imports.delimited_stream(spark, f"file://{folder}", header, files=1).drop("line")
        imports.start_import(events, store, f"file://{tmp_path}/check", 7, history=f"file://{tmp_path}/history").awaitTermination()
        return {r.id: r.magnitude for r in imports.read_store(spark, store, rows.accepted(events).withColumn("catalogue_id", F.lit(7))).collect()}

    (folder / "1.csv").write_text(f"{header}\na,2024-01-01T00:00:00Z,-41,174,5,4.0\nb,2024-01-01T01:00:00Z,-41,174,5,4.5\nc,2024-01-01T01:00:00Z,-99,174,5,4.5\n")
    assert run() == {"a": 4.0, "b": 4.5}
    (folder / "2.csv").write_text(f"{header}\nb,2024-01-01T01:00:00Z,-41,174,5,4.7\nd,2024-01-02T00:00:00Z,-41,174,5,3.0\n")
    assert run() == {"a": 4.0, "b": 4.7, "d": 3.0}
    assert run() == {"a": 4.0, "b": 4.7, "d": 3.0}
    history = catalogues.latest_imports(imports.read_history(spark, f"file://{tmp_path}/history"), 7).collect()
    assert [(r.added, r.updated, r.skipped, r.errors) for r in history] == [(1, 1, 0, 0), (2, 0, 0, 0)]


def test_store_reads_the_buckets_of_a_batch(spark, tmp_path):
    """Of a store with several versions only the buckets of the ids that are asked for; also after it was compacted in place."""
    store, t = f"file://{tmp_path}/store", dt.datetime(2024, 1, 1)
    batch = lambda *ids, m=4.0: spark.createDataFrame([(i, t, -41.0, 174.0, 5.0, m) for i in ids], "id string, time timestamp, latitude double, longitude double, depth double, magnitude double").withColumn("failures", F.array().cast("array<struct<name:string,field:string,severity:string>>"))
    like = rows.accepted(batch("x")).withColumn("catalogue_id", F.lit(7))
    merge = imports.merge_batch(store, 7)
    merge(batch(*[f"e{k}" for k in range(400)]), 0)
    merge(batch("e1", "e2", "new", m=5.0), 1)
    values = lambda **k: {r.id: r.magnitude for r in imports.read_store(spark, store, like, **k).collect()}
    whole = {f"e{k}": 4.0 for k in range(400)} | {"e1": 5.0, "e2": 5.0, "new": 5.0}
    some = spark.createDataFrame([("e1",), ("e7",)], "id string")
    assert values() == whole and values(ids=some) == {"e1": 5.0, "e7": 4.0} and values(before=1)["e1"] == 4.0
    assert imports.compact(spark, store, like) == 1 and imports.compact(spark, store, like) is None
    assert values() == whole and values(ids=some) == {"e1": 5.0, "e7": 4.0}
    merge(batch("e2", m=6.0), 2)
    imports.drop_compacted(spark, store)
    assert sorted(p.name for p in (tmp_path / "store").glob("version=*")) == ["version=2"]
    assert values() == whole | {"e2": 6.0}
    assert imports.compact(spark, store, like) == 2 and imports.compacted(spark, store) == 2 and values() == whole | {"e2": 6.0}
    plan = imports.read_store(spark, store, like, ids=some)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters" in plan


def test_streaming_windows(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a", "t": "2024-01-01T00:10:00Z", "la": 1, "lo": 2, "m": 3}\n{"id": "a", "t": "2024-01-01T00:10:00Z", "la": 1, "lo": 2, "m": 3}\n{"id": "b", "t": "2024-01-05T00:10:00Z", "la": 1, "lo": 2, "m": 5}\n')
    names = {"id": "id", "t": "time", "la": "latitude", "lo": "longitude", "m": "magnitude"}
    events = rows.accepted(imports.json_stream(spark, f"file://{tmp_path}/*.json", names))
    query = imports.first_arrivals(events).writeStream.format("memory").queryName("arrivals").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrivals").count() == 2
    query = imports.rates(events).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.largest) for r in spark.table("rates").collect()] == [(2, 3.0)]


def test_catalogue_lists(spark):
    made = spark.createDataFrame([("North", "complete", "merged", dt.datetime(2024, 1, 5), 120), ("South", "error", "uploaded", dt.datetime(2024, 2, 5), 5)], "name string, status string, kind string, created timestamp, events long")
    names = lambda q: [r.name for r in catalogues.find(made, q).collect()]
    assert names("events:>=100") == ["North"] and names("status:err") == ["South"] and names("created:2024-01") == ["North"] and names("south") == ["South"] and names("colour:red") == []
    assert [r.name for r in catalogues.in_order(made, "events").collect()] == ["South", "North"]
    kinds = spark.createDataFrame([('[{"source": "GeoNet"}]', None), ('[{"source": "upload"}]', None), ('[{"id": "1", "name": "a", "events": 3}, {"id": "2", "name": "b", "events": 4}]', None), (None, '{"mergeStrategy": "newest"}'), (None, None)], "s string, c string")
    assert [r[0] for r in kinds.select(catalogues.source_kind(F.col("s"), F.col("c"))).collect()] == ["imported", "uploaded", "merged", "merged", "uploaded"]
    rule = search.EventFilter(least_magnitude=3, west=170)
    assert catalogues.load_filter(catalogues.save_filter(rule)) == rule
    changed = catalogues.updated(made, spark.createDataFrame([("North", "error", None)], "name string, status string, kind string"), "name", ("status",))
    assert {r.name: (r.status, r.kind) for r in changed.collect()}["North"] == ("error", "merged")


def test_mechanisms_and_coverage(spark):
    row = spark.range(1).select(
        mechanism.quality(F.lit(60), F.lit(0.05), F.lit(True), F.lit(0.9), F.lit(80.0), F.lit("final")).alias("best"), mechanism.quality(*[F.lit(None)] * 6).alias("none"),
        stations.azimuthal_gap(F.array(F.lit(10.0))).alias("one"), stations.azimuthal_gap(F.array(F.lit(350.0), F.lit(10.0), F.lit(180.0))).alias("three"),
    ).first()
    assert (row.best, row.none, row.one, row.three) == (100.0, 50.0, 360.0, 170.0)


def test_clusters(spark):
    t = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(k, 1, t + dt.timedelta(hours=k), m) for k, m in ((1, 5.0), (2, 4.8), (3, 4.7), (4, 4.0), (5, 4.0))] + [(9, 9, t, 3.0)], "id long, mainshock long, time timestamp, magnitude double")
    assert [(r.mainshock, r.n, r.kind) for r in statistics.clusters(frame).collect()] == [(1, 5, "burst")]


@pytest.fixture
def service():
    """A service on this machine that answers requests as their parameters say, and notes them."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    events = [(f"e{k}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * k), -41.0 + k / 10, 174.0, "12.5" if k % 3 else "deep", 2.0 + k / 10) for k in range(20)] + [("", dt.datetime(2024, 1, 1), 0.0, 0.0, "1", 5.0)]
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            p = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(p)
            day = lambda name, other: dt.datetime.fromisoformat(p[name]) if name in p else other
            rows_ = [e for e in events if day("starttime", dt.datetime.min) <= e[1] <= day("endtime", dt.datetime.max) and float(p.get("minmagnitude", -9)) <= e[5] and e[1] >= day("updatedafter", dt.datetime.min)]
            body = "#EventID|Time|Latitude|Longitude|Depth/km|Author|MagType|Magnitude|EventLocationName\n" + "".join(f"{i}|{t.isoformat()}Z|{y}|{x}|{z}|net|ML|{m}|place\n" for i, t, y, x, z, m in rows_)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", asked
    server.shutdown()


def test_fdsn_source(spark, service):
    from seismolake.sources.fdsn_service import FdsnSource

    url, asked = service
    spark.dataSource.register(FdsnSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = spark.read.format("fdsn").option("url", url).option("starttime", "2024-01-01T00:00:00").option("endtime", "2024-01-04T00:00:00").option("hours", "24").load()
        assert frame.rdd.getNumPartitions() == 3 and sorted(r.id for r in frame.collect()) == sorted(f"e{k}" for k in range(15))
        del asked[:]
        got = frame.where("magnitude >= 3 and magnitude < 3.3 and time < timestamp'2024-01-03T00:00:00'").collect()
        # e10 is at hour 50, past the pushed end of time.
        assert [r.id for r in got] == [] and all(p["minmagnitude"] == "3.0" for p in asked) and len(asked) == 3
        got = frame.where("magnitude >= 3").collect()
        assert sorted(r.id for r in got) == ["e10", "e11", "e12", "e13", "e14"] and {r.id: r.depth for r in got}["e12"] is None and {r.id: r.depth for r in got}["e10"] == 12.5
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_fdsn_updates(spark, service, tmp_path):
    """Each batch is several requests by several tasks; a restart asks for no span again."""
    from seismolake.sources.fdsn_service import FdsnSource

    url, asked = service
    spark.dataSource.register(FdsnSource)
    stream = spark.readStream.format("fdsn").option("url", url).option("since", "2024-01-03T00:00:00").option("starttime", "2023-12-01T00:00:00").option("endtime", "2024-02-01T00:00:00").option("requests", "4").option("every", "1").load()
    found = []

    def run(batches):
        before = len({a["updatedafter"] for a in asked})
        query = stream.writeStream.foreachBatch(lambda batch, n: found.append((n, batch.rdd.getNumPartitions(), sorted(r.id for r in batch.collect())))).option("checkpointLocation", str(tmp_path)).trigger(processingTime="1 second").start()
        try:
            deadline = dt.datetime.now() + dt.timedelta(seconds=60)
            while dt.datetime.now() < deadline and len({a["updatedafter"] for a in asked}) < before + batches:
                query.awaitTermination(1)
            assert query.exception() is None
        finally:
            query.stop()

    run(2)
    assert found[0][:2] == (0, 4) and found[0][2] == sorted(f"e{k}" for k in range(10, 20)) and all(not ids for _, _, ids in found[1:])
    first = [a for a in asked if a["updatedafter"] == "2024-01-03T00:00:00"]
    assert len({a["starttime"] for a in first}) == 4 and min(a["starttime"] for a in first).startswith("2023-12-01")
    seen = len(asked)
    run(1)
    assert all(a["updatedafter"] > "2024-01-03T00:00:00" for a in asked[seen:]) and len(asked) > seen


def test_bounds_are_state(spark, tmp_path):
    """A batch writes the catalogues that it changes alone, and a restart goes on from the state."""
    folder, table = tmp_path / "in", f"file://{tmp_path}/bounds"
    folder.mkdir()
    assert imports.kept_bounds(spark, table).count() == 0

    def run(name, *events):
        (folder / name).write_text("".join(f'{{"c": {c}, "latitude": {y}, "longitude": {x}, "time": "{t}"}}\n' for c, y, x, t in events))
        stream = spark.readStream.schema("c long, latitude double, longitude double, time timestamp").json(f"file://{folder}").withColumnRenamed("c", "catalogue_id")
        imports.start_bounds(stream, table, f"file://{tmp_path}/check").awaitTermination()
        return {r.catalogue_id: (r.south, r.north, r.west, r.east, r.n, r.last) for r in imports.kept_bounds(spark, table).collect()}

    t = dt.datetime(2024, 1, 1)
    assert run("1.json", (1, -41, 174, t), (1, -42, 175, t), (2, 5, 6, t)) == {1: (-42, -41, 174, 175, 2, t), 2: (5, 5, 6, 6, 1, t)}
    later = t + dt.timedelta(days=1)
    assert run("2.json", (1, -40, 174.5, later)) == {1: (-42, -40, 174, 175, 3, later), 2: (5, 5, 6, 6, 1, t)}
    last = max((tmp_path / "bounds").glob("version=*"), key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.parquet(f"file://{last}").count() == 1


def test_documents_by_several_tasks(spark, tmp_path):
    import json

    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, t + dt.timedelta(minutes=(k * 37) % 500), -41.0, 174.0, 5.0, 3.0, None, 'a "b" <c>', "manual", None) for k in range(500)], "id long, time timestamp, latitude double, longitude double, depth double, magnitude double, magnitude_type string, region string, evaluation_mode string, evaluation_status string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        formats.write_document(events, f"file://{tmp_path}/parts", "geojson", "it's")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    formats.join_parts(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/all.geojson")
    made = json.loads((tmp_path / "all.geojson").read_text())
    assert made["name"] == "it's" and [f["properties"]["time"] for f in made["features"]] == sorted(f["properties"]["time"] for f in made["features"]) and sorted(int(f["id"]) for f in made["features"]) == list(range(500))
    assert rows.accepted(files.read_file(spark, f"file://{tmp_path}/all.geojson")).count() == 500
    for kind, kept in (("geojson", '"features": ['), ("csv", "id,time")):
        lines_ = [r.value for r in formats.document_lines(events.limit(0).withColumns({c: F.lit(None) for c in formats.CSV_COLUMNS if c not in events.columns}), kind, "none").collect()]
        assert kept in "\n".join(lines_)
    with pytest.raises(Exception, match="fails"):
        formats.write_document(events.withColumn("region", F.when(F.col("id") == 499, F.raise_error(F.lit("fails"))).otherwise(F.col("region"))), f"file://{tmp_path}/failed", "geojson", "x")
    assert not list((tmp_path / "failed").glob("part-*")) if (tmp_path / "failed").exists() else True
