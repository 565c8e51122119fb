"""Record rules, normalisation, decoding and places on literal examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import privacy as P
from millrace.functions import scalars as S
from millrace.operators import events as E
from millrace.operators import geo, quality
from millrace.sources import files

GOOD = ("evt-123", "2024-01-15T10:30:00Z", "user_1", "prod_1", 99.99, 2, "New York, USA", {"channel": "web"})


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), E.EVENT_SCHEMA)


def changed(**kw):
    names = E.EVENT_SCHEMA.fieldNames()
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD))


def errors(spark, row):
    return E.with_validity(frame(spark, row)).first()["errors"]


def test_valid_record_has_no_errors(spark):
    assert errors(spark, GOOD) == []


@pytest.mark.parametrize("change, message", [
    ({"user_id": None}, "Missing required field: user_id"),
    ({"price": -10.0}, "Invalid price: -10.0"),
    ({"quantity": 0}, "Invalid quantity: 0"),
    ({"timestamp": "not-a-timestamp"}, "Invalid timestamp format: not-a-timestamp"),
])
def test_each_rule(spark, change, message):
    assert errors(spark, changed(**change)) == [message]
    assert E.drop_malformed(frame(spark, changed(**change))).count() == 0


def test_all_errors_at_once(spark):
    assert len(errors(spark, changed(user_id=None, price=-1.0, quantity=0, timestamp="x"))) == 4


def test_contract_adds_channel_and_size(spark):
    bad = changed(metadata={"channel": "fax", "blob": "x" * 5000})
    got = frame(spark, bad).select(E.contract_violations().alias("v")).first()["v"]
    assert got == ["Unknown channel: fax", "Metadata too large"]


def test_null_price_is_not_loadable(spark):
    df = frame(spark, changed(price=None), GOOD).withColumn("event_timestamp", S.iso_timestamp(F.col("timestamp")))
    assert df.filter(E.is_loadable()).count() == 1


def test_normalize(spark):
    row = E.normalize(frame(spark, changed(user_id="12345", product_id="ABC", price=10.5, quantity=3))).first()
    assert (row.user_id, row.product_id, row.city, row.country, row.total_amount) == ("usr_12345", "prod_ABC", "New York", "USA", 31.5)
    assert (row.dt, row.event_hour, row.channel) == ("2024-01-15", 10, "web")
    again = E.normalize(frame(spark, changed(user_id="usr_1", product_id="prod_2", price=10.333, quantity=3, location="Paris"))).first()
    assert (again.user_id, again.product_id, again.total_amount, again.country) == ("usr_1", "prod_2", 31.0, None)


def test_location_object_gives_coordinates(spark):
    df = frame(spark, changed(location='{"city": "Nowhere", "latitude": 40.0, "longitude": -100.0}', metadata={"device": "ios"}))
    row = geo.enrich_region(E.normalize(df)).first()
    assert (row.city, row.lat, row.lon, row.region, row.device_type) == ("Nowhere", 40.0, -100.0, "NA", "ios")


def test_broken_json_is_a_null_record(spark):
    env = spark.createDataFrame([("k", "{broken", "t", 0, 1, dt.datetime(2024, 1, 1)), ("k", '{"id": "a", "quantity": 2.5}', "t", 0, 2, dt.datetime(2024, 1, 1))],
                                E.ENVELOPE_SCHEMA)
    rows = {r.kafka_offset: r for r in E.decode_envelope(env).collect()}
    assert len(rows) == 2 and rows[1].id is None and rows[2].quantity is None


def test_decode_parses_each_record_once(spark):
    env = spark.createDataFrame([("k", "{}", "t", 0, 1, dt.datetime(2024, 1, 1))], E.ENVELOPE_SCHEMA)
    plan = E.drop_malformed(E.decode_envelope(env))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_canonical_event_keeps_nulls_and_falls_back(spark):
    df = geo.enrich_region(E.normalize(frame(spark, changed(location="Paris", metadata={"channel": "web", "session_id": "s1"}))))
    value = E.canonical_messages(df.withColumn("session_id", F.lit(""))).first()["value"]
    assert '"country":null' in value and '"session_id":"s1"' in value and '"region":"EU"' in value


@pytest.mark.parametrize("city, lat, lon, region", [
    ("New York", None, None, "NA"), ("new york", None, None, "NA"), (None, 51.0, 0.0, "EU"), ("Atlantis", 35.0, 139.0, "AS"),
    (None, None, None, "UNKNOWN"), (None, -85.0, 0.0, "UNKNOWN"), (None, 36.0, 10.0, "EU"), (None, -5.0, 120.0, "AS"),
])
def test_regions(spark, city, lat, lon, region):
    df = spark.createDataFrame([(city, lat, lon)], "city string, lat double, lon double")
    assert geo.enrich_region(df).first()["region"] == region


def test_absent_place_columns(spark):
    assert geo.enrich_region(spark.range(1)).first()["region"] == "UNKNOWN"


def test_quality_report_stops_the_job(spark):
    report = quality.quality_report(frame(spark, changed(price=-1.0)), ["id"])
    assert {r["name"]: r["passed"] for r in report.collect()} == {
        "row_count_check": True, "null_check_id": True, "price_range_check": False, "quantity_check": True}
    with pytest.raises(ValueError, match="price_range_check"):
        quality.require_passed(report)


def test_transcripts(spark):
    text = ["Thought: look\nit up\nAction: search\nAction Input: {\"q\": \"x\"}", "Thought: done FINAL_ANSWER: 42", "Action: a\nAction Input: {bad}"]
    rows = [r.p for r in spark.createDataFrame([(t,) for t in text], "t string").select(S.parse_transcript(F.col("t")).alias("p")).collect()]
    assert rows[0].thought.strip() == "look\nit up" and rows[0].action == "search" and rows[0].action_input == {"q": "x"}
    assert (rows[1].thought, rows[1].final_answer, rows[1].action) == ("done", "42", None)
    assert rows[2].action == "a" and not rows[2].action_input


def test_paths(spark):
    df = spark.createDataFrame([("/users/42/items?id=7",), ("/x/123e4567-e89b-12d3-a456-426614174000",)], "p string")
    assert [r[0] for r in df.select(S.normalize_path(F.col("p"))).collect()] == ["/users/{id}/items", "/x/{id}"]


def test_hmac_matches_the_standard(spark, tmp_path):
    import hashlib
    import hmac

    for i, key in enumerate((b"short", b"k" * 64, b"k" * 100)):
        path = str(tmp_path / str(i))
        spark.createDataFrame([(bytearray(key),)], "key binary").write.parquet(path)
        df = spark.createDataFrame([("value é",)], "v string").select(P.hmac_sha256(F.col("v"), P.hmac_pads(P.key_table(spark, path))).alias("t"))
        assert df.first()[0] == hmac.new(key, "value é".encode(), hashlib.sha256).hexdigest()
        plan = df._jdf.queryExecution().toString()
        assert key.decode() not in plan and key.hex() not in plan.lower()


def test_keys_must_be_configured(spark):
    with pytest.raises(RuntimeError):
        P.key_table(spark)


@pytest.mark.parametrize("text", ["12:30", "T10:00", "2024", "2024-1-5", "2024-01", "now", ""])
def test_partial_times_are_no_times(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(S.iso_timestamp(F.col("t"))).first()[0] is None


def test_region_expression_agrees_with_a_row_function(spark):
    cities = {name: spec[0] for name, spec in geo.CITIES.items()}

    def one(city, lat, lon):
        known = cities.get(city.strip().title()) if city else None
        if known:
            return known
        if lat is None or lon is None:
            return geo.DEFAULT_REGION
        return next((b.code for b in geo.BOXES if b.min_lat <= lat <= b.max_lat and b.min_lon <= lon <= b.max_lon), geo.DEFAULT_REGION)

    rows = [(c, la, lo) for c in (None, "London", " tokyo ", "Nowhere") for la in (None, -85.0, 10.0, 40.0, 51.0) for lo in (-100.0, 0.0, 30.0, 139.0)]
    got = geo.enrich_region(spark.createDataFrame(rows, "city string, lat double, lon double")).select("city", "lat", "lon", "region").collect()
    assert [r.region for r in got] == [one(r.city, r.lat, r.lon) for r in got]


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org",), ("nothing",), (None,)], "e string")
    assert [r[0] for r in df.select(P.mask_email(F.col("e"))).collect()] == ["a***@x.org", "***@***.***", "***@***.***"]
    assert df.select(P.mask_value(F.col("e"), "email", "admin")).first()[0] == "ann@x.org"


def test_document_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# head\n\nbody")
    (tmp_path / "sub" / "b.txt").write_text("plain é")
    (tmp_path / "c.json").write_text('{"content": "inside"}')
    (tmp_path / "d.json").write_text('{"text": "other"}')
    (tmp_path / "e.json").write_text('["one", "two"]')
    (tmp_path / "f.json").write_text('{"x": 1}')
    (tmp_path / "skip.csv").write_text("no")
    (tmp_path / "bytes.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "broken.json").write_text('{"content": ')
    assert {r.source for r in files.unreadable_documents(spark, str(tmp_path)).collect()} == {"bytes.txt", "broken.json"}
    got = {r.source: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert {k: v.content for k, v in got.items()} == {
        "a.md": "# head\n\nbody", "sub/b.txt": "plain é", "c.json": "inside", "d.json": "other", "e.json": "one\ntwo", "f.json": '{"x": 1}'}
    assert got["sub/b.txt"].metadata == {"filename": "b.txt", "extension": ".txt"} and len(got["a.md"].doc_id) == 12


def test_source_detection_without_input(spark, tmp_path):
    assert files.detect_source(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        files.read_events(spark, str(tmp_path / "none"))


def test_csv_guard_refuses_instead_of_cutting(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n2\n3\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), "a int", max_rows=3).count() == 3
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "x.csv"), "a int", max_rows=2)


def test_geo_dimension_defaults(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"regions": [{"name": "N", "code": "N1", "bounds": {"min_lat": 0.0}}], "city_overrides": {"Oz": {"region": "N1"}}}')
    boxes, cities = geo.load_dimension(spark, str(tmp_path / "g.json"))
    assert boxes.first()[["max_lat"][0]] == 90.0 and cities.first()["region"] == "N1"
    points = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0)], "lat double, lon double")
    assert [r.region for r in geo.enrich_region_from_table(points, boxes, "lat", "lon").orderBy("lat").collect()] == ["UNKNOWN", "N1"]
    open_box = spark.createDataFrame([(0, "X", None, 0.0, None, None)], "ord int, code string, min_lat double, max_lat double, min_lon double, max_lon double")
    assert [r.region for r in geo.enrich_region_from_table(points, open_box, "lat", "lon").orderBy("lat").collect()] == ["X", "UNKNOWN"]
