"""A synthetic export passes the audit; each tampering is found."""

import json

import pytest
from pyspark.sql import functions as F

from netloom import __main__ as cli
from netloom.functions import crs
from netloom.operators import audit, planning
from netloom.sources import district, geojson


def lonlat(spark, xy):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "i int, x double, y double")
    return [list(r) for r in df.select("i", *crs.from_utm(F.col("x") + 412000, F.col("y") + 6173000)).orderBy("i").select(F.expr("*")).drop("i").collect()]


@pytest.fixture(scope="module")
def files(spark):
    at = lonlat(spark, [(0, 0), (100, 0), (150, 0), (100, 40), (-50, 0)])
    point = lambda p: {"type": "Point", "coordinates": p}
    line = lambda *p: {"type": "LineString", "coordinates": list(p)}
    f = lambda g, **p: {"type": "Feature", "geometry": g, "properties": p}
    source = {"type": "FeatureCollection", "features": [
        f(point(at[2]), id=1, object_type="oks_connection_point", flow_tph=2.0),
        f(point(at[3]), id="1", object_type="oks_connection_point", flow_tph=1.0),
        f(point(at[0]), id="c", object_type="heat_chamber", diameter=300),
        f(line(at[4], at[0]), id="p", object_type="heat_network", diameter=300),
    ]}
    price, cost = 74023, lambda n: round(n * 74023, 2)
    total = cost(100) + cost(50) + cost(40) + 3_000_000 + 5_000_000
    pipe = lambda i, a, b, p, q, n, flow: f(line(p, q), id=f"v_{i}", object_type="heat_network", variant_id="v", start_node_id=a, end_node_id=b, flow_tph=flow, diameter=50, length=float(n), laying_method="base", depth_start=None, depth_end=None, depth_factor=1.0, special_factor=1.0, crossing_object_ids=[], cost=cost(n))
    export = {"type": "FeatureCollection", "features": [
        pipe(1, "c", "v_j", at[0], at[1], 100, 3.0), pipe(2, "v_j", 1, at[1], at[2], 50, 2.0), pipe(3, "v_j", "1", at[1], at[3], 40, 1.0),
        f(point(at[1]), id="v_j", object_type="heat_chamber", variant_id="v", diameter=50, cost=3_000_000),
        f(None, id="v_s", object_type="variant_summary", variant_id="v", rank=1, mode="2d", construction_cost=total, pipe_construction_cost=cost(190), chamber_construction_cost=3_000_000.0, existing_chamber_tie_in_count=1, existing_chamber_tie_in_cost=5_000_000.0, unconnected_penalty=0.0, calculated_cost=total, new_network_length=190.0, score=0.7 * total / 25e6 + 0.3 * 190 / 100, unconnected_oks_ids=[], connected_oks_count=2),
    ]}
    assert price == 74023
    return source, export


def found(spark, folder, source, export, rules=audit.audit):
    (folder / "in.geojson").write_text(json.dumps(source))
    (folder / "out.geojson").write_text(json.dumps(export))
    given = geojson.checked(geojson.read_features(spark, str(folder / "in.geojson")))
    return {r.rule for r in rules(audit.read_export(spark, str(folder / "out.geojson")), given).collect()}


def test_valid_export(spark, tmp_path, files):
    assert found(spark, tmp_path, *files) == set()


@pytest.mark.parametrize(("index", "name", "value", "rule"), [(0, "cost", 1.0, "pipe cost"), (4, "score", 0.1, "score"), (1, "flow_tph", 1.5, "subtree flow")])
def test_tampering_is_found(spark, tmp_path, files, index, name, value, rule):
    source, export = files
    bad = json.loads(json.dumps(export))
    bad["features"][index]["properties"][name] = value
    assert rule in found(spark, tmp_path, source, bad)


def with_features(spark, source, *features):
    out = json.loads(json.dumps(source))
    for geometry, properties, xy in features:
        ring = lonlat(spark, xy)
        out["features"].append({"type": "Feature", "geometry": {"type": geometry, "coordinates": [ring] if geometry == "Polygon" else ring}, "properties": properties})
    return out


def house(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


@pytest.mark.parametrize(("x0", "y0", "x1", "y1", "rules"), [
    (146, -20, 190, 20, set()),  # the pipe enters through the nearest facade, 4 m from the consumer
    (140, -20, 152, 20, {"entry must use the nearest facade"}),  # the pipe crosses the whole building
    (60, 3, 70, 20, {"forbidden envelope"}),
    (60, 5.3, 70, 20, set()),
])
def test_entries_and_envelopes(spark, tmp_path, files, x0, y0, x1, y1, rules):
    source, export = files
    assert found(spark, tmp_path, with_features(spark, source, ("Polygon", {"id": "h", "object_type": "oks_existing"}, house(x0, y0, x1, y1))), export, audit.clearances) == rules


def test_crossings_must_be_priced(spark, tmp_path, files):
    source, export = files
    gas = ("LineString", {"id": "g", "object_type": "restriction", "restriction_type": "gas_pipeline"}, [(50, -20), (50, 20)])
    source = with_features(spark, source, gas)
    assert found(spark, tmp_path, source, export, audit.crossing_prices) == {"crossing without a price"}
    priced = json.loads(json.dumps(export))
    priced["features"][0]["properties"] |= {"crossing_object_ids": ["g"], "laying_method": "special"}
    assert found(spark, tmp_path, source, priced, audit.crossing_prices) == {"special coefficient"}
    priced["features"][0]["properties"] |= {"special_factor": 1.25}
    assert found(spark, tmp_path, source, priced, audit.crossing_prices) == set()


def test_input_rules(spark, tmp_path, files):
    source, _ = files
    bad = json.loads(json.dumps(source))
    bad["features"][0]["properties"].pop("flow_tph")
    bad["features"].append(bad["features"][2])
    bad["features"][3]["properties"]["diameter"] = 55
    (tmp_path / "bad.geojson").write_text(json.dumps(bad))
    f = geojson.read_features(spark, str(tmp_path / "bad.geojson"))
    assert {r.rule for r in geojson.input_violations(f).collect()} == {"missing flow_tph", "duplicate identifier", "missing or unsupported diameter"}
    with pytest.raises(ValueError, match="duplicate|missing"):
        geojson.checked(f)


def test_round_trip_and_layers(spark, tmp_path, files):
    source, _ = files
    (tmp_path / "in.geojson").write_text(json.dumps(source))
    f = geojson.read_features(spark, str(tmp_path / "in.geojson"))
    assert sorted(r.id_key for r in f.collect()) == ["n:1", "s:1", "s:c", "s:p"]
    rows = f.select(F.col("id_key").alias("id"), "object_type", F.lit("v").alias("variant_id"), "diameter", F.array(F.lit(1), F.lit(2)).alias("ids"), geojson.geometry_json(F.get("parts", F.lit(0)).points, F.col("geom_type") != "Point").alias("geometry"))
    geojson.write_collection(geojson.as_features(rows, "geometry", ["id", "object_type"]), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    again = {x["properties"]["id"]: x["geometry"] for x in json.loads(text)["features"]}
    want = source["features"][0]["geometry"]["coordinates"]
    assert again["n:1"]["coordinates"] == pytest.approx(want, abs=1e-8)
    geojson.write_layers(rows, str(tmp_path / "layers"), "v")
    assert len(list((tmp_path / "layers").iterdir())) == 8
    ties = geojson.tie_candidates(f).collect()
    assert {t.tie for t in ties if t.is_chamber} == {"tie_chamber_s:c"}


def test_not_a_collection(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type":"Feature"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        geojson.read_features(spark, str(tmp_path / "x.geojson")).collect()


def test_preview_escapes():
    svg = geojson.preview([("heat_network", [(0, 0), (10, 5)])], [("<a>", 1, 2)])
    assert "&lt;a&gt;" in svg
    assert svg.startswith("<svg")


def test_graph_of_an_input(spark, tmp_path, files):
    source, _ = files
    source = with_features(spark, source, ("Polygon", {"id": "h", "object_type": "oks_existing"}, house(140, -20, 190, 20)), ("Polygon", {"id": "w", "object_type": "restriction", "restriction_type": "water"}, house(40, -10, 60, 30)))
    (tmp_path / "in.geojson").write_text(json.dumps(source))
    nodes, edges = district.graph(geojson.checked(geojson.read_features(spark, str(tmp_path / "in.geojson"))), 120.0, 3)
    assert [r.reachable for r in planning.reachability(edges, nodes).collect()] == [True, True]  # one of them within a building
    pipes, plans = planning.designs(edges, nodes, (0.5, 1.0))
    assert [(r.missing, r.broken) for r in plans.collect()] == [(0, [])] * 2
    assert pipes.filter("dn is null or length <= 0").count() == 0


def test_arguments_of_the_command_lines():
    args = cli.parser().parse_args(["solve", "in", "--out", "plans", "--factors", "[1, 2]"])
    assert (args.command, args.input, args.out, args.factors) == ("solve", "in", "plans", [1, 2])


def test_a_line_is_parsed_and_projected_once(spark, tmp_path):
    (tmp_path / "f.txt").write_text(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [37.6, 55.7]}, "properties": {"id": 1, "object_type": "heat_chamber"}}))
    f = geojson.read_features(spark, str(tmp_path / "f.txt"), lines=True)
    for df in (geojson.vertices(f), geojson.legs(geojson.obstacles(f)), geojson.terminals(f).select("id"), geojson.input_violations(f)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == plan.count("Relation [value")
    assert geojson.vertices(f).count() == 1
