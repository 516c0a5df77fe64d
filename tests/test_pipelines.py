"""The pipelines end to end, over files."""

import json

from pyspark.sql import functions as F

from landheat.ml.train import TrainConfig
from landheat.operators import matrix
from landheat.plans import pipelines, tables
from landheat.sources import zones
from tests.conftest import SF
from tests.test_sources import GEOJSON


def test_matrix_training_and_tables(spark, tmp_path):
    px, meta, zone, out = (str(tmp_path / n) for n in ("px", "meta", "zones", "matrix"))
    tables.pixels(spark, SF).write.parquet(px)
    for r in tables.scene_meta(spark, SF).collect():
        (tmp_path / "meta" / r.scene_id).mkdir(parents=True)
        (tmp_path / "meta" / r.scene_id / "scene_metadata.json").write_text(json.dumps(r.asDict()))
    lines = [json.loads(r.value) for r in zones.feature_lines(tables.zones(spark, SF)).collect()]
    (tmp_path / "zones").write_text(json.dumps({"type": "FeatureCollection", "features": lines}))
    done = pipelines.build_matrix(spark, px, meta, zone, out, tables.CFG, "row")
    rows = matrix.read_matrix(spark, out)
    assert done["rows"] == rows.count() > 100
    found = pipelines.train_model(spark, out, str(tmp_path / "report"), TrainConfig(depth=3, rounds=3, rate=0.5))
    assert found["metrics"].first().rmse < 30 and found["importances"].count() > 0
    made = pipelines.analysis_tables(spark, out, size=10)
    assert all(df.count() > 0 for df in made.values())
    quick = pipelines.quick_run(spark, px, train=TrainConfig(depth=2, rounds=2))
    assert quick["metrics"].first().rmse > 0 and quick["latest"].count() > 0


def test_scenes_and_vectors(spark, tmp_path):
    def feature(i, collection):
        p = {"datetime": "2020-03-01T10:00:00Z", "platform": "landsat-8", "eo:cloud_cover": 5.0, "landsat:wrs_path": 142, "landsat:wrs_row": 51}
        return {"id": i, "collection": collection, "bbox": [80.0, 12.9, 80.1, 13.0], "properties": p, "assets": {k: {"href": f"/{i}/{k}"} for k in ("red", "nir08", "swir16", "lwir11", "qa_pixel", "B10", "B11")}}

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text(json.dumps({"features": [feature("a", "l2"), feature("b", "toa")]}))
    cfg = tables.Config(years=(2020, 2020))
    for toa, want in ((None, "a"), ("toa", "b")):
        out = str(tmp_path / f"scenes-{want}")
        pipelines.discover_scenes(spark, str(tmp_path / "pages"), out, cfg, "l2", toa)
        row = spark.read.json(out).first()
        assert row.scene_id == want and row.band_files.ST_B10 == "ST_B10.tif" and row.k1_constant_band_10 == 774.8853
    (tmp_path / "v.geojson").write_text(json.dumps(GEOJSON))
    pipelines.vector_pixels(spark, str(tmp_path / "v.geojson"), str(tmp_path / "vec"), "v")
    assert spark.read.parquet(str(tmp_path / "vec")).filter(F.col("band") == "lulc_class").count() == 3
