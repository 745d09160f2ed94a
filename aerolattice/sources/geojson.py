"""GeoJSON point layers in, feature rows out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolattice.functions import geodesy

COLLECTION = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("id", T.StringType()),
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
FEATURE = COLLECTION["features"].dataType.elementType
POINTS = "layer string, feature_id bigint, geometry_type string, lon double, lat double, props map<string,string>, crs string"


def _resolved(path: str | None, base: str | None) -> str:
    if path is None or not path.strip():
        return ""
    return path if base is None or os.path.isabs(path) or "://" in path else os.path.join(base, path)


def _exists(spark: SparkSession, path: str) -> bool:
    if not path:
        return False
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def read_layer(
    spark: SparkSession, path: str | None, layer: str, base: str | None = None, lines: bool = False, crs: str | None = None
) -> DataFrame:
    """Point layer of a GeoJSON file or folder; a blank or missing path is an empty layer, not an error.

    `crs` names the reference system of a file that does not declare one itself; without either it is EPSG:4326.

    A FeatureCollection is one document and is parsed by one task. Large layers come as one feature per line
    (`lines=True`), as `write_features` makes them, and are split like any text.
    """
    full = _resolved(path, base)
    if not _exists(spark, full):
        return spark.createDataFrame([], POINTS)
    if lines:
        features = spark.read.schema(FEATURE).json(full)
    else:
        member = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
        document = spark.read.schema(T.StructType([*COLLECTION.fields, T.StructField("crs", member)])).json(full, multiLine=True)
        named = F.col("crs.properties")["name"].alias("crs_name")
        features = document.select(F.explode("features").alias("f"), named).select("f.*", "crs_name")
    return features_as_points(features, layer, crs or "EPSG:4326")


def features_as_points(features: DataFrame, layer: str, crs: str = "EPSG:4326") -> DataFrame:
    """Rows of POINTS from feature structs.

    The id is the feature's own or its `id` property, hashed if it is no integer; a feature without either goes by a hash
    of its geometry and properties, so the same feature has the same id in every run. Coordinates in the WGS84 UTM zone
    that a layer declares (`crs_name`, else `crs`) become longitude and latitude; any other system is an error.
    """
    given = F.coalesce("id", F.col("properties")["id"])
    entries = F.to_json(F.array_sort(F.map_entries("properties")))
    content = F.xxhash64(F.to_json("geometry"), entries)
    declared = F.col("crs_name") if "crs_name" in features.columns else F.lit(None).cast("string")
    x, y = (F.get("geometry.coordinates", F.lit(i)) for i in (0, 1))
    lon, lat = geodesy.to_wgs84(x, y, F.coalesce(declared, F.lit(crs)))
    return features.select(
        F.lit(layer).alias("layer"),
        F.coalesce(given.try_cast("bigint"), F.when(given.isNotNull(), F.xxhash64(given)), content).alias("feature_id"),
        F.col("geometry.type").alias("geometry_type"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.col("properties").alias("props"),
        F.lit("EPSG:4326").alias("crs"),
    )


def read_layers(spark: SparkSession, heliports: str | None, vertiports: str | None, base: str | None = None) -> DataFrame:
    """Both layers of a planning run, paths taken relative to `base`."""
    return read_layer(spark, heliports, "heliport", base).unionByName(read_layer(spark, vertiports, "vertiport", base))


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, in a folder per layer; written by all tasks."""
    features.select("layer_id", F.col("feature").alias("value")).write.partitionBy("layer_id").text(path)


def collections(features: DataFrame, chunk: int = 10_000) -> DataFrame:
    """FeatureCollection texts of at most `chunk` features each: (layer_id, part, geojson).

    Parts are cut by feature id hash so that no task gathers a whole layer.
    """
    sized = features.groupBy("layer_id").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    cut = features.join(sized, "layer_id").withColumn("part", F.pmod(F.xxhash64("feature_id"), F.greatest("parts", F.lit(1))))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.array_sort(F.collect_list("feature")), ", "), F.lit("]}"))
    return cut.groupBy("layer_id", "part").agg(text.alias("geojson"))
