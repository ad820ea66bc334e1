"""Places: seed tables, lookup by key, radius filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as key_fn
from ..functions.geo import haversine_km, postal_keys
from ..sources.tables import written


def seed_places(codes: DataFrame, group: list[str]) -> DataFrame:
    """Places by group, null groups kept: mean coordinates and distinct postal codes."""
    return codes.groupBy(*group).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct("postal_code").alias("postal_code_count"))


def postal_to_place(codes: DataFrame, places: DataFrame, group: list[str]) -> DataFrame:
    """Postal rows with the place of their group, nulls equal to nulls."""
    p = places.select(*[F.col(g).alias(f"p_{g}") for g in group], "place_id")
    on = [F.col(g).eqNullSafe(F.col(f"p_{g}")) for g in group]
    joined = codes.join(p, on).groupBy("postal_code", "place_id")
    return joined.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def seed_filter(country: Column, state: Column, code: Column, nation: Column, overseas: list[str]) -> Column:
    """Rows of the seed: German states by letters, five-digit codes, no overseas regions, British nations."""
    digits = code.rlike("^[0-9]{5}$")
    return (
        F.when(country == "DE", state.rlike("^[A-Z]{2}$") & digits)
        .when(country == "FR", digits & ~F.coalesce(state.isin(overseas), F.lit(False)))
        .when(country == "GB", nation.isin("England", "Scotland", "Wales", "Northern Ireland"))
        .otherwise(False)
    )


def resolve_first_key(queries: DataFrame, key: str, keys: str, lookup: DataFrame) -> DataFrame:
    """Rows of the first of a query's keys that the lookup (key, ...) has."""
    tried = queries.select(key, F.posexplode(keys).alias("key_ord", "key"))
    hits = tried.join(lookup, "key")
    first = hits.groupBy(key).agg(F.min("key_ord").alias("key_ord"))
    return hits.join(first, [key, "key_ord"])


def resolve(inputs: DataFrame, key: str, text: str, postal: DataFrame, names: DataFrame, places: DataFrame) -> DataFrame:
    """(`key`, ord, label, latitude, longitude, how, n): the places that location texts mean; `n` is how many, more than
    one is ambiguous, and a text without any has no row.

    `postal` has (postal_code, place_id, latitude, longitude), `names` (key, place_id), `places` (place_id, label,
    latitude, longitude). The first postal key with rows decides; only a text without such a key takes the places of all
    its name keys, each label and point once, in the order of the keys, then of place_id.
    """
    told = inputs.select(key, F.lower(F.trim(F.col(text))).alias("_text"), F.col(text).alias("_as_written")).where("_text <> ''")
    codes = written(told.select(key, F.posexplode(postal_keys(F.col("_text"))).alias("key_ord", "postal_code")).join(postal, "postal_code").join(places.select("place_id", "label"), "place_id"))
    first = codes.groupBy(key).agg(F.min("key_ord").alias("key_ord"))
    by_code = codes.join(first, [key, "key_ord"]).select(key, F.struct(F.lit(0).alias("key_ord"), "place_id", "latitude", "longitude").alias("at"), "label", "latitude", "longitude", F.lit("postal").alias("how"))
    tried = told.join(first.select(key), key, "left_anti").select(key, F.posexplode(key_fn.places(F.col("_as_written"))).alias("key_ord", "key"))
    met = tried.join(names, "key").join(places, "place_id")
    by_name = met.groupBy(key, "label", "latitude", "longitude").agg(F.min(F.struct("key_ord", "place_id", "latitude", "longitude")).alias("at")).select(key, "at", "label", "latitude", "longitude", F.lit("name").alias("how"))
    per = Window.partitionBy(key)
    out = by_code.unionByName(by_name).withColumns({"ord": F.row_number().over(per.orderBy("at")), "n": F.count("*").over(per)})
    return out.select(key, "ord", "label", "latitude", "longitude", "how", "n")


def prepared(requests: DataFrame, key: str, locations: str, radius: str, found: DataFrame) -> DataFrame:
    """(`key`, status, unresolved, ambiguous) of requests by what `found` (`key`, text, n) says of their locations:
    without locations or a radius the filter doesn't apply, one unresolved location is an error, several places of one are told."""
    asked = requests.select(key, F.posexplode(locations).alias("_ord", "text"))
    hits = found.groupBy(key, "text").agg(F.max("n").alias("_n"))
    told = asked.join(hits, [key, "text"], "left").groupBy(key).agg(
        F.min(F.when(F.col("_n").isNull(), F.struct("_ord", "text")))["text"].alias("unresolved"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("_ord", "text")))), lambda x: x["text"]).alias("ambiguous"))
    status = F.when(F.coalesce(F.size(locations), F.lit(0)) <= 0, "no_request_locations").when(F.col(radius).isNull(), "missing_radius_km").when(F.col("unresolved").isNotNull(), "unresolved").otherwise("applied")
    out = requests.join(told, key, "left").withColumn("status", status)
    applies = F.col("status").isin("applied", "unresolved")
    return out.select(key, "status", F.when(applies, F.col("unresolved")).alias("unresolved"), F.when(F.col("status") == "applied", F.col("ambiguous")).otherwise(F.array().cast("array<string>")).alias("ambiguous"))


def near_any(points: DataFrame, key: list[str], lat: str, lon: str, request: DataFrame, radius: Column) -> DataFrame:
    """Keys of points within `radius` km, inclusive, of any point of the request.

    The request's points come from one saved search and are broadcast; the
    latitude band lets most points be dropped before the distance.
    """
    r = F.broadcast(request.select(F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon")))
    band = F.abs(F.col(lat) - F.col("r_lat")) * 110.0 <= radius
    near = haversine_km(F.col(lat), F.col(lon), F.col("r_lat"), F.col("r_lon")) <= radius
    return points.join(r, band & near, "left_semi").select(*key)


def match_report(n_points: Column, radius: Column, hit_ord: Column) -> Column:
    """Without a radius or a request location the filter doesn't apply, which matches."""
    return F.when(radius.isNull() | (n_points == 0), "not_applied").when(hit_ord.isNotNull(), "matched").otherwise("no_match")
