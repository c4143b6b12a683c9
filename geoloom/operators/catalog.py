"""Datasets of the German states as a dimension table, and download jobs for tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import tiles

# State, UTM zone, tile size in km, height datasets in order of preference.
STATES = [
    ("by", 32, 1, ["dgm1", "dgm5", "dom20"]), ("ni", 32, 1, ["dgm1", "dom1"]), ("nw", 32, 1, ["dgm1", "dom1"]), ("he", 32, 1, ["dgm1", "dom1"]),
    ("th", 32, 1, ["dgm1", "dom1"]), ("sn", 33, 2, ["dgm1", "dom1"]), ("be", 33, 2, ["dgm1", "dom1"]), ("bb", 33, 1, ["dgm1", "bdom"]),
    ("st", 32, 2, ["dgm1", "dom1"]), ("mv", 33, 2, ["dgm1", "dom1"]), ("hh", 32, 1, ["dgm1", "dom1"]), ("hb", 32, 1, ["dgm1", "dom1"]),
    ("sh", 32, 1, ["dgm1"]), ("bw", 32, 2, ["dgm1", "dom1"]), ("rp", 32, 1, ["dgm1", "dom1"]), ("sl", 32, 1, ["dgm1", "dom1"]),
]
# File names of states whose tiles have one file each; {e} and {n} are kilometres.
FILES = {
    ("by", "dgm1"): "{e}_{n}.tif", ("by", "dom20"): "32{e}_{n}_20_DOM.tif", ("sn", "dgm1"): "dgm1_33{e}_{n}_2_sn_tiff.zip", ("sn", "dom1"): "dom1_33{e}_{n}_2_sn_tiff.zip",
    ("be", "dgm1"): "DGM1_{e}_{n}.zip", ("be", "dom1"): "DOM1_{e}_{n}.zip", ("bb", "dgm1"): "dgm_33{e}-{n}.zip", ("bb", "bdom"): "bdom_33{e}-{n}.zip",
}
SURFACES = ["dom1", "dom20", "bdom"]

# Addresses of datasets whose tiles have one file each: the file (%d: kilometres east, then north), and the folders it lies in.
ADDRESSES = {
    ("by", "dgm1"): ("%d_%d.tif", ["https://download1.bayernwolke.de/a/dgm/dgm1/", "https://download2.bayernwolke.de/a/dgm/dgm1/"]),
    ("by", "dgm5"): ("%d_%d.zip", ["https://download1.bayernwolke.de/a/dgm/dgm5xyz/", "https://download2.bayernwolke.de/a/dgm/dgm5xyz/"]),
    ("by", "dom20"): ("32%d_%d_20_DOM.tif", ["https://download1.bayernwolke.de/a/dom20/DOM/", "https://download2.bayernwolke.de/a/dom20/DOM/"]),
    ("by", "dop20"): ("32%d_%d.tif", ["https://download1.bayernwolke.de/a/dop20/data/", "https://download2.bayernwolke.de/a/dop20/data/"]),
    ("by", "dop40"): ("32%d_%d.tif", ["https://download1.bayernwolke.de/a/dop40/data/", "https://download2.bayernwolke.de/a/dop40/data/"]),
    ("by", "lod2"): ("%d_%d.gml", ["https://download1.bayernwolke.de/a/lod2/citygml/", "https://download2.bayernwolke.de/a/lod2/citygml/"]),
    ("by", "laser"): ("32%d_%d.laz", ["https://download1.bayernwolke.de/a/laser/data/", "https://download2.bayernwolke.de/a/laser/data/"]),
    ("be", "dgm1"): ("DGM1_%d_%d.zip", ["https://gdi.berlin.de/data/dgm1/atom/"]),
    ("be", "dom1"): ("DOM1_%d_%d.zip", ["https://gdi.berlin.de/data/dom/atom/"]),
    ("be", "dop20rgbi"): ("dop20rgbi_33_%d_%d_2_be_2026.jp2", ["https://gdi.berlin.de/data/oi_dop2026/atom/"]),
    ("be", "lod2"): ("LoD2_%d_%d.zip", ["https://gdi.berlin.de/data/a_lod2/atom/"]),
    ("bb", "dgm1"): ("dgm_33%03d-%04d.zip", ["https://data.geobasis-bb.de/geobasis/daten/dgm/tif/"]),
    ("bb", "dgm1_xyz"): ("dgm_33%03d-%04d.zip", ["https://data.geobasis-bb.de/geobasis/daten/dgm/xyz/"]),
    ("bb", "bdom"): ("bdom_33%03d-%04d.zip", ["https://data.geobasis-bb.de/geobasis/daten/bdom/tif/"]),
    ("bb", "dop20rgbi"): ("dop_33%03d-%04d.zip", ["https://data.geobasis-bb.de/geobasis/daten/dop/rgbi_tif/"]),
    ("bb", "lod2"): ("lod2_33%03d-%04d.zip", ["https://data.geobasis-bb.de/geobasis/daten/3d_gebaeude/lod2_gml/"]),
    ("bw", "dgm1"): ("dgm1_32_%d_%d_2_bw.zip", ["https://opengeodata.lgl-bw.de/data/dgm/"]),
    ("bw", "dom1"): ("dom1_32_%d_%d_2_bw.zip", ["https://opengeodata.lgl-bw.de/data/dom1/"]),
    ("bw", "dop20rgb"): ("dop20rgb_32_%d_%d_2_bw.zip", ["https://opengeodata.lgl-bw.de/data/dop20/"]),
    ("bw", "dop20rgbi"): ("dop20rgbi_32_%d_%d_2_bw.zip", ["https://opengeodata.lgl-bw.de/data/dop20/"]),
    ("bw", "lod2"): ("LoD2_32_%d_%d_2_bw.zip", ["https://opengeodata.lgl-bw.de/data/lod2/"]),
    ("mv", "dgm1"): ("dgm1_33_%03d_%04d_2_gtiff.tif", ["https://www.geodaten-mv.de/dienste/dgm_download?index=4&dataset=ca268792-s2q1-4a39-b34c-9ec5bf9a4469&file="]),
    ("mv", "dom1"): ("dom1_33_%03d_%04d_2_gtiff.tif", ["https://www.geodaten-mv.de/dienste/dom_download?index=4&dataset=us214578-a1n5-4v12-v31c-5tg2az3a2164&file="]),
    ("mv", "dop20rgbi"): ("dop20rgbi_33_%03d_%04d_2_mv.tif", ["https://www.geodaten-mv.de/dienste/dop20_download?index=0&dataset=f94d17fa-b29b-41f7-a4b8-6e10f1aae38e&file="]),
    ("mv", "lod2"): ("lod2_33_%03d_%04d_2_gml.zip", ["https://www.geodaten-mv.de/dienste/gebaeude_download?index=0&dataset=8397b554-5cb9-4274-8be8-c20490d9a6e8&file="]),
    ("nw", "lod2"): ("LoD2_32_%d_%d_1_NW.gml", ["https://www.opengeodata.nrw.de/produkte/geobasis/3dg/lod2_gml/lod2_gml/"]),
    ("rp", "lod2"): ("LoD2_32_%d_%d_2_RP.gml", ["https://geobasis-rlp.de/data/geb3dlo/current/gml/"]),
    ("sn", "dgm1"): ("dgm1_33%03d_%04d_2_sn_tiff.zip", ["https://geocloud.landesvermessung.sachsen.de/public.php/dav/files/JCcXyifaNdLDnxZ/"]),
    ("sn", "dom1"): ("dom1_33%03d_%04d_2_sn_tiff.zip", ["https://geocloud.landesvermessung.sachsen.de/public.php/dav/files/S6wwnFwX7882sZm/"]),
    ("sn", "dop20rgb"): ("dop20rgb_33%03d_%04d_2_sn_tiff.zip", ["https://geocloud.landesvermessung.sachsen.de/public.php/dav/files/QQFLq6nkoSnqB5g/"]),
    ("sn", "dop20rgbi"): ("dop20rgbi_33%03d_%04d_2_sn_tiff.zip", ["https://geocloud.landesvermessung.sachsen.de/public.php/dav/files/sX3GPcdBMGrfXT9/"]),
    ("sn", "lod2"): ("lod2_33%03d_%04d_2_sn_citygml.zip", ["https://geocloud.landesvermessung.sachsen.de/public.php/dav/files/AyJqXpJAZJXomCb/"]),
    ("th", "lod2"): ("LoD2_32_%d_%d_2_TH.zip", ["https://geoportal.geoportal-th.de/3dgebaeude/LoD2/"]),
}
# Datasets whose tiles lie in different files of two surveys, the newer one first; the first gives the file its name.
SURVEYS = {
    ("th", "dgm1"): ["https://geoportal.geoportal-th.de/hoehendaten/DGM/dgm_2020-2025/dgm1_32_%d_%d_1_th_2020-2025.zip", "https://geoportal.geoportal-th.de/hoehendaten/DGM/dgm_2014-2019/dgm1_%d_%d_1_th_2014-2019.zip"],
    ("th", "dom1"): ["https://geoportal.geoportal-th.de/hoehendaten/DOM/dom_2020-2025/dom1_32_%d_%d_1_th_2020-2025.zip", "https://geoportal.geoportal-th.de/hoehendaten/DOM/dom_2014-2019/dom1_%d_%d_1_th_2014-2019.zip"],
}
# Datasets whose tiles have another size in km than their state's.
GRIDS = {("by", "lod2"): 2, ("th", "lod2"): 2, ("be", "lod2"): 1, ("rp", "dop20rgb"): 2, ("rp", "lod2"): 2}
# Megabytes of a tile on average, where they are known.
TILE_MB = {("by", "dgm1"): 4.0, ("by", "dgm5"): 0.8, ("by", "dom20"): 44.0, ("by", "dop20"): 300.0, ("by", "dop40"): 75.0, ("by", "lod2"): 50.0, ("by", "laser"): 800.0}
# How a tile's entry is named in a state's archives; %s is the dataset.
ENTRIES = {"hh": "%s_32_%d_%d_1_hh.tif", "he": "%s_32_%d_%d_1_he.tif", "sl": "%s_32_%d_%d_1_SL.tif", "hb": "%s_32%03d_%04d_1_hb.xyz"}


def delivery_cell(east_km: Column, north_km: Column) -> tuple[Column, Column]:
    """The 2 km cell with odd eastings and even northings that holds a tile."""
    return F.when(east_km % 2 != 0, east_km).otherwise(east_km - 1), F.when(north_km % 2 == 0, north_km).otherwise(north_km - 1)


def state_jobs(tiles_: DataFrame, state: str, dataset: str) -> DataFrame:
    """east_km, north_km, file and mirrors of each tile in a state whose addresses follow from the tile alone."""
    e, n = F.col("east_km").cast("int"), F.col("north_km").cast("int")
    e, n = delivery_cell(e, n) if state == "bw" else (e, n)
    if (state, dataset) in SURVEYS:
        urls = [F.format_string(u, e, n) for u in SURVEYS[state, dataset]]
        return tiles_.select("east_km", "north_km", F.element_at(F.split(urls[0], "/"), -1).alias("file"), F.array(*urls).alias("mirrors"))
    if (state, dataset) not in ADDRESSES:
        raise KeyError(f"{state} has no addresses of {dataset}")
    pattern, folders = ADDRESSES[state, dataset]
    file = F.format_string(pattern, e, n)
    return tiles_.select("east_km", "north_km", file.alias("file"), F.array(*(F.concat(F.lit(d), file) for d in folders)).alias("mirrors"))


def grid_km(state: str, dataset: str) -> int:
    """Edge of a dataset's tiles; states that deliver by odd and even kilometres have jobs for each kilometre."""
    return GRIDS.get((state, dataset)) or (1 if state == "bw" else next(g for s, _, g, _ in STATES if s == state))


def area_jobs(areas: DataFrame, state: str, dataset: str) -> DataFrame:
    """One job per file that any of the areas (min_x, min_y, max_x, max_y) needs: its tile, file, mirrors and megabytes (null where unknown)."""
    t = tiles.union_tiles(areas, grid_km(state, dataset))
    if state == "bw":
        e, n = delivery_cell(F.col("east_km"), F.col("north_km"))
        t = t.select(e.alias("east_km"), n.alias("north_km")).distinct()
    return state_jobs(t, state, dataset).withColumn("megabytes", F.lit(TILE_MB.get((state, dataset))).cast("double"))


def height_dataset(state: str, dataset: str) -> str:
    """The dataset's own name if the state has heights under it, in any case of letters; a ValueError that names the right ones otherwise."""
    known = next((d for s, _, _, d in STATES if s == state.lower()), None)
    if known is None:
        raise ValueError(f"there is no state {state}")
    if dataset.lower() not in known:
        raise ValueError(f"{dataset} holds no heights of {state}; those are {', '.join(known)}")
    return dataset.lower()


def entry_name(state: str, dataset: str, east_km: Column, north_km: Column) -> Column:
    return F.format_string(ENTRIES[state], F.lit(dataset), east_km.cast("int"), north_km.cast("int"))


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATES, "state string, zone int, grid_km int, datasets array<string>")


def datasets(spark: SparkSession) -> DataFrame:
    return states(spark).select("state", "zone", "grid_km", F.posexplode("datasets").alias("rank", "dataset"))


def surface_dataset(spark: SparkSession) -> DataFrame:
    """Of each state the first surface model that it has."""
    wanted = F.array(*(F.lit(s) for s in SURFACES))
    return states(spark).select("state", F.get(F.filter(wanted, lambda s: F.array_contains("datasets", s)), F.lit(0)).alias("surface"))


def jobs(tiles: DataFrame, state: str, dataset: str, bases: list[str]) -> DataFrame:
    """file and mirrors of each tile (east_km, north_km)."""
    head, _, rest = FILES[state, dataset].partition("{e}")
    middle, _, tail = rest.partition("{n}")
    name = F.concat(F.lit(head), F.col("east_km").cast("string"), F.lit(middle), F.col("north_km").cast("string"), F.lit(tail))
    return tiles.select("east_km", "north_km", name.alias("file")).withColumn("mirrors", F.array(*(F.concat(F.lit(b.rstrip("/") + "/"), F.col("file")) for b in bases)))


def in_index(tiles_: DataFrame, index: DataFrame) -> DataFrame:
    """Tiles with their url; tiles that the index does not have are dropped. Small indexes are broadcast by the optimiser."""
    return tiles_.join(index, ["east_km", "north_km"])


def wanted_only(items: DataFrame, tiles_: DataFrame) -> DataFrame:
    """The items whose tile is wanted."""
    return items.join(tiles_.select("east_km", "north_km"), ["east_km", "north_km"], "left_semi")


def map_jobs(areas: DataFrame, state: str, base: str, layer: str, pixels: int = 2000) -> DataFrame:
    """file and url of the image of each kilometre tile that an area (min_x, min_y, max_x, max_y) covers."""
    zone = next(z for s, z, *_ in STATES if s == state)
    t = tiles.union_tiles(areas, 1)
    url = tiles.map_request(base, layer, F.col("east_km"), F.col("north_km"), pixels=pixels, epsg=25800 + zone)
    return t.select("east_km", "north_km", tiles.tile_name(F.col("east_km"), F.col("north_km"), f"{layer}_").alias("file"), url.alias("url"))


def size_estimate(jobs_: DataFrame, megabytes: float, *by: str) -> DataFrame:
    return jobs_.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.lit(float(megabytes))).alias("megabytes"))


def outcomes(results: DataFrame, *by: str) -> DataFrame:
    """How many jobs came through: `error` is null for those."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("done"))


def newest_title(features: DataFrame) -> DataFrame:
    """Of the features (title, datum, gid) with one title the one with the greatest date as text; of equal dates the smallest gid."""
    named = features.filter("title <> '' and gid <> 0").withColumn("datum", F.coalesce("datum", F.lit("")))
    # The greatest date, then the smallest number.
    best = named.groupBy("title").agg(F.max(F.struct("datum", (-F.col("gid")).alias("back"))).alias("b"))
    return best.select("title", "b.datum", (-F.col("b.back")).alias("gid"))


def one_per_file(jobs_: DataFrame) -> DataFrame:
    """One job of each file, with the smallest url, in the order of file names by code point."""
    return jobs_.groupBy("file").agg(F.min("url").alias("url")).orderBy("file")


def south_west_order(tiles_: DataFrame) -> DataFrame:
    """Tiles column by column from the south-west."""
    return tiles_.orderBy("east_km", "north_km")


def prefer(*sources: DataFrame) -> DataFrame:
    """Per tile the row of the first source that has it; sources have the same columns, east_km and north_km among them."""
    rest = [c for c in sources[0].columns if c not in ("east_km", "north_km")]
    ranked = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = ranked.groupBy("east_km", "north_km").agg(F.min_by(F.struct(*rest), "__rank").alias("__s"), F.min("__rank").alias("source"))
    return best.select("east_km", "north_km", "__s.*", "source")


# --- pages of the states' portals

_GRID = "STRUCT<features: ARRAY<STRUCT<properties: MAP<STRING, STRING>>>>"


def page_grid(pages: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """label and id of the tiles in a GeoJSON text that a page holds between single quotes; of one label the last counts.

    order is the column that pages are ordered by; without it they are ordered by their texts.
    """
    json = F.regexp_extract(F.col(column), r"(?s)(\{[^{']*\"FeatureCollection\"[^']*)", 1)
    page = F.col(order) if order else F.xxhash64(column)
    f = pages.select(page.alias("page"), F.from_json(json, _GRID).alias("g")).select("page", F.posexplode("g.features").alias("i", "f"))
    of = lambda k: F.try_element_at(F.col("f.properties"), F.lit(k))
    rows = f.select("page", "i", of("label").alias("label"), of("id").try_cast("long").alias("id")).dropna(subset=["label", "id"])
    return rows.groupBy("label").agg(F.max_by("id", F.struct("page", "i", "id")).alias("id"))


def item_block(name: Column) -> Column:
    """The 10 km block of names like dgm1_32_572_6020_1_sh_2023: 32570_6020."""
    e, n = tiles.tile_from_item(name)
    ten = lambda v: F.floor(v / 10) * 10
    return F.format_string("32%03d_%04d", ten(e), ten(n))


def overview_jobs(pages: DataFrame, app: str, product: int, extension: str, column: str = "value") -> DataFrame:
    """file and url of each file that an overview page (GeoJSON, plain or under `result`) names; one per file."""
    inner = "features: ARRAY<STRUCT<properties: MAP<STRING, STRING>>>"
    page = F.from_json(column, f"STRUCT<{inner}, result: STRUCT<{inner}>>")
    f = pages.select(page.alias("p")).select(F.explode(F.coalesce("p.result.features", "p.features")).alias("f"))
    of = lambda *ks: F.coalesce(*(F.try_element_at(F.col("f.properties"), F.lit(k)) for k in ks))
    rows = f.select(of("kachel_n", "kaname").alias("name"), F.coalesce(of("jahr"), F.lit("")).alias("year"), of("kach10km", "filepath").alias("block"))
    rows = rows.withColumn("block", F.coalesce("block", F.when(tiles.tile_from_item(F.col("name"))[0].isNotNull(), item_block(F.col("name"))))).dropna(subset=["name", "block"])
    file = F.concat("name", F.lit(extension))
    url = F.concat(F.lit(f"{app}/massen.php?file="), file, F.lit(f"&id={product}&live="), F.col("year"), F.lit("&km="), F.col("block"))
    return one_per_file(rows.select(file.alias("file"), url.alias("url")))


def package_archives(pages: DataFrame, host: str, part: str, fallback: str, column: str = "value") -> DataFrame:
    """url of the zip resources of a package search that lie on the host and have `part` in their address; the fallback if there is none."""
    shape = "STRUCT<result: STRUCT<results: ARRAY<STRUCT<resources: ARRAY<STRUCT<url: STRING>>>>>>"
    urls = pages.select(F.explode(F.flatten(F.transform(F.from_json(column, shape)["result"]["results"], lambda p: F.coalesce(p["resources"]["url"], F.array())))).alias("url"))
    fit = urls.filter(F.contains("url", F.lit(host)) & F.endswith(F.lower("url"), F.lit(".zip")) & F.contains(F.lower("url"), F.lit(part.lower()))).distinct()
    spare = pages.sparkSession.createDataFrame([(fallback, 1)], "url string, __spare int")
    both = fit.withColumn("__spare", F.lit(0)).unionByName(spare)
    least = both.agg(F.min("__spare").alias("__spare"))
    return both.join(F.broadcast(least), "__spare", "left_semi").select("url")


def category_archives(pages: DataFrame, root: str, host: str) -> DataFrame:
    """url of the zip files below a category. pages: path and value, the JSON of a folder: its folders and its downloads.

    A folder's path is its parent's and its name, which has no slash. So its path names all folders on
    the way to it, and it is reached, at any depth, if each of them is listed by the one before: two
    joins instead of a walk. A folder that is listed several times counts once.
    """
    shape = "STRUCT<navigation: ARRAY<STRUCT<name: STRING>>, searchresult: STRUCT<downloads: ARRAY<STRUCT<fileExtension: STRING, downloadLink: STRUCT<uri: STRING>>>>>"
    read = pages.select("path", F.from_json("value", shape).alias("p"))
    inner = read.select("path", F.inline("p.navigation")).filter("name <> ''").select("path", F.concat_ws("/", "path", "name").alias("inner"))
    steps_ = inner.filter((F.col("path") == root) | F.startswith("path", F.lit(root + "/"))).join(read.select(F.col("path").alias("inner")), "inner", "left_semi").distinct()
    reached = pages.sparkSession.createDataFrame([(root,)], "path string").join(read.select("path"), "path", "left_semi").distinct()
    names = F.split(F.substring(F.col("inner"), len(root) + 2, 1 << 30), "/")
    # Of each listed folder the folders on the way to it; it is reached if all of them are listed.
    way = steps_.select("inner", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat_ws("/", F.lit(root), F.slice(names, 1, k)))).alias("at"))
    listed = steps_.select(F.col("inner").alias("at")).distinct()
    whole = way.join(listed, "at", "left_anti").select("inner").distinct()
    below = listed.withColumnRenamed("at", "path").join(whole.withColumnRenamed("inner", "path"), "path", "left_anti")
    folders = reached.unionByName(below)
    files = read.join(folders, "path", "left_semi").select(F.inline("p.searchresult.downloads")).filter(F.lower("fileExtension") == "zip").select(F.col("downloadLink.uri").alias("uri")).filter("uri <> ''")
    return files.select(F.when(F.col("uri").startswith("http"), F.col("uri")).otherwise(F.concat(F.lit(host), F.col("uri"))).alias("url"))
