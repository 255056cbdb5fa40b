"""The datasets: names, kinds of signal, files, and how a file becomes located samples.

Every loader returns ``sample_id`` (the row's place), ``features`` or ``readings`` or raw axes, ``x, y`` and, where known,
``z, floor, building`` and further columns. Files are split into training and test by name, or by a ratio of rows or groups
in file order. Missing values have each dataset's own marker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import polar
from ..functions.signals import beacon_id
from ..operators.shaping import by_position, first_matches, group_split, looked_up, random_split, row_split, united, usable
from ..operators.sequences import first_seen
from ..registry import TRANSFORMS
from . import layouts as L
from .mat import by_first, mat_slices, squeezed

Loader = Callable[["Dataset", SparkSession, str, str, dict], DataFrame]
#: The file of anchors' places, and the modulation of a light whose file tells none.
ANCHORS, MODULATION = "anchor_positions.csv", "OOK"
LABELS = ("x", "y", "z", "floor", "building", "building_id", "timestamp", "src_idx", "environment", "env", "id", "trajectory", "scenario", "room", "area")


@dataclass(frozen=True)
class Dataset:
    """``files``: per split a list of file names under the root, or under ``all`` those of both."""

    name: str
    signal: str
    load: Loader
    files: dict[str, list[str]]
    absent: float | None = None
    ratio: float = 0.7
    aliases: tuple[str, ...] = ()
    width: int | None = None
    marks: tuple[str, ...] = ("csi",)
    only: dict[str, str] = field(default_factory=dict)  # a filter's name: the column that it selects by
    group: str | None = None
    places: tuple[str, ...] = ("",)  # what stands before x and y in the columns of places, the first that a file has

    def paths(self, root: str, split: str) -> list[str]:
        return [f"{root}/{f}" for f in self.files.get(split, self.files.get("all", []))]


def selected(df: DataFrame, spec: Dataset, options: dict) -> DataFrame:
    """Rows whose columns are among the values that ``options`` name; numbers compare as numbers, names as text."""
    for option, column in spec.only.items():
        wanted = options.get(option)
        if wanted is not None and column in df.columns:
            values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
            cell = F.col(column).try_cast("int") if column in ("floor", "trajectory", "env") else F.col(column).cast("string")
            df = df.where(cell.isin([int(v) for v in values] if column in ("floor", "trajectory", "env") else [str(v) for v in values]))
    return df


def parted(df: DataFrame, spec: Dataset, split: str, options: dict) -> DataFrame:
    if "all" not in spec.files:
        return df
    ratio, train = options.get("train_ratio", spec.ratio), split == "train"
    if spec.name == "deepmimo":
        return random_split(df, ratio, "src_idx", train=train)
    return group_split(df, ratio, spec.group, train=train) if spec.group else row_split(df, ratio, "src_idx", train=train)


def named(df: DataFrame) -> DataFrame:
    """Common names of ids and labels in front."""
    front = [c for c in ("src_idx", "features", "readings", "x", "y", "z", "floor", "building") if c in df.columns]
    return df.select(*(F.col(c).alias("sample_id") if c == "src_idx" else F.col(c) for c in front), *(c for c in df.columns if c not in front))


def _uji(spec, spark, root, split, options):
    names = ["x", "y", "floor", "building", "space_id", "relative_position", "user_id", "phone_id", "timestamp"]
    df = L.positional_csv(spark, spec.paths(root, split)[0], 520, names)
    whole = ("floor", "space_id", "relative_position", "user_id", "phone_id")
    return df.withColumns({c: F.col(c).cast("int") for c in whole} | {"building": F.col("building").cast("int").cast("string")})


def _site_files(spec, spark, root, split, options):
    """One file per building; vectors are padded to the widest."""
    from ..functions.vectors import padded

    wanted = options.get("building")
    chosen = [p for p in spec.paths(root, split) if wanted is None or any(str(b) in p for b in (wanted if isinstance(wanted, (list, tuple)) else [wanted]))]
    parts, width = [], 0
    for k, path in enumerate(chosen):
        df = L.header_csv(spark, path)
        cut = df.columns.index("ECoord")
        width = max(width, cut)
        df = df.select((F.col("src_idx") + k * (1 << 50)).alias("src_idx"), L.vector(df.columns[:cut], spec.absent).alias("features"), L.number(df, "ECoord").alias("x"), L.number(df, "NCoord").alias("y"), L.floor_of(F.col("FloorID")).alias("floor"), L.floor_of(F.col("BuildingID")).cast("string").alias("building"))
        parts.append(df)
    return united(*parts).withColumn("features", padded(F.col("features"), width, spec.absent))


def _long_term(spec, spark, root, split, options):
    wanted = options.get("building")
    numbers = [str(b) for b in (wanted if isinstance(wanted, (list, tuple)) else [wanted])] if wanted is not None else ["0", "1", "2"]
    df = L.text_matrix(spark, [p for p in spec.paths(root, split) if any(p.endswith(f"DB{n}.txt") for n in numbers)])
    return df.withColumn("building", F.regexp_extract("file", r"DB(\d+)\.txt", 1)).drop("file")


def _wlan(spec, spark, root, split, options):
    df = L.text_records(spark, spec.paths(root, split)[0], 14)
    at = lambda k: F.get("c", F.lit(k)).try_cast("double")
    rows = df.select("src_idx", F.array(*(at(k) for k in range(7, 14))).alias("features"), at(2).alias("x"), at(3).alias("y"), at(4).cast("int").alias("floor"), F.get("c", F.lit(5)).alias("user_id"), F.get("c", F.lit(6)).alias("phone_id"))
    return rows.where("x is not null and y is not null and floor is not null and not exists(features, v -> v is null)")


def _wide(spec, spark, root, split, options):
    """A header, labels, and features in the columns whose names hold a mark, or all others if the marks are empty."""
    df = L.header_csv(spark, spec.paths(root, split))
    pick = lambda columns: [c for c in columns if c not in LABELS and (not spec.marks or any(m in c.lower() for m in spec.marks))]
    if spec.name == "csi2pos":
        kind = {"csi": ("csi",), "per": ("per",), "both": ("csi", "per")}[options.get("feature_type", "csi")]
        pick = lambda columns: [c for c in columns if any(m in c.lower() for m in kind)]
    if spec.name == "opencsi":
        pick = lambda columns: [c for c in columns if c not in ("x", "y", "trajectory")][:1200]
    df = L.wide(df, pick, fill=spec.absent, width=spec.width)
    x, y = (L.number(df, *(f"{prefix}{c}" for prefix in spec.places)) for c in "xy")
    if spec.name == "wifi_csi_d2d":
        x, y = polar(L.number(df, "distance"), L.number(df, "angle"))
    z = L.number(df, "z", "gps_z", "altitude")
    extra = [F.col(c) for c in ("environment", "env", "trajectory", "scenario", "room", "area", "timestamp") if c in df.columns]
    floor = L.floor_of(F.col("z")) if spec.name == "haloc" and "z" in df.columns else L.number(df, "floor", default=None).cast("int")
    return df.select("src_idx", "features", x.alias("x"), y.alias("y"), z.alias("z"), floor.alias("floor"), L.text(df, "building", "building_id", "room").alias("building"), *extra)


def _pairs_dense(spec, spark, root, split, options):
    """(id, RSSI) pairs to vectors over all ids of the file; ids are taken before any filter."""
    df = L.header_csv(spark, spec.paths(root, split))
    pairs = L.paired(df.columns, r"BSSID_?(\d+)", r"RSSI_?(\d+)")
    rows = L.readings(df, pairs).select("src_idx", "readings", L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), L.number(df, "floor").cast("int").alias("floor"))
    return L.densified(rows, spec.absent)


def _ble(spec, spark, root, split, options):
    wanted = options.get("floor")
    floors = [str(f) for f in (wanted if isinstance(wanted, (list, tuple)) else [wanted])] if wanted is not None else None
    paths = [p for p in spec.paths(root, split) if floors is None or any(f"floor{f}_" in p for f in floors)]
    df = L.header_csv(spark, paths).withColumn("floor", F.regexp_extract(F.input_file_name(), r"floor(\d+)_", 1).cast("int"))
    pairs = L.paired(df.columns, r"beacon_mac_?(\d+)", r"rssi_?(\d+)")
    return L.readings(df, pairs).select("src_idx", "readings", L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), "floor")


def _ibeacon(spec, spark, root, split, options):
    df = L.header_csv(spark, spec.paths(root, split))
    rows = df.select("src_idx", L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), L.number(df, "floor").cast("int").alias("floor"), beacon_id(F.col("beacon_uuid"), F.col("beacon_major"), F.col("beacon_minor"), F.lit(None).cast("string")).alias("id"), L.number(df, "rssi").alias("rssi"))
    known = rows.where("x is not null and y is not null and floor is not null")
    one = known.groupBy("x", "y", "floor", "id").agg(F.max_by("rssi", "src_idx").alias("rssi"), F.min("src_idx").alias("src_idx"))
    return one.groupBy("x", "y", "floor").agg(F.min("src_idx").alias("src_idx"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "rssi")))).alias("readings"))


def _ble_uci(spec, spark, root, split, options):
    """Labels get places 5 m apart, in order of their first row in the whole file."""
    df = L.header_csv(spark, spec.paths(root, split))
    columns = [c for c in df.columns if c.lower().startswith("b30")]
    places = first_seen(df, "location", "src_idx")
    df = looked_up(df.withColumn("features", L.vector(columns, spec.absent)), places, "location")
    return df.select("src_idx", "features", (F.col("place") * 5.0).alias("x"), F.lit(0.0).alias("y"), "location")


def _anchors(spec, spark, root, split, options):
    """anchor{N}_id and anchor{N}_distance cells to a map; samples without a known anchor go.

    ``positions`` has the places of those anchors that a file of them knows, if there is one.
    """
    df = L.header_csv(spark, spec.paths(root, split))
    rows = L.readings(df, L.paired(df.columns, r"anchor(\d+)_id", r"anchor(\d+)_distance"))
    rows = rows.select("src_idx", "readings", *(L.number(df, c).alias(c) for c in "xyz"), L.number(df, "floor").cast("int").alias("floor"))
    if not L.there(spark, at := f"{root}/{ANCHORS}"):
        return rows.withColumn("positions", F.expr("cast(map() as map<string, struct<x: double, y: double, z: double>>)"))
    dim = L.header_csv(spark, at).select(F.trim("anchor_id").alias("id"), *(F.col(c).try_cast("double").alias(c) for c in "xyz"), "src_idx")
    dim = dim.groupBy("id").agg(F.max_by(F.struct(*"xyz"), "src_idx").alias("at"))  # of repeated ids the last line stays
    long = looked_up(rows.select("src_idx", F.explode(F.map_keys("readings")).alias("id")), dim, "id").where("at is not null")
    places = long.groupBy("src_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "at")))).alias("positions"))
    return rows.join(places, "src_idx", "left").withColumn("positions", F.coalesce("positions", F.expr("cast(map() as map<string, struct<x: double, y: double, z: double>>)")))


def _measurements(spec, spark, root, split, options):
    """Long rows by measurement, joined with the transmitters' places."""
    df = L.header_csv(spark, f"{root}/{spec.files['all'][0]}")
    dim = spark.read.option("header", True).csv(f"{root}/{spec.files['all'][1]}")
    key = "led_id" if spec.signal == "vlc" else "anchor_id"
    light = spec.signal == "vlc"
    value = L.number(df, "rssi", default=spec.absent) if light else L.number(df, "distance")
    more = [L.number(df, "snr").alias("snr"), (F.col("modulation") if "modulation" in df.columns else F.lit(MODULATION)).alias("modulation")] if light else []
    group = F.col("measurement_id").cast("string") if "measurement_id" in df.columns else F.concat_ws("/", "x", "y", "z")
    rows = df.select("src_idx", group.alias("measurement_id"), *(L.number(df, c).alias(c) for c in "xyz"), F.col(key), value.alias("value"), *more)
    placed = looked_up(rows, dim.select(F.col(key), *(F.col(c).try_cast("double").alias(f"{key[:-3]}_{c}") for c in "xyz")), key)
    item = F.struct(F.col("src_idx").alias("k"), F.col(key), "value", *(f"{key[:-3]}_{c}" for c in "xyz"), *(("snr", "modulation") if light else ()))
    return placed.groupBy("measurement_id").agg(F.min("src_idx").alias("src_idx"), *(F.min_by(c, "src_idx").alias(c) for c in "xyz"), F.array_sort(F.collect_list(item)).alias("transmitters"))


def _axes(spec, spark, root, split, options):
    df = L.header_csv(spark, spec.paths(root, split))
    return df.select("src_idx", F.array(*(L.number(df, f"mag_{c}") for c in "xyz")).alias("features"), L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), L.number(df, "floor").cast("int").alias("floor"), L.text(df, "building").alias("building"), L.number(df, "timestamp", default=None).alias("timestamp"))


def _beacons(spec, spark, root, split, options):
    """beacon{N}_id, _tof and _distance cells, all three known; the flight times are the readings."""
    df = L.header_csv(spark, spec.paths(root, split))
    cells = [F.struct(F.trim(F.col(i)).alias("id"), F.col(t).try_cast("double").alias("t"), F.col(d).try_cast("double").alias("d")) for i, t, d in L.paired(df.columns, r"beacon(\d+)_id", r"beacon(\d+)_tof", r"beacon(\d+)_distance")]
    good = F.filter(F.array(*cells), lambda e: usable(e["id"]) & e["t"].isNotNull() & e["d"].isNotNull())
    rows = df.withColumn("g", good).where(F.size("g") > 0)
    return rows.select("src_idx", F.map_from_entries(F.transform("g", lambda e: F.struct(e["id"], e["t"]))).alias("readings"), F.map_from_entries(F.transform("g", lambda e: F.struct(e["id"], e["d"]))).alias("distances"), *(L.number(df, c).alias(c) for c in "xyz"))


def _places(spec, spark, root, split, options):
    df = L.header_csv(spark, spec.paths(root, split))
    return df.select("src_idx", L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), L.number(df, "floor").cast("int").alias("floor"))


def _hybrid(spec, spark, root, split, options):
    """A map of feature vectors by modality, from one wide file, from files joined by row, or by sample_id."""
    axes = {"imu": [f"{s}_{c}" for s in ("acc", "gyro", "mag") for c in "xyz"], "magnetic": [f"mag_{c}" for c in "xyz"]}
    wap = lambda df: [c for c in df.columns if c.lower().startswith("wap")]
    paths = spec.paths(root, split)
    parts = [L.header_csv(spark, p) for p in paths]
    made, labels = [], parts[-1]
    if spec.name == "sensor_fusion":
        wifi, ble, mag, labels = parts
        ble_pairs = L.paired(ble.columns, r"beacon(?:_mac)?_?(\d+)(?:_mac)?", r"(?:beacon_?)?(?:rssi_?)?(\d+)(?:_rssi)?")
        sides = [wifi.select("sample_id", "src_idx", L.vector(wap(wifi), spec.absent).alias("wifi"))]
        if ble_pairs:
            told = L.readings(ble, ble_pairs).select("sample_id", "src_idx", "readings")
            sides.append(L.densified(told, -100.0).select("sample_id", "src_idx", F.col("features").alias("ble")))
        sides.append(mag.select("sample_id", "src_idx", L.vector(axes["magnetic"], None).alias("magnetic")))
        df = labels
        for side in sides:
            df = first_matches(df, side, "sample_id", "src_idx")
        made = [side.columns[-1] for side in sides]
    elif len(parts) == 3:
        wifi, imu, labels = parts
        place = lambda d, *c: L.counted(d).select("src_idx", *c)
        df = by_position([L.counted(labels), place(wifi, L.vector(wap(wifi), spec.absent).alias("wifi")), place(imu, L.vector([c for c in axes["imu"] if c in imu.columns], None).alias("imu"))])
        made = ["wifi", "imu"]
    else:
        df = parts[0]
        df = df.withColumn("wifi", L.vector(wap(df), spec.absent))
        made = ["wifi"]
        if spec.name == "multimodal":
            pairs = L.paired(df.columns, r"beacon(\d+)_mac", r"beacon(\d+)_rssi")
            df = df.withColumn("ble", F.array(*(F.coalesce(F.col(r).try_cast("double"), F.lit(-100.0)) for _, r in pairs))) if pairs else df
            df = df.withColumn("imu", L.vector([c for c in axes["imu"] if c in df.columns], None))
            made += ["ble"] * bool(pairs) + ["imu"]
        else:
            df = df.withColumn("magnetic", L.vector(axes["magnetic"], None))
            made.append("magnetic")
        labels = parts[0]
    parts_of = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made)), lambda _, v: v.isNotNull())
    df = df.withColumn("modalities", parts_of).where(F.size("modalities") > 0)
    return df.select("src_idx", "modalities", L.number(df, "x").alias("x"), L.number(df, "y").alias("y"), L.number(df, "floor").cast("int").alias("floor"), L.text(df, "building").alias("building"))


def _mimo(spec, spark, root, split, options):
    """Channels of MAT files: ``features`` are complex values, one row per user; scenarios are the files' names.

    Channels and places are arrays along users, or fields of a struct with an entry for each user, which then count alone. A
    user without a place, or with fewer than two coordinates, is at 0.
    """
    wanted = options.get("scenario")
    scenarios = wanted if isinstance(wanted, (list, tuple)) else [wanted] if wanted else ["*"]
    found, name = mat_slices(spark, [f"{root}/{s}.mat" for s in scenarios]), F.lower("name")
    struct, field = name == "user", F.lower("field")
    what = F.when((struct & (field == "channel")) | ((field == "") & name.isin("channel", "channels", "h", "csi")), "h")
    what = what.when((struct & (field == "loc")) | ((field == "") & name.isin("user_loc", "user_locs", "locations", "loc", "pos", "position")), "p")
    shape = F.when(struct, F.concat(F.array(F.lit(1)), "shape")).otherwise(squeezed(F.col("shape")))
    rows = by_first(found.withColumn("_what", what).where("_what is not null").withColumn("shape", shape))
    rows = rows.withColumn("what", F.when(F.lower("field").isin("channel") | name.isin("channel", "channels", "h", "csi"), "h").otherwise("p"))
    rows = rows.withColumn("user", F.when(struct, F.col("index")).otherwise(F.col("i").cast("long")))
    alone = rows.where(struct).select("file", "what").distinct()
    rows = rows.where(struct).unionByName(rows.where(~struct).join(alone, ["file", "what"], "left_anti"))
    told = rows.where("what = 'p'").select("file", "user", F.col("re").alias("place"))
    both = rows.where("what = 'h'").join(told, ["file", "user"], "left")
    values = F.zip_with("re", F.coalesce("im", F.array_repeat(F.lit(0.0), F.size("re"))), lambda a, b: F.struct(a.alias("re"), b.alias("im")))
    at = lambda k, least: F.coalesce(F.when(F.size("place") >= least, F.get("place", F.lit(k))), F.lit(0.0))
    scenario = F.regexp_extract("file", r"([^/]+)\.mat$", 1)
    return both.select((F.xxhash64(scenario) + F.col("user")).alias("src_idx"), values.alias("features"), at(0, 2).alias("x"), at(1, 2).alias("y"), at(2, 3).alias("z"), scenario.alias("scenario"))


def _two(train: str, test: str) -> dict[str, list[str]]:
    return {"train": [train], "test": [test]}


def _csi(name: str, *, aliases: tuple[str, ...] = (), absent: float | None = None, width: int | None = None, marks: tuple[str, ...] = ("csi",), only: dict | None = None, file: str = "data.csv", places: tuple[str, ...] = ("",)) -> Dataset:
    return Dataset(name, "csi", _wide, {"all": [file]}, absent, aliases=aliases, width=width, marks=marks, only=only or {}, places=places)


_FLOORS = [0, 1, 2, 3, 4]
#: Names of the public datasets, of their files and columns, and their markers of missing values.
CATALOG: dict[str, Dataset] = {d.name: d for d in (
    Dataset("ujindoorloc", "wifi", _uji, _two("trainingData.csv", "validationData.csv"), 100.0, aliases=("uji",), only={"building": "building"}),
    Dataset("sodindoorloc", "wifi", _site_files, {"train": ["CETC331/Training_CETC331.csv", "HCXY/Training_HCXY_All_30.csv", "SYL/Training_SYL_All_30.csv"], "test": ["CETC331/Testing_CETC331.csv", "HCXY/Testing_HCXY.csv", "SYL/Testing_SYL.csv"]}, 100.0, aliases=("sod",)),
    Dataset("longtermwifi", "wifi", _long_term, {"train": [f"TRNDB{b}.txt" for b in range(3)], "test": [f"TSTDB{b}.txt" for b in range(3)]}, 100.0, aliases=("longterm",)),
    Dataset("tampere", "wifi", _wide, _two("train.csv", "test.csv"), None, marks=("wap",), only={"building": "building"}),
    Dataset("wlanrssi", "wifi", _wlan, {"all": ["dataset.txt"]}, -110.0, aliases=("wlan",), only={"floor": "floor"}),
    Dataset("tuji1", "wifi", _pairs_dense, _two("training_data.csv", "test_data.csv"), -110.0, only={"floor": "floor"}),
    Dataset("rss_based", "wifi", _wide, _two("train_rss.csv", "test_rss.csv"), 100.0, marks=("wap",), only={"building": "building", "floor": "floor"}),
    Dataset("ble_indoor", "ble", _ble, {s: [f"floor{f}_{s}.csv" for f in _FLOORS] for s in ("train", "test")}, -100.0, aliases=("ble",)),
    Dataset("ibeacon_rssi", "ble", _ibeacon, _two("train.csv", "test.csv"), -100.0, aliases=("ibeacon",), only={"floor": "floor"}),
    Dataset("ble_rssi_uci", "ble", _ble_uci, {"all": ["iBeacon_RSSI_Labeled.csv"]}, -200.0),
    Dataset("uwb_indoor", "uwb", _anchors, _two("train_data.csv", "test_data.csv"), aliases=("uwb",), only={"floor": "floor"}),
    Dataset("uwb_ranging", "uwb", _measurements, {"all": ["ranging_measurements.csv", "anchor_config.csv"]}),
    Dataset("magnetic_indoor", "magnetic", _axes, _two("train_magnetic.csv", "test_magnetic.csv"), aliases=("magnetic",), only={"building": "building", "floor": "floor"}),
    Dataset("vlc_indoor", "vlc", _measurements, {"all": ["vlc_measurements.csv", "led_positions.csv"]}, -100.0, aliases=("vlc",)),
    Dataset("ultrasound", "ultrasound", _beacons, {"all": ["ultrasound_data.csv"]}),
    Dataset("rfid_indoor", "rfid", _places, {"all": ["rfid_data.csv"]}, aliases=("rfid",)),
    Dataset("wifi_imu", "hybrid", _hybrid, {s: [f"{s}_{k}.csv" for k in ("wifi", "imu", "labels")] for s in ("train", "test")}, 100.0),
    Dataset("wifi_magnetic", "hybrid", _hybrid, {"all": ["wifi_magnetic_data.csv"]}, 100.0),
    Dataset("multimodal", "hybrid", _hybrid, _two("train_data.csv", "test_data.csv"), 100.0),
    Dataset("sensor_fusion", "hybrid", _hybrid, {s: [f"{s}/{k}.csv" for k in ("wifi", "ble", "magnetic", "labels")] for s in ("train", "test")}, 100.0),
    _csi("csi_indoor", aliases=("csi",), absent=-80.0, marks=("csi_amp",), only={"floor": "floor"}, file="csi_measurements.csv"),
    _csi("csi_fingerprint", width=90, marks=("csi", "amp"), only={"area": "area"}),
    _csi("hwild", width=90, only={"environment": "environment"}, places=("uwb_coordinate_", "")),
    _csi("csu", absent=-100.0, marks=("csi", "rssi", "wap"), only={"building": "building"}),
    _csi("wild_v2", aliases=("wildv2",), marks=(), only={"env": "env"}),
    _csi("opencsi", absent=None),
    _csi("haloc", only={"trajectory": "trajectory"}),
    _csi("csi_bench", aliases=("csibench",), width=256, only={"environment": "environment"}),
    _csi("mamimo_csi", aliases=("mamimo",), width=6656, marks=("csi", "h_")),
    _csi("dichasus", width=2048, marks=("csi", "h_"), only={"scenario": "scenario"}),
    _csi("espargos", width=512),
    _csi("csi2pos", places=("", "grid_")),
    _csi("csi2taoa", width=1024, marks=("csi", "taoa")),
    Dataset("deepmimo", "csi", _mimo, {"all": []}, ratio=0.8),
    _csi("mamimo_uav", marks=("csi", "h_"), only={"trajectory": "trajectory"}),
    _csi("wifi_csi_d2d"),
)}


def resolve(name: str) -> str:
    """A dataset's name from a name or alias, in any case, with - or blanks for _; else one that contains it or the reverse."""
    wanted = name.lower().replace("-", "_").replace(" ", "_")
    known = {n: d.name for d in CATALOG.values() for n in (d.name, *d.aliases)}
    if wanted in known:
        return known[wanted]
    for n, found in known.items():
        if wanted in n or n in wanted:
            return found
    raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(CATALOG))}")


def list_datasets(signal: str | None = None) -> list[str]:
    return sorted(d.name for d in CATALOG.values() if signal is None or d.signal == signal.lower())


def dataset_info(name: str) -> dict:
    d = CATALOG[resolve(name)]
    return {"name": d.name, "signal": d.signal, "aliases": list(d.aliases), "files": d.files, "absent": d.absent, "train_ratio": d.ratio if "all" in d.files else None, "filters": sorted(d.only)}


def catalog_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.signal, list(d.aliases)) for d in CATALOG.values()], "name string, signal string, aliases array<string>")


def load_dataset(spark: SparkSession, name: str, root: str, split: str | None = None, **options):
    """The rows of one split ``train`` or ``test``, of both (``all``, one table), or a pair of tables (None).

    ``options``: the dataset's filters, ``train_ratio``, ``feature_type``; ``required=True`` raises ValueError for no rows;
    ``transform`` is a function of a table, the name of one in the registry of transforms, or a list of these, in order.
    """
    spec = CATALOG[resolve(name)]
    if split is None:
        return tuple(load_dataset(spark, name, root, s, **options) for s in ("train", "test"))
    if split == "all":
        return united(*load_dataset(spark, name, root, None, **options))
    if split not in ("train", "test"):
        raise ValueError(f"split is 'train', 'test', 'all' or None, not {split!r}")
    out = named(parted(selected(spec.load(spec, spark, root, split, options), spec, options), spec, split, options))
    if options.get("required") and out.isEmpty():
        raise ValueError(f"{spec.name}: no rows are left")
    return transformed(out, options.get("transform"))


def transformed(df: DataFrame, steps) -> DataFrame:
    """``df`` through one or more functions of a table, given themselves, by name, or as settings with ``type``."""
    for step in steps if isinstance(steps, (list, tuple)) else [steps] if steps else []:
        df = step(df) if callable(step) else TRANSFORMS.build(step if isinstance(step, dict) else {"type": step}, df=df)
    return df
