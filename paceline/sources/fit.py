"""Binary FIT files as activity tables.

``messages`` decodes files that Spark's binaryFile reader delivers, one row per message, in Arrow
batches; a file that can't be decoded gives one row with its error and stops nothing else. Everything
after that (projection, coercion, cadence, steps) is DataFrame expressions. Field numbers, scales and
enumerations are those of the public FIT profile.
"""

from __future__ import annotations

import struct
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import degrees_of_semicircles, half_even
from paceline.operators.steps import attach_steps
from paceline.schema import Activities
from paceline.sources import errors
from paceline.sources.errors import ReadError

EPOCH = 631_065_600
#: Struct codes and invalid markers by base type number.
BASE_TYPES = {0: ("B", 0xFF), 1: ("b", 0x7F), 2: ("B", 0xFF), 3: ("h", 0x7FFF), 4: ("H", 0xFFFF), 5: ("i", 0x7FFFFFFF), 6: ("I", 0xFFFFFFFF), 7: ("s", None), 8: ("f", None), 9: ("d", None), 10: ("B", 0), 11: ("H", 0), 12: ("I", 0), 13: ("B", None), 14: ("q", 0x7FFFFFFFFFFFFFFF), 15: ("Q", 0xFFFFFFFFFFFFFFFF), 16: ("Q", 0)}
#: Messages read, and their fields as number: (name, scale, offset).
MESSAGES = {12: "sport", 18: "session", 19: "lap", 20: "record", 21: "event", 27: "workout_step"}
FIELDS = {
    "sport": {0: ("sport", 1, 0), 1: ("sub_sport", 1, 0)},
    "session": {253: ("timestamp", 1, 0), 2: ("start_time", 1, 0), 3: ("start_position_lat", 1, 0), 4: ("start_position_long", 1, 0), 5: ("sport", 1, 0), 6: ("sub_sport", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 14: ("avg_speed", 1000, 0), 16: ("avg_heart_rate", 1, 0), 17: ("max_heart_rate", 1, 0), 18: ("avg_cadence", 1, 0), 22: ("total_ascent", 1, 0), 23: ("total_descent", 1, 0), 57: ("avg_temperature", 1, 0), 58: ("max_temperature", 1, 0), 92: ("avg_fractional_cadence", 128, 0), 124: ("enhanced_avg_speed", 1000, 0)},
    "lap": {253: ("timestamp", 1, 0), 2: ("start_time", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 15: ("avg_heart_rate", 1, 0), 16: ("max_heart_rate", 1, 0), 17: ("avg_cadence", 1, 0), 21: ("total_ascent", 1, 0), 22: ("total_descent", 1, 0), 23: ("intensity", 1, 0), 25: ("sport", 1, 0), 50: ("avg_temperature", 1, 0), 51: ("max_temperature", 1, 0), 71: ("wkt_step_index", 1, 0), 80: ("avg_fractional_cadence", 128, 0)},
    "record": {253: ("timestamp", 1, 0), 0: ("position_lat", 1, 0), 1: ("position_long", 1, 0), 2: ("altitude", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 9: ("grade", 100, 0), 13: ("temperature", 1, 0), 53: ("fractional_cadence", 128, 0), 73: ("enhanced_speed", 1000, 0), 78: ("enhanced_altitude", 5, 500)},
    "event": {253: ("timestamp", 1, 0), 0: ("event", 1, 0), 1: ("event_type", 1, 0)},
    "workout_step": {254: ("message_index", 1, 0), 0: ("wkt_step_name", 1, 0), 1: ("duration_type", 1, 0), 2: ("duration_value", 1, 0), 3: ("target_type", 1, 0), 4: ("target_value", 1, 0), 5: ("custom_target_low", 1, 0), 6: ("custom_target_high", 1, 0), 7: ("intensity", 1, 0), 19: ("secondary_target_type", 1, 0)},
}
#: Enumerations.
SPORTS = {
    0: "generic", 1: "running", 2: "cycling", 3: "transition", 4: "fitness_equipment", 5: "swimming", 6: "basketball", 7: "soccer", 8: "tennis", 9: "american_football",
    10: "training", 11: "walking", 12: "cross_country_skiing", 13: "alpine_skiing", 14: "snowboarding", 15: "rowing", 16: "mountaineering", 17: "hiking", 18: "multisport", 19: "paddling",
    20: "flying", 21: "e_biking", 22: "motorcycling", 23: "boating", 24: "driving", 25: "golf", 26: "hang_gliding", 27: "horseback_riding", 28: "hunting", 29: "fishing",
    30: "inline_skating", 31: "rock_climbing", 32: "sailing", 33: "ice_skating", 34: "sky_diving", 35: "snowshoeing", 36: "snowmobiling", 37: "stand_up_paddleboarding", 38: "surfing", 39: "wakeboarding",
    40: "water_skiing", 41: "kayaking", 42: "rafting", 43: "windsurfing", 44: "kitesurfing", 45: "tactical", 46: "jumpmaster", 47: "boxing", 48: "floor_climbing", 53: "diving", 254: "all",
}
SUB_SPORTS = {
    0: "generic", 1: "treadmill", 2: "street", 3: "trail", 4: "track", 5: "spin", 6: "indoor_cycling", 7: "road", 8: "mountain", 9: "downhill",
    10: "recumbent", 11: "cyclocross", 12: "hand_cycling", 13: "track_cycling", 14: "indoor_rowing", 15: "elliptical", 16: "stair_climbing", 17: "lap_swimming", 18: "open_water", 19: "flexibility_training",
    20: "strength_training", 21: "warm_up", 22: "match", 23: "exercise", 24: "challenge", 25: "indoor_skiing", 26: "cardio_training", 27: "indoor_walking", 28: "e_bike_fitness", 29: "bmx",
    30: "casual_walking", 31: "speed_walking", 32: "bike_to_run_transition", 33: "run_to_bike_transition", 34: "swim_to_bike_transition", 35: "atv", 36: "motocross", 37: "backcountry", 38: "resort", 39: "rc_drone",
    40: "wingsuit", 41: "whitewater", 42: "skate_skiing", 43: "yoga", 44: "pilates", 45: "indoor_running", 46: "gravel_cycling", 47: "e_bike_mountain", 48: "commuting", 49: "mixed_surface",
    50: "navigate", 51: "track_me", 52: "map", 53: "single_gas_diving", 54: "multi_gas_diving", 55: "gauge_diving", 56: "apnea_diving", 57: "apnea_hunting", 58: "virtual_activity", 59: "obstacle", 254: "all",
}
INTENSITIES = {0: "active", 1: "rest", 2: "warmup", 3: "cooldown", 4: "recovery", 5: "interval", 6: "other"}
EVENT_TYPES = {0: "start", 1: "stop", 2: "consecutive_depreciated", 3: "marker", 4: "stop_all", 5: "begin_depreciated", 6: "end_depreciated", 7: "end_all_depreciated", 8: "stop_disable", 9: "stop_disable_all"}
DURATIONS = {
    0: "time", 1: "distance", 2: "hr_less_than", 3: "hr_greater_than", 4: "calories", 5: "open", 6: "repeat_until_steps_cmplt", 7: "repeat_until_time", 8: "repeat_until_distance", 9: "repeat_until_calories",
    10: "repeat_until_hr_less_than", 11: "repeat_until_hr_greater_than", 12: "repeat_until_power_less_than", 13: "repeat_until_power_greater_than", 14: "power_less_than", 15: "power_greater_than", 28: "repetition_time", 29: "reps",
}
TARGETS = {0: "speed", 1: "heart_rate", 2: "open", 3: "cadence", 4: "power", 5: "grade", 6: "resistance", 7: "power_3s", 8: "power_10s", 9: "power_30s", 10: "power_lap", 11: "swim_stroke", 12: "speed_lap", 13: "heart_rate_lap"}
SCHEMA = f"activity_id string, pos long, message string, numbers map<string, double>, texts map<string, string>, problem {errors.PROBLEM}"


def _crc_of_byte(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xA001 if b & 1 else 0)
    return b


CRC_TABLE = [_crc_of_byte(b) for b in range(256)]


def crc16(data: bytes) -> int:
    crc, table = 0, CRC_TABLE
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc


def body_of(data: bytes) -> tuple[int, int]:
    """Where the messages of a file begin and end; ReadError if header, length or checksum are wrong."""
    if len(data) < 14 or data[8:12] != b".FIT" or data[0] not in (12, 14):
        raise ReadError("no_header", 0, "no FIT header")
    size = int.from_bytes(data[4:8], "little")
    end = data[0] + size
    if not size:
        raise ReadError("empty_body", data[0], "empty body")
    if len(data) < end + 2:
        raise ReadError("truncated", len(data), f"truncated, {end + 2 - len(data)} bytes are missing")
    if crc16(data[:end]) != int.from_bytes(data[end : end + 2], "little"):
        raise ReadError("wrong_checksum", end, "wrong checksum")
    return data[0], end


def decode(data: bytes):
    """Yields (message, numbers, texts) of one file; a field that a message has twice is unknown; raises ReadError if it isn't a sound FIT file."""
    (at, end), kinds, last_time = body_of(data), {}, None
    try:
        while at < end:
            head = data[at]
            at += 1
            if not head & 0x80 and head & 0x40:  # a definition
                order = ">" if data[at + 1] else "<"
                number, n = struct.unpack_from(order + "H", data, at + 2)[0], data[at + 4]
                fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
                at += 5 + 3 * n
                extra = 0
                if head & 0x20:
                    extra = sum(data[at + 2 + 3 * k] for k in range(data[at]))
                    at += 1 + 3 * data[at]
                kinds[head & 0x0F] = (order, number, fields, extra)
                continue
            order, number, fields, extra = kinds[head >> 5 & 3 if head & 0x80 else head & 0x0F]
            name = MESSAGES.get(number)
            numbers: dict[str, float] = {}
            texts: dict[str, str] = {}
            counts = Counter(field for field, _, _ in fields)
            for field, width, base in fields:
                raw = data[at : at + width]
                at += width
                code, invalid = BASE_TYPES[base & 0x1F]
                if code == "s":
                    value = raw.split(b"\0")[0].decode("utf-8", "replace")
                elif width != struct.calcsize(code):
                    continue  # an array: not a single value
                else:
                    value = struct.unpack(order + code, raw)[0]
                    if value == invalid or value != value:
                        continue
                if field == 253:
                    last_time = value
                if name and field in FIELDS[name] and counts[field] == 1:
                    label, scale, offset = FIELDS[name][field]
                    if code == "s":
                        texts[label] = value
                    else:
                        numbers[label] = value / scale - offset if scale != 1 or offset else float(value)
            at += extra
            if head & 0x80 and last_time is not None:
                last_time += (head - last_time) & 0x1F
                numbers["timestamp"] = float(last_time)
            if name:
                yield name, numbers, texts
    except (KeyError, IndexError, struct.error) as e:
        raise ReadError("malformed", at, f"malformed: {e!r}") from e


def fit_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, content of the .fit files directly in path (or of that file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[fF][iI][tT]").load(path).select("path", "content")


def messages(spark: SparkSession, path: str | list[str], only: DataFrame | None = None) -> DataFrame:
    """One row per message of the .fit files directly in path (or of that file), or the file's error; only: paths (path) to keep."""
    files = fit_files(spark, path)
    return decoded(files if only is None else files.join(only, "path", "left_semi"))


def decoded(files: DataFrame) -> DataFrame:
    """One row per message of files (path, content), or the file's error."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found, error = [], None
                try:
                    found = list(decode(data.as_py()))
                    if sum(m == "session" for m, _, _ in found) > 1:
                        raise ReadError("several_sessions", None, "several sessions")
                    if not found:
                        raise ReadError("no_messages", None, "no messages")
                except ReadError as e:
                    found, error = [], e.row()
                table = [(name, k, m, list(n.items()), list(t.items()), None) for k, (m, n, t) in enumerate(found)] or [(name, 0, None, [], [], error)]
                types = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.float64()), pa.map_(pa.string(), pa.string()), errors.ARROW]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*table, strict=True), types, strict=True)], names=["activity_id", "pos", "message", "numbers", "texts", "problem"])

    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def _label(value: Column, names: dict[int, str]) -> Column:
    """The name of a code; a code without one stays a number, as text."""
    code = value.cast("int")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code), code.cast("string"))


def tables(found: DataFrame) -> tuple[Activities, DataFrame]:
    """The activity tables of decoded messages, and the files that failed (activity_id, error: a line, problem: kind, offset, detail)."""
    n = lambda name: F.col("numbers").getItem(name)
    time = lambda name: F.timestamp_seconds(n(name) + EPOCH)
    whole = lambda name: half_even(n(name))
    of = lambda name: found.where(F.col("message") == name)
    sports = of("sport").groupBy("activity_id").agg(F.max_by(n("sport"), F.when(n("sport").isNotNull(), F.col("pos"))).alias("sp"), F.max_by(n("sub_sport"), F.when(n("sub_sport").isNotNull(), F.col("pos"))).alias("ssp"))
    doubled = lambda a, b: half_even((a + F.coalesce(b, F.lit(0.0))) * 2)
    session = of("session").join(sports, "activity_id", "left").withColumn("sport", _label(F.coalesce("sp", n("sport")), SPORTS))
    sessions = session.select(
        "activity_id", "sport", _label(F.coalesce("ssp", n("sub_sport")), SUB_SPORTS).alias("sub_sport"), time("start_time").alias("start_time"), time("timestamp").alias("end_time"), degrees_of_semicircles(n("start_position_lat")).alias("start_latitude_deg"),
        degrees_of_semicircles(n("start_position_long")).alias("start_longitude_deg"), n("total_distance").alias("total_distance_m"), n("total_timer_time").alias("total_timer_time_s"), n("total_elapsed_time").alias("total_elapsed_time_s"), n("total_ascent").alias("total_ascent_m"),
        n("total_descent").alias("total_descent_m"), whole("avg_heart_rate").alias("avg_heart_rate_bpm"), whole("max_heart_rate").alias("max_heart_rate_bpm"),
        F.when((F.lower("sport") == "running") & (n("sport") == 1), doubled(n("avg_cadence"), n("avg_fractional_cadence"))).otherwise(whole("avg_cadence")).alias("avg_cadence_spm"), F.coalesce(n("enhanced_avg_speed"), n("avg_speed")).alias("avg_speed_mps"),
        n("avg_temperature").alias("avg_temperature_c"), F.lit(None).cast("double").alias("min_temperature_c"), n("max_temperature").alias("max_temperature_c"),
    )
    running = sessions.select("activity_id", (F.lower("sport") == "running").alias("running"))
    rec = of("record").where(n("timestamp").isNotNull()).join(running, "activity_id", "left")
    records = rec.select(
        "activity_id", "pos", time("timestamp").alias("ts"), n("distance").alias("distance_m"), degrees_of_semicircles(n("position_lat")).alias("latitude_deg"), degrees_of_semicircles(n("position_long")).alias("longitude_deg"), whole("heart_rate").alias("heart_rate_bpm"),
        F.when(F.col("running"), doubled(n("cadence"), n("fractional_cadence"))).otherwise(whole("cadence")).alias("cadence_spm"), n("fractional_cadence").alias("fractional_cadence"), F.coalesce(n("enhanced_speed"), n("speed")).alias("speed_mps"),
        F.coalesce(n("enhanced_altitude"), n("altitude")).alias("altitude_m"), n("grade").alias("grade_percent"), n("temperature").alias("temperature_c"),
    )
    w = Window.partitionBy("activity_id").orderBy("pos")
    laps = of("lap").select(
        "activity_id", "pos", F.row_number().over(w).alias("lap_index"), time("start_time").alias("start_time"), time("timestamp").alias("end_time"), n("total_distance").alias("total_distance_m"), n("total_timer_time").alias("total_timer_time_s"), n("total_ascent").alias("total_ascent_m"),
        n("total_descent").alias("total_descent_m"), whole("avg_heart_rate").alias("avg_heart_rate_bpm"), whole("max_heart_rate").alias("max_heart_rate_bpm"), F.when(n("sport") == 1, doubled(n("avg_cadence"), n("avg_fractional_cadence"))).otherwise(whole("avg_cadence")).alias("avg_cadence_spm"),  # the lap's own sport makes it the running field
        n("avg_temperature").alias("avg_temperature_c"), F.lit(None).cast("double").alias("min_temperature_c"), n("max_temperature").alias("max_temperature_c"), _label(n("intensity"), INTENSITIES).alias("intensity"), n("wkt_step_index").cast("int").cast("string").alias("wkt_step_index"),
    )
    events = of("event").where((n("event") == 0) & n("timestamp").isNotNull() & n("event_type").isNotNull()).select("activity_id", "pos", time("timestamp").alias("ts"), _label(n("event_type"), EVENT_TYPES).alias("event_type"))
    kind, target = _label(n("duration_type"), DURATIONS), _label(n("target_type"), TARGETS)
    ranged = lambda name, side: F.when(target == name, n(f"custom_target_{side}") / (1000 if name == "speed" else 1))
    steps = of("workout_step").select(
        "activity_id", "pos", n("message_index").cast("int").cast("string").alias("message_index"), F.col("texts").getItem("wkt_step_name").alias("wkt_step_name"), _label(n("intensity"), INTENSITIES).alias("intensity"), kind.alias("duration_type"),
        F.when(kind == "time", n("duration_value") / 1000).alias("duration_time"), F.when(kind == "distance", n("duration_value") / 100).alias("duration_distance"), target.alias("target_type"), F.when(target == "speed", n("target_value").cast("int")).alias("target_speed_zone"),
        F.when(target == "cadence", n("target_value").cast("int")).alias("target_cadence_zone"), ranged("speed", "low").alias("custom_target_speed_low"), ranged("speed", "high").alias("custom_target_speed_high"), ranged("cadence", "low").alias("custom_target_cadence_low"),
        ranged("cadence", "high").alias("custom_target_cadence_high"), _label(n("secondary_target_type"), TARGETS).alias("secondary_target_type"),
    )
    return Activities(sessions, records, attach_steps(laps, steps), events, steps), found.where("problem is not null").select("activity_id", errors.text(F.col("problem")).alias("error"), "problem")


def read_activities(spark: SparkSession, path: str) -> tuple[Activities, DataFrame]:
    """Tables and failures of the FIT files at path. The decoded messages are used by every table: write them (Activities.write) before heavy use."""
    return tables(messages(spark, path))


def reportable(records: DataFrame) -> DataFrame:
    """Records with a measurement; positions and fractional cadence don't count."""
    return records.where(F.coalesce(*[F.col(c).cast("double") for c in ("distance_m", "heart_rate_bpm", "cadence_spm", "speed_mps", "altitude_m", "grade_percent", "temperature_c")]).isNotNull())
