"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline import schemas, session
from lapline.functions import columns as C
from lapline.functions import frames
from lapline.operators import align, laps, quality, sessions, track, wheels
from lapline.operators.laps import LAP
from lapline.operators.sessions import SESSION
from lapline.plans import binding, etl
from lapline.sinks import files as sinks
from lapline.sources import catalog, files, messages, tracks
from lapline.streaming import lifecycle, pipelines, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals: sums differ in the last bits by their order."""
    scale = F.lit(float(10 ** digits))
    return df.select(*[
        (F.floor(F.col(f.name).cast("double") * scale + F.lit(0.5)) / scale).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


def query(function=None, *, name: str | None = None):
    """Register a function of the samples as a query."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(binding.samples(spark, sf_dir)))
        QUERIES[name or f.__name__] = run
        return f
    return register(function) if function else register


def spark_query(f):
    """Register a function that reads what it needs itself."""
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def written(spark: SparkSession, sf_dir: str, what: str, write: Callable[[str], None]) -> str:
    """A folder of its own with a table derived from the given ones, as they are now."""
    folder = session.new_folder(spark, what)
    write(folder)
    return folder


def live(t: DataFrame) -> DataFrame:
    return t.where(C.is_live())


def iso(t: DataFrame) -> DataFrame:
    """Times as the ISO-8601 text a recorder writes."""
    text = F.concat(F.date_format("timestamp_wall", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return t.withColumn("timestamp_wall", text)


# ---- projections and filters ---------------------------------------------------------

@query
def nested_wheels_flattened(t):
    nested = t.select("packet_id", *[
        F.struct(*[F.col(f"{prefix}_{w}").alias(field) for field, prefix in fixed.WHEEL_METRICS])
        .alias(f"wheel_{w}") for w in fixed.WHEELS
    ])
    return frames.flatten_wheels(nested)


@query
def lap_file_columns(t):
    return frames.narrow_to_lap_file(t.drop("packet_id")).drop("timestamp_wall")


@query
def derived_columns(t):
    keep = ["packet_id", "timestamp_parsed", "avg_tyre_temp", "avg_tyre_pressure",
            "is_heavy_braking", "is_full_throttle"]
    return frames.with_derived(t).select(*keep)


@query
def on_track_samples(t):
    return frames.on_track(t).select("packet_id", *LAP, "speed_kmh")


@query
def usable_samples(t):
    return frames.usable(t).select("packet_id", "status", "car", "track")


@query
def decoded_codes(t):
    k = F.col("rpm") / 40 - 100
    coded = t.select("packet_id", *[
        (k.cast("int") % m - 1).alias(c) for c, m in
        (("status", 6), ("session_type", 11), ("track_grip", 9), ("rain_intensity", 8))
    ])
    return frames.decode_codes(coded)


@query
def brake_bias_percent(t):
    car = (F.col("packet_id") % 14).cast("string")
    return t.select("packet_id", C.brake_bias_percent(F.col("brake"), car).alias("bias"))


@query
def session_names(t):
    return t.select(
        "packet_id",
        C.session_name(F.lit("ACC"), F.col("timestamp_wall"), F.col("track"), F.lit("GT3")).alias("name"),
        C.path_safe(F.col("car")).alias("car_folder"),
        C.lap_file_name(F.col("completed_laps")).alias("lap_file"),
    )


@query
def lap_time_labels(t):
    ms = F.col("last_lap_time_ms") - 90000
    return t.select("packet_id", C.lap_time_label(ms).alias("label"), C.delta_label(ms).alias("delta"),
                    C.delta_band(ms).alias("band"), C.gear_label(F.col("gear")).alias("gear"))


@query
def normalized_speed(t):
    return laps.normalized_speed(live(t)).select("packet_id", "speed_normalized")


@query
def lap_points(t):
    return live(t).select(*LAP, "timestamp_wall", "packet_id", "distance_into_lap", "speed_kmh",
                          "throttle", "brake")


@query
def summary_display(t):
    shown = frames.summary_display(laps.multi_lap_summary(t))
    plain = {"Max Spd": "max_spd", "Avg Spd": "avg_spd", "Avg Tyre °C": "avg_tyre",
             "Fuel (L)": "fuel", "Lap": "lap", "Time": "time", "Samples": "samples"}
    return shown.withColumnsRenamed(plain)


@query
def recording_text(t):
    recorded = t.select("packet_id", *[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SAMPLE.fields])
    return frames.csv_text(recorded).drop("timestamp_wall")


# ---- aggregations --------------------------------------------------------------------

@query
def lap_summary(t):
    return etl.flagship(t)


query(laps.multi_lap_summary)
query(laps.available_laps)
query(laps.status_counts)
query(laps.gear_histogram)
query(laps.track_speed)
query(laps.filter_counts)


@query(name="session_list")
def _(t):
    return laps.sessions(t)


@query
def newest_sessions(t):
    return laps.newest_sessions(t, 10)


@query
def lap_headline(t):
    return laps.lap_headline(live(t))


@query
def lap_pair_deltas(t):
    return laps.lap_pair_deltas(live(t), 0, 1)


@query
def tyre_balance(t):
    return wheels.tyre_balance(live(t))


@query
def wheel_means(t):
    return wheels.wheel_means(live(t))


@query
def stacked_wheels(t):
    return wheels.stack_wheels(t, "tyre_temp", ("packet_id",))


@query
def tyre_window_share(t):
    return wheels.tyre_window_share(live(t))


@query
def braking_stats(t):
    return laps.braking_stats(live(t))


@query
def g_stats(t):
    return laps.g_stats(live(t))


@query
def fuel_forecast(t):
    return laps.fuel_forecast(live(t))


@query
def electronics_means(t):
    return laps.electronics_means(live(t))


@query
def lap_summary_listing(t):
    return laps.lap_summary_listing(etl.flagship(t)).select(*LAP, "sample_count")


@query
def laps_but_first(t):
    return laps.other_laps(laps.available_laps(t), 0)


# ---- sequences -----------------------------------------------------------------------

@query
def fuel_burn(t):
    return laps.fuel_burn(laps.multi_lap_summary(t))


@query
def lap_progression(t):
    return laps.lap_progression(laps.multi_lap_summary(t))


@query
def sessionized(t):
    return sessions.sessionize(t).select("packet_id", *SESSION)


#: Rows of a slice in the queries that show that cuts change nothing: every stream is cut.
SMALL_SLICE = 50


@query
def sessionized_in_slices(t):
    return sessions.sessionize(t, SMALL_SLICE).select("packet_id", *SESSION)


@query
def session_events_in_slices(t):
    return sessions.session_events(t, SMALL_SLICE)


@query
def lap_segments_in_slices(t):
    return sessions.lap_segments(t, SMALL_SLICE)


query(sessions.session_events)
query(sessions.lap_completions)
query(sessions.setup_changes)
query(sessions.setup_snapshots)
query(sessions.lap_segments)


@query
def distinct_setup_snapshots(t):
    return sessions.setup_snapshots(t, distinct=True)


@query
def without_repeated_packets(t):
    same = t.withColumn("packet_id", F.col("gear"))
    return sessions.drop_repeated_packets(same).select("session_id", "timestamp_wall", "packet_id")


@query
def setup_on_laps(t):
    return sessions.setup_on_laps(sessions.laps_driven(t), sessions.setup_snapshots(t, distinct=True))


def by_track(t):
    """All samples of a track as one stream: few, large keys."""
    return t.withColumn("session_id", F.col("track"))


@query
def sampled_rows(t):
    return quality.slice_sample(by_track(t)).select("packet_id", "session_id")


@query
def first_hundred_rows(t):
    return quality.first_rows(by_track(t), 100).select("packet_id", "session_id")


# ---- joins ---------------------------------------------------------------------------

def session_table(t):
    """Session rows keyed by stream and session number, from their start events."""
    starts = sessions.session_events(t).where("event_type = 'session_start'")
    return starts.select(
        session_key().alias("session_id"), "platform", "track", "car", "session_type",
        F.col("timestamp").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(0).alias("total_laps"), F.lit(None).cast("int").alias("best_lap_ms"),
    )


def session_key():
    return F.concat_ws("_", "session_id", F.col("session_no").cast("string"))


@query
def session_ends_merged(t):
    ends = sessions.session_events(t).where("event_type = 'session_end'").select(
        session_key().alias("session_id"), "total_laps", "best_lap_ms", "timestamp")
    return sessions.merge_session_end(session_table(t), ends)


def segment_table(t):
    return sessions.lap_segments(t).select(
        session_key().alias("session_id"), "lap_number", "samples", "max_speed")


@query
def laps_with_sessions(t):
    return sessions.with_sessions(
        segment_table(t), session_table(t).select("session_id", "car", "track", "start_time"))


@query
def orphan_laps(t):
    races = session_table(t).where("session_type = 'race'")
    return sessions.orphans(segment_table(t), races)


def corners(t):
    return tracks.known_corners(t.sparkSession)


def sectors(t):
    return tracks.known_sectors(t.sparkSession)


@query
def session_tracks(t):
    return track.resolve_tracks(t.select("session_id", "track").distinct(), corners(t))


@query
def samples_in_corners(t):
    return track.samples_in_corners(live(t), corners(t)).select("packet_id", "corner")


@query
def corner_stats(t):
    return track.corner_stats(live(t), corners(t))


@query
def sector_times(t):
    return track.sector_times(live(t), sectors(t))


@query
def sector_crossings(t):
    return track.sector_crossings(live(t), sectors(t))


@query
def sector_crossings_in_slices(t):
    return track.sector_crossings(live(t), sectors(t), rows_per_slice=SMALL_SLICE)


@query
def measured_sector_sums(t):
    return quality.sector_sums(track.sector_crossings(live(t), sectors(t)))


@query
def lap_records(t):
    rows = track.lap_records(live(sessions.sessionize(t)), sessions.lap_completions(t), sectors(t))
    return rows.select(*SESSION, "lap_number", "timestamp", "lap_time_ms", "sector_1_ms",
                       "sector_2_ms", "sector_3_ms", "fuel_used", "avg_tyre_temp_fl")


@query
def braking_zones(t):
    return track.braking_zones(live(t), corners(t))


# ---- alignment -----------------------------------------------------------------------

@query
def resampled_laps(t):
    return align.resample(live(t), ["speed_kmh", "throttle"])


@query
def resampled_laps_in_slices(t):
    return align.resample(live(t), ["speed_kmh", "throttle"], rows_per_slice=SMALL_SLICE)


@query
def compared_laps(t):
    return align.compare_laps(t, 0, 1)


@query
def compared_laps_positional(t):
    return align.compare_laps(t, 0, 1, align="positional")


@query
def time_loss(t):
    return align.time_loss(t)


@query
def corner_time_loss(t):
    on = t.select("session_id", "track").distinct()
    return track.corner_time_loss(align.time_loss(t, of_session=on), corners(t))


# ---- quality -------------------------------------------------------------------------

query(quality.column_checks)
query(quality.range_checks)


@query
def track_range_checks(t):
    return quality.range_checks(by_track(t))


@query
def strict_range_checks(t):
    return quality.strict_range_checks(by_track(t))


@query
def required_checks(t):
    return quality.required_checks(by_track(t))


@query
def brake_bias_checks(t):
    return quality.brake_bias_checks(by_track(t))


def keyed(df):
    return df.withColumn("session_id", session_key()).drop("session_no")


@query
def event_checks(t):
    return quality.event_checks(sessions.session_events(t))


def checked_laps(t):
    return sessions.lap_completions(t).withColumns({
        "sector_1_ms": F.col("last_sector_time_ms"), "sector_2_ms": F.col("last_sector_time_ms"),
        "sector_3_ms": F.col("lap_time_ms") - 2 * F.col("last_sector_time_ms") - F.col("lap_number") * 60,
    })


@query
def lap_checks(t):
    return quality.lap_checks(checked_laps(t))


@query
def lap_report(t):
    return quality.lap_report(sessions.lap_completions(t))


@query
def setup_report(t):
    return quality.setup_report(sessions.setup_snapshots(t, distinct=True))


@query
def session_facts(t):
    return quality.session_facts(sessions.session_events(t))


@query
def validation_summary(t):
    t = by_track(t)
    return quality.validation_summary(t, sessions.session_events(t), sessions.lap_completions(t))


# ---- sources and sinks ---------------------------------------------------------------

#: Rows of a lake file: a compressed file is read by one task.
LAKE_FILE_ROWS = 25_000


def write_lake(samples, folder):
    """JSON lines, compressed: samples as text are some twenty times their Parquet file."""
    samples.write.mode("append").option("compression", "gzip").option(
        "maxRecordsPerFile", LAKE_FILE_ROWS).json(folder)


def lake(spark, sf_dir):
    """Samples as JSON lines two folders down, next to event files."""
    def write(folder):
        t = iso(binding.samples(spark, sf_dir)).select(*schemas.LAKE_SAMPLE.names)
        write_lake(t, f"{folder}/2024/01")
        sinks.write_events(t.select("session_id", "status"), f"{folder}/events/all")
    return written(spark, sf_dir, "lake", write)


def etl_output(spark, sf_dir):
    return written(spark, sf_dir, "processed", lambda out: etl.run(spark, lake(spark, sf_dir), out))


def recordings(spark, sf_dir):
    return written(spark, sf_dir, "recordings", lambda out: sinks.write_recordings(
        binding.samples(spark, sf_dir).select(*schemas.LAKE_SAMPLE.names), out))


@spark_query
def lake_scan(spark, sf_dir):
    rows = files.read_lake_samples(spark, lake(spark, sf_dir))
    return rows.select(*LAP, "timestamp_wall", "status", "gear", "is_in_pit",
                       F.round(F.col("speed_kmh").cast("double"), 2).alias("speed_kmh"))


@spark_query
def lake_filter_counts(spark, sf_dir):
    return laps.filter_counts(files.read_lake_samples(spark, lake(spark, sf_dir)))


def _micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@spark_query
def processed_table(spark, sf_dir):
    rows = etl.read_processed(spark, etl_output(spark, sf_dir))
    return _micros(rows.select(*LAP, "timestamp_parsed", "is_heavy_braking", "is_full_throttle",
                               F.round("avg_tyre_temp", 3).alias("avg_tyre_temp")), "timestamp_parsed")


@spark_query
def lap_summary_table(spark, sf_dir):
    rows = spark.read.parquet(f"{etl_output(spark, sf_dir)}/lap_summary")
    return rounded(_micros(rows, "lap_start_time", "lap_end_time"), 3)


@spark_query
def lap_summary_increments(spark, sf_dir):
    """The lap summary by increments: files of three thirds come one after the other, the last one twice."""
    t = iso(binding.samples(spark, sf_dir)).select(*schemas.LAKE_SAMPLE.names)
    out, raw = session.new_folder(spark, "increments"), session.new_folder(spark, "lake")
    part = F.pmod(F.xxhash64("session_id", "timestamp_wall", "rpm"), F.lit(3))
    for third in (0, 1, 2, None):
        if third is not None:
            write_lake(t.where(part == third), f"{raw}/2024")
        rows = etl.increment(spark, raw, out)
    return rounded(_micros(rows, "lap_start_time", "lap_end_time"), 3)


@spark_query
def lap_lookup(spark, sf_dir):
    """One lap of the processed table: both conditions are on the columns it is partitioned or ordered by."""
    table = etl.read_processed(spark, etl_output(spark, sf_dir))
    name = table.agg(F.min("session_id")).first()[0]
    rows = laps.lap_data(table, name, 1)
    return rows.select(*LAP, F.unix_micros("timestamp_parsed").alias("at"), "gear",
                       F.round(F.col("speed_kmh").cast("double"), 2).alias("speed_kmh"))


@spark_query
def clustered_table(spark, sf_dir):
    folder = written(spark, sf_dir, "clustered", lambda out: sinks.write_clustered(
        etl.processed(binding.samples(spark, sf_dir)), out))
    return spark.read.parquet(folder).groupBy(*LAP).agg(
        F.count(F.lit(1)).alias("samples"), F.max("speed_kmh").alias("max_speed"))


@spark_query
def external_tables(spark, sf_dir):
    out = etl_output(spark, sf_dir)
    database = "lapline_" + out.rpartition("-")[2]
    catalog.create_tables(spark, database, lake(spark, sf_dir), f"{out}/telemetry", f"{out}/lap_summary")
    catalog.repair_table(spark, f"{database}.telemetry_processed")
    return catalog.query(
        spark,
        f"""SELECT r.track, r.samples, p.samples AS processed, s.laps,
                   (SELECT count(*) FROM {database}.telemetry_raw) AS raw_rows
            FROM (SELECT track, count(*) AS samples FROM {database}.telemetry_raw
                  WHERE status = :status GROUP BY track) r
            JOIN (SELECT track, count(*) AS samples FROM {database}.telemetry_processed
                  GROUP BY track) p ON r.track = p.track
            JOIN (SELECT track, count(*) AS laps FROM {database}.lap_summary
                  GROUP BY track) s ON r.track = s.track""",
        status="live",
    )


@spark_query
def recording_scan(spark, sf_dir):
    return files.read_recordings(
        spark, recordings(spark, sf_dir), "session_id", "status", "completed_laps", "speed_kmh",
    ).groupBy(*LAP, "status").agg(F.count(F.lit(1)).alias("samples"),
                            F.round(F.max(F.col("speed_kmh").cast("double")), 2).alias("max_speed"))


@spark_query
def recording_head(spark, sf_dir):
    """The first rows of a CSV scan, in a stated order."""
    rows = files.read_recordings(spark, recordings(spark, sf_dir), "session_id", "timestamp_wall", "status",
                                 "completed_laps", "gear", "rpm")
    return laps.head(rows, 50, *map(F.col, ("timestamp_wall", "session_id", "rpm", "gear", "status",
                                            "completed_laps"))).select(
        "session_id", "status", "completed_laps", "gear")


@spark_query
def latest_recording(spark, sf_dir):
    """The folder written last: recordings of all sessions, then one more."""
    def write(folder):
        t = binding.samples(spark, sf_dir).select(*schemas.LAKE_SAMPLE.names)
        sinks.write_recordings(t, folder)
        last = t.agg(F.max("session_id").alias("session_id"))
        sinks.write_recordings(t.join(last, "session_id").select(*schemas.LAKE_SAMPLE.names), f"{folder}/again")
    return files.latest_session(spark, written(spark, sf_dir, "recorded", write)).select(
        F.regexp_replace("session_id", "^[^=]*=", "").alias("session_id"))


def track_files(spark, sf_dir):
    """The tracks that the samples name, one JSON file each, as a user keeps them."""
    def write(folder):
        named = binding.samples(spark, sf_dir).select("track").distinct()
        known = track.resolve_tracks(named, tracks.known_corners(spark)).select("track_id").distinct()
        corners_ = tracks.known_corners(spark).join(known, "track_id")
        corner = F.struct("entry_m", "apex_m", "exit_m", F.col("brake_m").alias("braking_zone_start_m"),
                          F.array("ref_low", "ref_high").alias("typical_speed_range_kmh"))
        bounds = tracks.known_sectors(spark).groupBy("track_id").agg(
            F.array_sort(F.collect_set("start_m")).alias("starts"), F.max("end_m").alias("end"))
        rows = corners_.groupBy("track_id", "track_name").agg(
            F.map_from_entries(F.collect_list(F.struct("corner", corner.alias("c")))).alias("corners")
        ).join(bounds, "track_id").select(
            "track_id", "track_name", F.concat("starts", F.array("end")).alias("sector_boundaries_m"), "corners")
        rows.select(F.to_json(F.struct("*")).alias("value"), F.col("track_id").alias("name")).repartition(
            "name").write.partitionBy("name").text(folder)
    return written(spark, sf_dir, "tracks", write)


@spark_query
def corner_stats_from_files(spark, sf_dir):
    """Corner statistics with the track dimension read from track files."""
    return track.corner_stats(live(binding.samples(spark, sf_dir)),
                              tracks.read_corners(spark, track_files(spark, sf_dir)))


@spark_query
def sector_times_from_files(spark, sf_dir):
    return track.sector_times(live(binding.samples(spark, sf_dir)),
                              tracks.read_sectors(spark, track_files(spark, sf_dir)))


@spark_query
def text_json_batches(spark, sf_dir):
    folder = written(spark, sf_dir, "text-json", lambda out: sinks.rebatch_as_json(
        spark, recordings(spark, sf_dir), out))
    return files.read_text_samples(spark, folder).select(
        "session_id", "status", "completed_laps", "gear", "is_in_pit", "current_lap_time_ms")


def lap_folder(spark, sf_dir):
    return written(spark, sf_dir, "laps", lambda out: sinks.write_laps(
        iso(binding.samples(spark, sf_dir)).drop("packet_id"), out))


@spark_query
def lap_file_stats(spark, sf_dir):
    stats = files.file_stats(spark, lap_folder(spark, sf_dir))
    part = lambda name: F.regexp_extract("file", f"{name}=([^/]+)", 1).alias(name)
    return stats.select(part("track_folder"), part("session_folder"), part("lap_folder"),
                        "rows", "duration_s",
                        F.round(F.col("speed_max").cast("double"), 2).alias("speed_max"))


@spark_query
def lap_file_schema_widths(spark, sf_dir):
    return files.schema_widths(spark, lap_folder(spark, sf_dir))


@spark_query
def event_files(spark, sf_dir):
    def write(out):
        events = sessions.session_events(binding.samples(spark, sf_dir))
        sinks.write_events(
            events.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
            f"{out}/session_events")
    return files.read_events(spark, written(spark, sf_dir, "events", write), "session_events")


@spark_query
def message_round_trip(spark, sf_dir):
    t = iso(binding.samples(spark, sf_dir))
    back = messages.decode(messages.encode(t, fixed.TELEMETRY_TOPIC))
    return back.select("session_key", "timestamp_wall", "status", "completed_laps", "gear", "is_in_pit",
                       F.round(F.col("speed_kmh").cast("double"), 2).alias("speed_kmh"))


# ---- streams -------------------------------------------------------------------------

@spark_query
def stream_append(spark, sf_dir):
    def write(out):
        sent = messages.encode(iso(binding.sample_stream(spark, sf_dir)), fixed.TELEMETRY_TOPIC)
        for stream in pipelines.start_telemetry(sent, out, session.new_folder(spark, "state")):
            stream.awaitTermination()

    table = pipelines.samples_table(spark, written(spark, sf_dir, "appended", write))
    table.compact(whole=True)
    rows = table.read()
    return rows.groupBy("session_key", "completed_laps", "status").agg(
        F.count("processed_at").alias("samples"), F.round(F.max("speed_kmh").cast("double"), 2).alias("max_speed"))


def online(spark, sf_dir):
    """All events of the given samples, as the online operator gives them."""
    t = lifecycle.needed(binding.samples(spark, sf_dir))
    folder = written(spark, sf_dir, "lifecycle", lambda out: pipelines.backfill(
        t, lifecycle.lifecycle_events, out, session.new_folder(spark, "backfill")))
    return spark.read.schema(lifecycle.EVENTS).parquet(folder)


def _stream_query(kind, drop=()):
    def run(spark, sf_dir):
        return lifecycle.events_of(online(spark, sf_dir), kind).drop(*drop)
    run.__name__ = f"stream_{kind}s"
    spark_query(run)


for _kind in ("session_start", "session_end", "lap_completion", "setup_change", "setup_snapshot"):
    _stream_query(_kind)
# the online number counts cuts, the batch one cuts and openings: the same order, so only named there
_stream_query("lap_segment")


@spark_query
def stream_without_repeats(spark, sf_dir):
    def build(stream, watermark, idle_ms):
        return pipelines.without_repeats(stream, watermark).select(
            "session_id", "packet_id", "status", "timestamp_wall")

    t = binding.samples(spark, sf_dir).select("session_id", "packet_id", "status", "timestamp_wall")
    folder = written(spark, sf_dir, "no-repeats", lambda out: pipelines.backfill(
        t.unionByName(t), build, out, session.new_folder(spark, "backfill")))
    # the row that ends the backfill is later than all samples
    last = t.agg(F.max("timestamp_wall").alias("last"))
    return spark.read.parquet(folder).crossJoin(F.broadcast(last)).where(
        "timestamp_wall is null or timestamp_wall <= last").drop("timestamp_wall", "last")


def event_messages(t):
    """Messages of all three event topics, and unreadable ones."""
    def text(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)

    def encode(df, topic):
        columns = [text(c) if c == "timestamp" else c for c in df.columns]
        return messages.encode(df.select(*columns, F.col("timestamp").alias("_at")), topic, time="_at")

    events = keyed(sessions.session_events(t))
    inside = keyed(sessions.sessionize(t))
    completed = inside.groupBy("session_id", (F.col("completed_laps") + 1).alias("lap_number")).agg(
        F.max("current_lap_time_ms").alias("lap_time_ms"), F.min("fuel_remaining").alias("fuel_remaining"),
        F.max("timestamp_wall").alias("timestamp"))
    setups = sessions.setup_snapshots(inside)
    broken = t.where("status = 'replay'").select(
        F.col("session_id").cast("binary").alias("key"), F.encode(F.lit("{broken"), "UTF-8").alias("value"),
        F.lit("lap_completions").alias("topic"), F.col("timestamp_wall").cast("timestamp").alias("timestamp"))
    return (encode(events, "session_events").unionByName(encode(completed, "lap_completions"))
            .unionByName(encode(setups, "setup_snapshots")).unionByName(broken))


def event_store(spark, sf_dir):
    sent = written(spark, sf_dir, "messages", lambda out: event_messages(
        binding.samples(spark, sf_dir)).write.parquet(out))
    return written(spark, sf_dir, "store", lambda out: pipelines.start_event_store(
        messages.message_files(spark, sent), out, session.new_folder(spark, "state")).awaitTermination())


@spark_query
def stored_sessions(spark, sf_dir):
    return pipelines.stored_sessions(spark, event_store(spark, sf_dir))


@spark_query
def stored_laps(spark, sf_dir):
    return pipelines.stored_laps(spark, event_store(spark, sf_dir)).select(
        "session_id", "lap_number", "lap_time_ms", "fuel_remaining", "sector_1_ms", "timestamp")


@spark_query
def stored_after_delete(spark, sf_dir):
    """What is left of sessions, laps and setups when every fifth stream is deleted, from a snapshot."""
    store = event_store(spark, sf_dir)
    gone = pipelines.stored_sessions(spark, store).where(
        "CAST(split(substring(session_id, 2), '_')[0] AS BIGINT) % 5 = 0")
    for _ in range(2):  # the second time changes nothing
        snapshots.delete_sessions(spark, store, gone, "every fifth")
    snapshots.compact(spark, store)
    left = {"sessions": pipelines.stored_sessions, "laps": pipelines.stored_laps, "setups": pipelines.stored_setups}
    counts = [table(spark, store).groupBy("session_id").agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("stored"), "session_id", "rows") for name, table in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@spark_query
def stored_setups(spark, sf_dir):
    return pipelines.stored_setups(spark, event_store(spark, sf_dir)).select(
        "session_id", "lap_number", "car", *fixed.SETUP_PARAMETERS, "timestamp")


@spark_query
def quarantined_messages(spark, sf_dir):
    return pipelines.quarantined(spark, event_store(spark, sf_dir)).groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"))
