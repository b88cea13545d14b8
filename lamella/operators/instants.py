"""Mixed timestamp forms and zones, normalised to microseconds since 1970-01-01 UTC.

Method. A text runs down an ordered cascade of anchored patterns; the first that matches rewrites it as year|month|day|hour|minute|second|fraction|half|zone,
and the parts are then checked strictly (no rolling over of day 31). A zone in the text wins; else the writer's zone, looked up, applies. Wall-clock times
that occur twice or never follow a stated policy. Everything is a Catalyst expression: no Python runs for a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.registry import registered_files

#: Seconds from 1970-01-01 to 2015-01-01, from which the files count: a fixed value of the format.
EPOCH_2015 = 1_420_070_400
#: Names of the months, of which the first three letters count: fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
ZONE = r"\s*(z|utc|gmt|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|\[[^\]\[]+\]|[a-z]+(?:/[a-z0-9_+-]+)+)?"
HALF = r"(?:\s*(am|pm|a\.m\.|p\.m\.)(?![a-z]))?"

#: The cascade, in order: pattern on the trimmed text in lower case, and the parts in the order y|m|d|h|min|s|fraction|half|zone. `@` stands for the
#: slash forms' two leading numbers, which the file's date order tells apart; a day of the year stands in the month's place as `#n`.
CASCADE = (
    (rf"^(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}})[t ]\s*{CLOCK}{HALF}{ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[t ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})-(\d{{3}})[t ]{CLOCK}{ZONE}$", "$1|#$2||$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[t ]\s*{CLOCK}{HALF}{ZONE}$", "$3|@$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[a-z]{{3,9}},\s*)?{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{CLOCK}{HALF}{ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[a-z]{{3}},\s*)?(\d{{1,2}})[- ]{MONTH}[- ](\d{{4}}),?\s+{CLOCK}{HALF}{ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
)
#: Plain numbers: digits before the point decide the unit. Tried after the cascade, so that fourteen digits are a date.
NUMBER = r"^([+-]?)(\d{1,20})(?:[.](\d+))?$"


def zone_table(spark: SparkSession) -> DataFrame:
    """zone_key (upper case) and zone_id of every zone that the JVM knows: some 600 rows, a bound set by the time zone database."""
    ids = sorted(str(x) for x in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return spark.createDataFrame([(x.upper(), x) for x in ids], "zone_key string, zone_id string")


def zone_key(text: Column) -> Column:
    """A zone as people write it, tidied: outer blanks and brackets go, blanks inside become underscores, letters are upper case."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(text, r"[\[\]\s]+", " ")), " ", "_"))


def fixed_offset(key: Column) -> Column:
    """Microseconds east of UTC for a key like Z, UTC, GMT-05:00, UTC+02, +0530; null for names and for offsets beyond 18 hours."""
    parts = r"^(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    hours, minutes = F.regexp_extract(key, parts, 2), F.regexp_extract(key, parts, 3)
    size = F.coalesce(hours.try_cast("bigint"), F.lit(0)) * 60 + F.coalesce(minutes.try_cast("bigint"), F.lit(0))
    sign = F.when(F.regexp_extract(key, parts, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when(key.isin("Z", "UTC", "GMT", "UT"), F.lit(0).cast("bigint")).when(key.rlike(parts) & (size <= 18 * 60), sign * size * 60_000_000)


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic; the parts must be valid."""
    a = F.floor((F.lit(14) - m) / 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) - 32045 - 2440588


def days_in(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def to_utc(local_us: Column, zone_id: Column, ambiguous: str = "first", nonexistent: str = "before") -> Column:
    """UTC microseconds of a wall-clock time (microseconds as if UTC) in a named zone.

    ambiguous: `first` or `last` of the two moments, or `null`. nonexistent: `before` reads a skipped time with the offset in force just before
    the jump, `null` refuses it. Null in, null out.
    """
    if ambiguous not in ("first", "last", "null") or nonexistent not in ("before", "null"):
        raise ValueError("ambiguous: first, last or null; nonexistent: before or null")
    us = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone_id))
    out = us
    if nonexistent == "null":
        out = F.when(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone_id)) == local_us, us)
    if ambiguous != "first":
        day = 86_400_000_000
        later = local_us - (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us + day), zone_id)) - us - day)
        twice = (later != us) & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(later), zone_id)) == local_us)
        out = F.when(twice, later if ambiguous == "last" else F.lit(None).cast("bigint")).otherwise(out)
    return out


def parsed(df: DataFrame, text: str, date_order: str) -> DataFrame:
    """df with `wall_us` (microseconds of the wall clock, or of the epoch), `is_epoch` and `text_zone` (key, empty where the text has none).

    wall_us is null for what is not a date, for impossible dates, and for slash forms whose file has no date order.
    """
    t = F.lower(F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", "")))
    canon = None
    for pattern, parts in CASCADE:
        canon = (F.when if canon is None else canon.when)(F.col("_t").rlike(pattern), F.regexp_replace(F.col("_t"), pattern, parts))
    d = df.withColumn("_t", t).withColumn("_p", F.split(canon, r"\|"))
    p = lambda i: F.get(F.col("_p"), F.lit(i))
    num = lambda x: x.try_cast("bigint")
    first = F.substring(p(1), 2, 9)
    slashed, ordinal = p(1).startswith("@"), p(1).startswith("#")
    month_name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(p(1), 1, 3)).cast("bigint")
    month = (
        F.when(ordinal, F.lit(1).cast("bigint"))
        .when(slashed, F.when(F.col(date_order) == "mdy", num(first)).when(F.col(date_order) == "dmy", num(p(2))))
        .otherwise(F.coalesce(num(p(1)), month_name))
    )
    day = F.when(ordinal, num(first)).when(slashed, F.when(F.col(date_order) == "mdy", num(p(2))).when(F.col(date_order) == "dmy", num(first))).otherwise(num(p(2)))
    d = d.withColumns({"_y": num(p(0)), "_m": month, "_d": day, "_h": num(p(3)), "_i": num(p(4)), "_s": F.coalesce(num(p(5)), F.lit(0)), "_half": F.substring(p(7), 1, 1), "_ord": ordinal})
    y, m, dd, h = F.col("_y"), F.col("_m"), F.col("_d"), F.col("_h")
    year_days = 365 + (days_in(y, F.lit(2)) - 28)
    good_day = F.when(F.col("_ord"), (dd >= 1) & (dd <= year_days)).otherwise(m.between(1, 12) & (dd >= 1) & (dd <= days_in(y, m)))
    good_clock = F.when(F.col("_half") != "", h.between(1, 12)).otherwise(h.between(0, 23)) & F.col("_i").between(0, 59) & F.col("_s").between(0, 59)
    hour = F.when(F.col("_half") == "a", h % 12).when(F.col("_half") == "p", h % 12 + 12).otherwise(h)
    fraction = F.coalesce(num(F.rpad(F.substring(F.coalesce(p(6), F.lit("")), 1, 6), 6, "0")), F.lit(0))
    clock = (hour * 3600 + F.col("_i") * 60 + F.col("_s")) * 1_000_000 + fraction
    civil = F.when((y >= 1) & good_day & good_clock, day_number(y, m, dd) * 86_400_000_000 + clock)
    digits, tail = F.regexp_extract("_t", NUMBER, 2), F.regexp_extract("_t", NUMBER, 3)
    shift = F.when(F.length(digits) <= 11, 6).when(F.length(digits) <= 14, 3).when(F.length(digits) <= 17, 0).otherwise(-3)
    # the decimal point moves inside the text, so no binary fraction is involved; what lies behind it is cut off, and a negative rest is cut towards the past
    whole = F.when(shift >= 0, F.concat(digits, F.rpad(F.substring(tail, F.lit(1), shift), shift, "0"))).otherwise(F.substring(digits, F.lit(1), F.greatest(F.lit(1), F.length(digits) - 3)))
    rest = F.when(shift >= 0, F.substring(tail, shift + 1, F.lit(99))).otherwise(F.concat(F.right(digits, F.lit(3)), tail))
    cut = num(whole)
    epoch = F.when(F.regexp_extract("_t", NUMBER, 1) == "-", -cut - F.when(rest.rlike("[1-9]"), 1).otherwise(0)).otherwise(cut)
    is_epoch = F.col("_p").isNull() & F.col("_t").rlike(NUMBER)
    out = d.withColumn("is_epoch", F.coalesce(is_epoch, F.lit(False))).withColumn("wall_us", F.when(F.col("is_epoch"), epoch).otherwise(civil))
    out = out.withColumn("text_zone", F.coalesce(zone_key(p(8)), F.lit("")))
    return out.drop("_t", "_p", "_y", "_m", "_d", "_h", "_i", "_s", "_half", "_ord")


def instants(row_records: DataFrame, stripes: DataFrame, orc_files: DataFrame, ambiguous: str = "first", nonexistent: str = "before") -> DataFrame:
    """record_id, utc_us: one row per record whose moment can be read; of deliveries that differ the latest counts.

    c_ts (seconds and nanos since 2015-01-01 on the writer's wall clock) goes before c_ts_text. A null or blank writer zone means UTC; a zone that nobody
    knows makes wall-clock times unreadable. Rows of a stripe or file that is not registered count as UTC without a date order. Empty tables give no rows.
    """
    spark = row_records.sparkSession
    zones = F.broadcast(zone_table(spark))  # bounded by the time zone database
    named = stripes.where("file_id is not null and stripe_no is not null").groupBy("file_id", "stripe_no").agg(F.max("writer_timezone").alias("writer_timezone"))
    keyed = named.withColumn("zone_key", zone_key(F.coalesce("writer_timezone", F.lit(""))))
    keyed = keyed.withColumn("zone_key", F.when(F.col("zone_key") == "", "UTC").otherwise(F.col("zone_key"))).join(zones, "zone_key", "left")
    stated = F.struct(fixed_offset(F.col("zone_key")).alias("offset"), "zone_id")
    by_file = keyed.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("stripe_no", stated.alias("z")))).alias("_zones"))
    lookup = registered_files(orc_files).select("file_id", "date_order").join(by_file, "file_id", "full")

    rows = row_records.where("record_id is not null").select("record_id", "file_id", "stripe_no", "ingested_at", F.col("c_ts.seconds").alias("_sec"), F.col("c_ts.nanos").alias("_nanos"), "c_ts_text")
    rows = rows.where("_sec is not null or c_ts_text is not null").join(lookup, "file_id", "left")
    utc = F.struct(F.lit(0).cast("bigint").alias("offset"), F.lit("UTC").alias("zone_id"))
    rows = rows.withColumn("_z", F.coalesce(F.try_element_at("_zones", F.col("stripe_no")), utc)).drop("_zones")
    rows = parsed(rows, "c_ts_text", "date_order")
    own = zones.select(F.col("zone_key").alias("text_zone"), F.col("zone_id").alias("_own_id"))
    rows = rows.join(own, "text_zone", "left")

    from_ts = F.col("_sec").isNotNull()
    wall = F.when(from_ts, (F.col("_sec") + EPOCH_2015) * 1_000_000 + F.floor(F.coalesce("_nanos", F.lit(0)) / 1000)).otherwise(F.col("wall_us"))
    has_own = ~from_ts & (F.col("text_zone") != "")
    offset = F.when(has_own, fixed_offset(F.col("text_zone"))).otherwise(F.col("_z.offset"))
    zone = F.when(has_own, F.col("_own_id")).otherwise(F.col("_z.zone_id"))
    rows = rows.withColumns({"_wall": wall, "_offset": offset, "_zone": zone})
    us = F.when(~from_ts & F.col("is_epoch"), F.col("_wall")).when(F.col("_offset").isNotNull(), F.col("_wall") - F.col("_offset")).when(F.col("_zone").isNotNull(), to_utc(F.col("_wall"), F.col("_zone"), ambiguous, nonexistent))
    found = rows.select("record_id", us.alias("utc_us"), F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("_at"))
    once = found.groupBy("record_id").agg(F.max_by("utc_us", "_at").alias("utc_us"))
    return once.where("utc_us is not null")
