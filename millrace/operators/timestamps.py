"""Mixed timestamp notations to one instant in UTC.

Every notation is a branch of one regular expression with named groups. A single native
``regexp_replace`` rewrites a matching text into its components, so that each text is scanned once,
inside the JVM; calendar ranges are validated and the instant is assembled with integer day
arithmetic. Only the step from local to UTC time uses the zone database, through
``to_utc_timestamp``: it takes the earlier of two instants, and for a skipped local time the offset
in force before the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEP = "\x01"
_MARK = "\x02"

# English month and day names and their order.
_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
    "Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
_DAYS = (
    "Mon(?:day)?|Tue(?:s(?:day)?)?|Wed(?:nesday)?|Thu(?:r(?:s(?:day)?)?)?|Fri(?:day)?|"
    "Sat(?:urday)?|Sun(?:day)?"
)

_BLANK = r"[\s\x{A0}\x{3000}]"


def _clock(n: str) -> str:
    """Hours, minutes, seconds, fraction and half of the day; group names end in ``n``."""
    return (
        rf"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"
        rf"(?:{_BLANK}*(?<ap{n}>[AP])\.?M\.?(?![A-Z]))?"
    )


def _zone(n: str) -> str:
    """``Z``, an offset, an abbreviation or a zone name, and what may stand behind it in brackets."""
    name = r"[A-Z][A-Z0-9_]*(?:[/+-][A-Z0-9_]+)*"
    return (
        rf"(?:{_BLANK}*(?:(?<z{n}>Z)(?![A-Z])|(?:(?:GMT|UTC?)(?=[+-]))?(?<of{n}>[+-]\d{{2}}(?::?\d{{2}})?)(?!\d)|(?<zn{n}>{name})))?"
        rf"(?:{_BLANK}*[\[(]{_BLANK}*(?<br{n}>{name})?[^\])]*[\])])?"
    )


_PATTERN = (
    rf"(?i)^{_BLANK}*(?:"
    # seconds, milliseconds or microseconds since 1970; an offset behind changes nothing
    rf"(?<ep>\d{{9,17}})(?:{_BLANK}+[+-]\d{{4}})?"
    rf"|(?:(?:{_DAYS})\.?,?{_BLANK}+)?(?:"
    r"(?<ya>\d{4})-(?<ma>\d{1,2})-(?<da>\d{1,2})"
    r"|(?<yb>\d{4})/(?<mb>\d{1,2})/(?<db>\d{1,2})"
    rf"|(?<yc>\d{{4}}){_BLANK}*\x{{5E74}}{_BLANK}*(?<mc>\d{{1,2}}){_BLANK}*\x{{6708}}{_BLANK}*(?<dc>\d{{1,2}}){_BLANK}*\x{{65E5}}"
    r"|(?<yd>\d{4})(?<md>\d{2})(?<dd>\d{2})"
    r"|(?<na>\d{1,2})(?<ns>[/.-])(?<nb>\d{1,2})\k<ns>(?<ye>\d{4}|\d{2})"
    rf"|(?<df>\d{{1,2}})(?:{_BLANK}+|-)(?<wf>{_MONTHS})\.?,?(?:{_BLANK}+|-)(?<yf>\d{{4}}|\d{{2}})"
    rf"|(?<wg>{_MONTHS})\.?{_BLANK}+(?<dg>\d{{1,2}}),?{_BLANK}+(?<yg>\d{{4}})"
    rf")(?:(?:{_BLANK}*T{_BLANK}*|,?{_BLANK}+)(?:{_clock('a')}|(?<hb>\d{{2}})(?<mib>\d{{2}})(?:(?<sb>\d{{2}})(?:[.,](?<fb>\d+))?)?){_zone('a')})?"
    # as the C library and date(1) write it: the year stands last
    rf"|(?:(?:{_DAYS})\.?,?{_BLANK}+)?(?<wh>{_MONTHS}){_BLANK}+(?<dh>\d{{1,2}}){_BLANK}+{_clock('h')}(?:{_BLANK}+(?<zm>[A-Z]{{2,5}}))?{_BLANK}+(?<yh>\d{{4}}){_zone('h')}"
    rf"){_BLANK}*\z"
)

# component -> the groups that may hold it; at most one of them matches
_PARTS = {
    "ep": ["ep"],
    "y": ["ya", "yb", "yc", "yd", "ye", "yf", "yg", "yh"],
    "m": ["ma", "mb", "mc", "md"],
    "d": ["da", "db", "dc", "dd", "df", "dg", "dh"],
    "na": ["na"],
    "nb": ["nb"],
    "w": ["wf", "wg", "wh"],
    "h": ["ha", "hb", "hh"],
    "mi": ["mia", "mib", "mih"],
    "s": ["sa", "sb", "sh"],
    "f": ["fa", "fb", "fh"],
    "ap": ["apa", "aph"],
    "z": ["za", "zh"],
    "of": ["ofa", "ofh"],
    "zn": ["zna", "znh", "zm"],
    "br": ["bra", "brh"],
}
_ORDER = list(_PARTS)
_REWRITE = _MARK + _SEP.join("".join(f"${{{g}}}" for g in groups) for groups in _PARTS.values())


def components(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the components of ``text`` in the order of ``_PARTS``; null where no notation fits.

    The rewritten text is a column of its own, so that the expression runs once a row.
    """
    free = ~(F.col(text).contains(_SEP) | F.col(text).contains(_MARK))
    df = df.withColumn(out, F.when(free, F.regexp_replace(text, _PATTERN, _REWRITE)))
    return df.withColumn(out, F.when(F.col(out).startswith(_MARK), F.split(F.substr(out, F.lit(2)), _SEP, -1)))


def zone_names(spark: SparkSession) -> list[str]:
    """The names that the JVM's zone database knows (about 600 short strings)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def normalise_timestamps(
    df: DataFrame,
    text: str,
    origin: str,
    origins: DataFrame,
    abbrevs: DataFrame,
    out: str = "utc_micros",
) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970 in UTC of the instant that ``text`` names, or null.

    ``origins`` (origin, zone_name, day_first) and ``abbrevs`` (abbrev, offset_minutes) are small
    tables; Catalyst broadcasts them if their size allows and joins by shuffle otherwise.

    Defined results: null, empty, blank, meaningless and impossible texts give null, also very long
    ones; an unknown abbreviation or zone name gives null; a text without zone whose origin is null
    or unknown gives null. Rows are neither dropped nor multiplied, also if ``origins`` or ``abbrevs``
    repeat a key (one of the repeated rows counts). Other columns stay as they are, whatever their
    names; a column called ``out`` is replaced.
    """
    known = [c for c in df.columns if c != out]
    keep = F.struct(*[F.col(f"`{c}`") for c in known]).alias("__row")
    base = components(df.select(keep, F.col(f"`{text}`").alias("__t"), F.col(f"`{origin}`").alias("__o")), "__t", "__p")
    part = {name: F.get(F.col("__p"), F.lit(i)) for i, name in enumerate(_ORDER)}
    full = lambda c: F.when(c != "", c)
    base = base.select(
        "__row",
        "__o",
        *[full(part[n]).alias(f"__{n}") for n in _ORDER if n not in ("zn", "br")],
        F.upper(F.coalesce(full(part["zn"]), full(part["br"]))).alias("__ab"),
    )
    names = ",".join(f"{z.upper()}={z}" for z in zone_names(df.sparkSession))
    known_zones = F.str_to_map(F.lit(names), F.lit(","), F.lit("="))
    small_o = origins.groupBy(F.col("origin").alias("__ok")).agg(
        F.min(F.struct("zone_name", "day_first")).alias("__og")
    )
    small_a = abbrevs.groupBy(F.upper("abbrev").alias("__ak")).agg(F.min("offset_minutes").alias("__am"))
    base = base.join(small_o, F.col("__o") == F.col("__ok"), "left").join(
        small_a, F.col("__ab") == F.col("__ak"), "left"
    )

    number = lambda n: F.col(f"__{n}").cast("bigint")
    month_name = F.expr("(instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(__w, 3))) + 2) div 3")
    day_first = F.coalesce(F.col("__og.day_first"), F.lit(False))
    base = base.select(
        "__row", "__ab", "__am", "__of", "__z", "__ep", "__ap", "__f", "__h",
        F.col("__og.zone_name").alias("__home"),
        (number("y") + F.when(F.length("__y") == 2, 2000).otherwise(0)).alias("__year"),
        F.when(F.col("__na").isNull(), F.coalesce(number("m"), month_name))
        .when(day_first, number("nb")).otherwise(number("na")).alias("__month"),
        F.when(F.col("__na").isNull(), number("d")).when(day_first, number("na")).otherwise(number("nb")).alias("__day"),
        F.coalesce(number("h"), F.lit(0)).alias("__hour"),
        F.coalesce(number("mi"), F.lit(0)).alias("__min"),
        F.coalesce(number("s"), F.lit(0)).alias("__sec"),
        # numbers only that end in the year need the origin's order
        (F.col("__na").isNull() | F.col("__og").isNotNull()).alias("__ordered"),
    )
    leap = "(__year % 4 = 0 and (__year % 100 <> 0 or __year % 400 = 0))"
    last_day = f"case when __month = 2 then if({leap}, 29, 28) when __month in (4, 6, 9, 11) then 30 else 31 end"
    valid = F.expr(
        f"__ordered and __year between 1 and 9999 and __month between 1 and 12 and __day between 1 and ({last_day})"
        " and __min <= 59 and __sec <= 59 and if(__ap is null, __hour <= 23, __hour between 1 and 12)"
    )
    # days since 1970 of a calendar day, in years that begin in March
    y = "(__year - if(__month <= 2, 1, 0))"
    days = (
        f"({y} div 400) * 146097 + ({y} % 400) * 365 + ({y} % 400) div 4 - ({y} % 400) div 100"
        " + (153 * (__month + if(__month > 2, -3, 9)) + 2) div 5 + __day - 1 - 719468"
    )
    hour = "if(__ap is null, __hour, __hour % 12 + if(lower(__ap) = 'p', 12, 0))"
    fraction = "cast(rpad(left(coalesce(__f, ''), 6), 6, '0') as bigint)"
    local = F.expr(f"((({days}) * 24 + {hour}) * 60 + __min) * 60000000 + __sec * 1000000 + {fraction}")
    off_h, off_m = "cast(substr(__of, 2, 2) as int)", "cast(coalesce(nullif(right(replace(__of, ':', ''), 2), ''), '0') as int)"
    off_m = f"if(length(__of) = 3, 0, {off_m})"
    offset = F.expr(
        f"case when __of is not null then if({off_h} <= 18 and {off_m} <= 59, ({off_h} * 60 + {off_m}) * if(left(__of, 1) = '-', -1, 1), null)"
        " when __z is not null then 0 else __am end"
    )
    named = F.when(F.col("__of").isNull() & F.col("__z").isNull() & F.col("__am").isNull(), F.try_element_at(known_zones, F.col("__ab")))
    written_zone = F.col("__of").isNotNull() | F.col("__z").isNotNull() | F.col("__ab").isNotNull()
    base = base.select(
        "__row",
        F.when(valid, local).alias("__local"),
        offset.alias("__offset"),
        F.when(~written_zone, F.col("__home")).otherwise(named).alias("__zone"),
        written_zone.alias("__has_zone"),
        F.expr(
            "case when __ep is null then null when length(__ep) <= 11 then cast(__ep as bigint) * 1000000"
            " when length(__ep) <= 14 then cast(__ep as bigint) * 1000 else cast(__ep as bigint) end"
        ).alias("__count"),
    )
    in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local"), F.coalesce("__zone", F.lit("UTC"))))
    instant = (
        F.when(F.col("__count").isNotNull(), F.col("__count"))
        .when(F.col("__has_zone") & F.col("__offset").isNotNull(), F.col("__local") - F.col("__offset").cast("bigint") * 60000000)
        .when(F.col("__zone").isNotNull(), in_zone)
    )
    return base.select(*[F.col("__row").getField(c).alias(c) for c in known], instant.alias(out))
