"""Place-name rules: countries, states, postcodes, city and neighbourhood labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import bind, blank_null, extract, first_filled, fixed3, let, lookup, squeeze, strip
from weekgrid.functions.text import clean_part, collapse_address, same_name, slugify

# Country aliases after upper-casing and dropping dots.
COUNTRY_ALIASES = {
    "UNITED STATES": "US",
    "USA": "US",
    "U.S.A": "US",
    "UNITED STATES OF AMERICA": "US",
    "UNITED KINGDOM": "GB",
    "UK": "GB",
    "GREATBRITAIN": "GB",
    "BRASIL": "BR",
    "BRAZIL": "BR",
    "CANADA": "CA",
    "AUSTRALIA": "AU",
    "NEW ZEALAND": "NZ",
    "IRELAND": "IE",
}
# US, Canadian and Australian state codes.
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA",
    "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR",
    "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY", "AB", "BC", "MB", "NB", "NL", "NS",
    "NT", "NU", "ON", "PE", "QC", "SK", "YT", "ACT", "NSW", "QLD", "SA", "TAS", "VIC",
)
# City aliases, municipalities that own their districts, labels that are no city.
CITY_ALIASES = {
    "greater london": "London",
    "city of london": "London",
    "nyc": "New York",
    "new york city": "New York",
    "the bronx": "Bronx",
    "okc": "Oklahoma City",
}
MUNICIPALITIES = ("london", "brooklyn", "manhattan", "queens", "bronx", "staten island", "new york")
GENERIC_LABELS = ("online", "virtual", "regional", "tbd")
# Country names skipped inside a formatted address.
ADDRESS_COUNTRIES = ("usa", "us", "uk", "gb", "united kingdom", "united states", "great britain")
# Patterns.
STATE_ZIP = r"^([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)$"
ZIP = r"^\d{5}(?:-\d{4})?$"
CA_POSTAL = r"^[A-Za-z]\d[A-Za-z]\s*\d[A-Za-z]\d$"
UK_POSTAL = r"^[A-Za-z]{1,2}\d[A-Za-z\d]?\s*\d[A-Za-z]{2}$"
UK_OUTWARD = r"^[A-Za-z]{1,2}\d[A-Za-z\d]?$"
DIRECTION = r"(?i)^(?:north|south|east|west|downtown|central|upper|lower)\s+(.+)$"
STREET = (
    r"(?i)(?=[srglwadcpt])\b(street|road|rd|gardens|gdns|gdn|lane|ln|wharf|avenue|ave|close|drive|way|terrace|"
    r"crescent|parade|place)\b"
)
UK_POSTCODE = r"(?i)(?=[A-Z])\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
UK_STREET = (
    r"(?i)(?=[rslacdwhgtp])\b(road|rd|street|st|lane|ln|avenue|ave|close|drive|way|hill|gardens|gdns|terrace|place)\b"
)


# One pattern per question, so that each predicate is a single match on a clean part.
_ZIP_STATES = "|".join(code for code in STATE_CODES if len(code) == 2)
# The start is asked for once, and short looks ahead keep the long lists of codes off most texts.
_POSTAL = "|".join(p.removeprefix("^") for p in (ZIP, CA_POSTAL, UK_POSTAL, UK_OUTWARD)) + (
    f"|(?=[A-Z]{{2}}\\s)(?:{_ZIP_STATES})\\s+\\d{{5}}(?:-\\d{{4}})?$"
)
_STATE = f"(?=[A-Z]{{2,3}}$)(?:{'|'.join(STATE_CODES)})$"
_GENERIC = f"(?:{'|'.join(GENERIC_LABELS)})$"
POSTAL = f"(?i)^(?:{_POSTAL})"
STATE = f"(?i)^{_STATE}"
AREA = r"^\d{1,2}\s| / "
# Two to 80 signs that are none of what the city and neighbourhood columns must not hold.
CITY = f"(?s)^(?!(?i:{_POSTAL}|{_STATE}|\\d{{1,2}}\\s|{_GENERIC})|.* / ).{{2,80}}\\z"
HOOD = f"(?s)^(?!(?i:{_POSTAL}|{_STATE}|{_GENERIC})|.* / ).{{2,80}}\\z"
MUNICIPAL_ALIASES = ("greater london", "city of london", "nyc", "new york city", "the bronx")
MUNICIPALITY = "(?i)^(?:" + "|".join(MUNICIPALITIES + MUNICIPAL_ALIASES) + ")$"


def _true(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _matches(part: Column, pattern: str) -> Column:
    return _true(part.rlike(pattern))


def normalize_country(value: Column) -> Column:
    cleaned = clean_part(value)
    upper = F.replace(F.upper(cleaned), F.lit("."), F.lit(""))
    return F.coalesce(
        lookup(COUNTRY_ALIASES, upper), F.when(F.length(upper) == 2, upper), cleaned
    )


def is_state_code(value: Column) -> Column:
    return _matches(clean_part(value), STATE)


def _postal_parts(part: Column) -> Column:
    spaced = F.regexp_replace(F.upper(part), r"^(\S+)\s+", "$1 ")
    two = part.rlike(STATE_ZIP)
    return F.when(
        part.rlike(POSTAL),
        F.struct(
            F.when(two, F.upper(F.substring(part, 1, 2))).alias("state"),
            F.when(two, extract(part, STATE_ZIP, 2)).otherwise(spaced).alias("postal"),
        ),
    )


def postal_parts(value: Column) -> Column:
    """{state, postal} of a text that is a postcode, optionally after a state code; else null."""
    return _postal_parts(clean_part(value))


def is_postal(value: Column) -> Column:
    return _matches(clean_part(value), POSTAL)


def is_area_name(value: Column) -> Column:
    """Names of service areas: a leading number, or a pair around a slash."""
    return _matches(clean_part(value), AREA)


def normalize_state(value: Column) -> Column:
    """State codes in capitals, other names as they are; area names and postcodes are no state."""
    part = clean_part(value)
    return F.when(
        ~part.rlike(f"{POSTAL}|{AREA}"), F.when(part.rlike(STATE), F.upper(part)).otherwise(part)
    )


def _hood(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, r"^\d{1,2}\s+", ""))


def clean_neighborhood(value: Column) -> Column:
    stripped = _hood(clean_part(value))
    return F.when(~stripped.rlike(f"{POSTAL}|{STATE[4:]}| / |^$"), stripped)


def canonical_city(value: Column) -> Column:
    cleaned = clean_part(value)
    return F.coalesce(lookup(CITY_ALIASES, F.lower(cleaned)), cleaned)


def is_municipality(value: Column) -> Column:
    return _matches(clean_part(value), MUNICIPALITY)


def _usable_city(part: Column) -> Column:
    return _matches(part, CITY)


def is_usable_city(value: Column) -> Column:
    return _usable_city(clean_part(value))


def is_usable_neighborhood(value: Column) -> Column:
    return _matches(_hood(clean_part(value)), HOOD)


def is_plausible_state(value: Column) -> Column:
    part = clean_part(value)
    return part.isNull() | (
        ~_matches(part, f"{POSTAL}|{AREA}|{MUNICIPALITY[4:]}")
        & _true(part.rlike(STATE) | ((F.length(part) <= 40) & ~part.rlike(r"\d")))
    )


def promote_directional(value: Column) -> Column:
    """'North London' to its municipality; null for anything else."""
    base = extract(value, DIRECTION)
    return F.when(_matches(base, MUNICIPALITY), canonical_city(base))


def region_hint(hint: Column) -> Column:
    """{country, state} from hints such as US-CA; online and multi-country hints give nulls."""
    text = F.upper(strip(hint))
    usable = text.rlike("^[A-Z]{2}(-|$)") & ~text.isin("ONLINE", "EU")
    return F.struct(
        F.when(usable, F.substring(text, 1, 2)).alias("country"),
        F.when(usable & F.contains(text, F.lit("-")), F.substring(text, 4, 1000)).alias("state"),
    )


def with_region_hint(df: DataFrame, hint: Column) -> DataFrame:
    """Normalise state and country, filling only what is missing from the hint."""
    parts = region_hint(hint)
    return df.withColumns(
        {
            "state": F.coalesce(normalize_state(F.col("state")), parts["state"]),
            "country": F.coalesce(normalize_country(F.col("country")), parts["country"]),
        }
    )


# --- formatted addresses -------------------------------------------------------------------


def _parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), strip), lambda p: p != "")


def formatted_place(address: Column, country: Column) -> Column:
    """{formatted_address, city, neighborhood, postal_code} read off a comma-separated address.

    Bare postcodes are pulled out first. The city is the first part that names a known
    municipality; the neighbourhood is the nearest usable part before it, unless a street
    comes nearer.
    """

    def plain_postal(part: Column) -> Column:
        spaced = F.regexp_replace(F.upper(part), r"^(\S+)\s+", "$1 ")
        return F.when(part.rlike(POSTAL) & ~part.rlike(STATE_ZIP), spaced)

    def split_postal(b: Column) -> Column:
        places = F.filter(b["parts"], lambda p: plain_postal(p).isNull())
        return F.struct(*_fields(b, "address", "country", "parts"), places.alias("places"))

    def find_city(b: Column) -> Column:
        at = F.array_position(F.transform(b["places"], is_municipality), True).cast("int")
        return F.struct(*_fields(b, "address", "country", "parts", "places"), at.alias("city_at"))

    def find_neighbor(b: Column) -> Column:
        def decisive(part: Column) -> Column:
            named_country = F.lower(part).isin(*ADDRESS_COUNTRIES) | _true(F.lower(part) == b["country"])
            return part.rlike(STREET) | ~(named_country | part.rlike(f"{POSTAL}|{STATE[4:]}"))

        before = F.reverse(F.slice(b["places"], F.lit(1), F.greatest(b["city_at"] - 1, F.lit(0))))
        nearest = F.get(F.filter(before, decisive), F.lit(0))
        return F.struct(*_fields(b, "address", "parts", "places", "city_at"), nearest.alias("nearest"))

    def result(b: Column) -> Column:
        usable = ~b["nearest"].rlike(STREET) & is_usable_neighborhood(b["nearest"])
        return F.struct(
            b["address"].alias("formatted_address"),
            F.when(b["city_at"] > 0, canonical_city(F.get(b["places"], b["city_at"] - 1))).alias("city"),
            F.when(usable, clean_neighborhood(b["nearest"])).alias("neighborhood"),
            first_filled(F.transform(b["parts"], plain_postal)).alias("postal_code"),
        )

    def parts_of(b: Column) -> Column:
        parts = F.coalesce(_parts(b["address"]), F.array().cast("array<string>"))
        return F.struct(*_fields(b, "address", "country"), parts.alias("parts"))

    bound = F.struct(
        collapse_address(address).alias("address"), blank_null(F.lower(strip(country))).alias("country")
    )
    for step in (parts_of, split_postal, find_city, find_neighbor, result):
        bound = let(bound, step)
    return bound


def _fields(row: Column, *names: str) -> list[Column]:
    return [row[n].alias(n) for n in names]


def city_from_address(address: Column, country: Column) -> Column:
    """Best-guess city of an address that names no known municipality."""

    def read(at: Column) -> Column:
        parts = at["parts"]

        def guess(part: Column) -> Column:
            lower = F.lower(part)
            skipped = (
                lower.isin("usa", "us", "uk", "united kingdom", "united states")
                | _true(lower == at["country"])
                | part.rlike(r"^\d|^[A-Z]{1,2}\d")
                | (F.length(part) > 40)
                | part.rlike(f"{POSTAL}|{STATE[4:]}|{AREA}")
            )
            candidate = clean_part(F.regexp_replace(part, r"\s+[A-Z]{2}(?:\s+\d.*)?$", ""))
            return (
                F.when(skipped, F.lit(None).cast("string"))
                .when(F.contains(lower, F.lit("london")), F.lit("London"))
                .when(F.array_position(parts, part) > 1, let(candidate, usable))
            )

        def usable(label: Column) -> Column:
            return F.when(is_usable_city(label), label)

        second = clean_part(F.get(parts, F.lit(1)))
        return F.coalesce(first_filled(F.transform(parts, guess)), let(second, usable))

    address = collapse_address(address)
    bound = F.struct(_parts(address).alias("parts"), F.lower(country).alias("country"))
    return let(bound, read)


# --- the ordered normalisation -------------------------------------------------------------


def normalize_place(df: DataFrame) -> DataFrame:
    """Bring city, neighborhood, state, postal_code and country into their proper columns.

    Each step is one projection, because the order of the rules decides the result: postcodes
    found in the wrong column, service-area names, a city and state in each other's place, a
    municipality given as state, directional districts, repeated names, final validation.
    """
    c = F.col
    city, hood, state = c("city"), c("neighborhood"), c("state")
    df = df.withColumns(
        {
            "city": clean_part(city),
            "neighborhood": clean_neighborhood(hood),
            "state": clean_part(state),
            "postal_code": clean_part(c("postal_code")),
            "country": normalize_country(c("country")),
        }
    )
    # A postcode in the city column: the old state may turn out to be the city or an area.
    df = df.withColumn("_code", _postal_parts(city))
    hit = c("_code").isNotNull()
    area = hit & _matches(state, AREA)
    leftover_city = _usable_city(state) & ~_matches(state, AREA) & state.isNotNull()
    df = df.withColumns(
        {
            "postal_code": F.coalesce(c("postal_code"), c("_code.postal")),
            "neighborhood": F.when(area, F.coalesce(hood, clean_neighborhood(state))).otherwise(hood),
            "city": F.when(hit, F.when(leftover_city, state)).otherwise(city),
            "state": F.coalesce(c("_code.state"), state),
        }
    )
    # A postcode in the state column.
    df = df.withColumn("_code", _postal_parts(state))
    df = df.withColumns(
        {
            "postal_code": F.coalesce(c("postal_code"), c("_code.postal")),
            "state": F.when(c("_code").isNotNull(), c("_code.state")).otherwise(state),
        }
    ).drop("_code")
    # Service-area names belong to the neighbourhood.
    for column in (state, city):
        name = "state" if column is state else "city"
        df = df.withColumns(
            {
                "neighborhood": F.when(
                    _matches(column, AREA), F.coalesce(hood, clean_neighborhood(column))
                ).otherwise(hood),
                name: F.when(~_matches(column, AREA), column),
            }
        )
    # City and state given in each other's column.
    swapped = _matches(city, STATE) & ~_matches(state, STATE) & _usable_city(state) & state.isNotNull()
    df = df.withColumns(
        {
            "city": F.when(swapped, state).otherwise(city),
            "state": F.when(swapped, F.upper(city)).otherwise(state),
        }
    )
    # A municipality given as the state: the city is one of its districts.
    district = _matches(state, MUNICIPALITY) & city.isNotNull() & ~_matches(city, STATE) & ~_matches(city, MUNICIPALITY)
    df = df.withColumns(
        {
            "neighborhood": F.when(district, F.coalesce(hood, city)).otherwise(hood),
            "city": F.when(district, canonical_city(state)).otherwise(city),
            "state": F.when(~district, state),
        }
    )
    # Directional districts.
    df = df.withColumn("_whole", promote_directional(city))
    promoted = c("_whole").isNotNull()
    df = df.withColumns(
        {
            "neighborhood": F.when(promoted, F.coalesce(hood, city)).otherwise(hood),
            "city": F.coalesce(c("_whole"), city, promote_directional(hood)),
        }
    ).drop("_whole")
    df = df.withColumn("city", canonical_city(city))
    # Repeated names, then validation.
    df = df.withColumns(
        {
            "state": F.when(~same_name(city, state), state),
            "neighborhood": F.when(~same_name(city, hood), hood),
        }
    )
    return bind(
        df,
        city=F.when(_usable_city(city), city),
        neighborhood=F.when(is_usable_neighborhood(hood), hood),
        state=F.when(is_plausible_state(state), normalize_state(state)),
        postal_code=c("postal_code"),
        country=c("country"),
    )


def needs_enrichment(city: Column, state: Column, country: Column) -> Column:
    return (
        ~is_usable_city(city)
        | country.isNull()
        | (_true(country.isin("US", "CA", "AU")) & state.isNull())
        | ~is_plausible_state(state)
    )


def place_fingerprint(
    city: Column, neighborhood: Column, state: Column, postal: Column, country: Column, lat: Column, lng: Column
) -> Column:
    parts = [city, neighborhood, state, postal, country, F.when(lat.isNotNull(), fixed3(lat)), F.when(lng.isNotNull(), fixed3(lng))]
    return F.concat_ws("|", *[strip(F.lower(F.coalesce(p, F.lit("")))) for p in parts])


def reverse_key(lat: Column, lng: Column) -> Column:
    return F.when(
        lat.isNotNull() & lng.isNotNull(), F.concat(F.lit("rev:"), F.format_string("%.4f,%.4f", lat, lng))
    )


def merge_place(df: DataFrame, extra: Column) -> DataFrame:
    """Fill the place columns of `df` from the struct `extra`; rows where it is null stay as they are.

    The present value wins unless it is unusable. Where the extra neighbourhood is the present
    city, the extra city takes over.
    """
    c = F.col
    promoted = (
        F.coalesce(extra["city"] != "", F.lit(False))
        & _true(slugify(extra["neighborhood"]) == slugify(c("city")))
        & _true(extra["neighborhood"] != "")
    )
    merged = {
        "city": F.when(promoted, extra["city"])
        .when(is_usable_city(c("city")), c("city"))
        .otherwise(extra["city"]),
        "neighborhood": F.when(promoted, extra["neighborhood"]).otherwise(
            F.coalesce(c("neighborhood"), extra["neighborhood"])
        ),
        "state": F.when(c("state").isNotNull() & is_plausible_state(c("state")), c("state")).otherwise(extra["state"]),
        "postal_code": F.coalesce(c("postal_code"), extra["postal_code"]),
        "country": F.coalesce(c("country"), extra["country"]),
    }
    kept = df.withColumn("_hit", extra.isNotNull()).withColumn(
        "_was", F.struct(*[c(name) for name in merged])
    )
    filled = normalize_place(
        kept.withColumns({n: F.when(c("_hit"), v).otherwise(c(n)) for n, v in merged.items()})
    )
    return filled.withColumns(
        {n: F.when(c("_hit"), c(n)).otherwise(c(f"_was.{n}")) for n in merged}
    ).drop("_hit", "_was")


def city_key(
    city: Column, state: Column, country: Column, cell: Column, neighborhood: Column | None = None
) -> Column:
    """Stable key of a city or neighbourhood; without a country the cell prefix tells places apart."""

    def part(value: Column, default: str) -> Column:
        return F.coalesce(blank_null(slugify(value)), F.lit(default))

    scope = F.when(
        blank_null(country).isNull(),
        F.concat(F.lit("-"), F.coalesce(blank_null(F.substring(cell, 1, 3)), F.lit("geo"))),
    ).otherwise("")
    tail = F.concat(F.concat_ws("-", part(city, "city"), part(state, "xx"), part(country, "xx")), scope)
    if neighborhood is None:
        return tail
    return F.when(
        blank_null(neighborhood).isNotNull(), F.concat(slugify(neighborhood), F.lit("-"), tail)
    ).otherwise(tail)


def city_caption(label: Column, parent: Column, state: Column, country: Column) -> Column:
    other_parent = F.when(slugify(parent) != slugify(label), parent)
    return F.concat_ws(", ", label, blank_null(other_parent), blank_null(state), blank_null(country))


# --- UK addresses --------------------------------------------------------------------------


def format_uk_postcode(value: Column) -> Column:
    compact = F.regexp_replace(F.upper(value), r"\s+", "")
    return let(compact, lambda v: F.when(v.rlike(r"^[A-Z]{1,2}\d[A-Z\d]?\d[A-Z]{2}$"), F.regexp_replace(v, r"^(.*)(.{3})$", "$1 $2")))


def uk_postcode_in(value: Column) -> Column:
    return let(F.regexp_extract(value, UK_POSTCODE, 1), lambda code: F.when(code != "", format_uk_postcode(code)))


def format_uk_city(value: Column) -> Column:
    """Drop a trailing GB; all-capitals names become title case; country names become empty."""

    def spell(city: Column) -> Column:
        # Title case starts a word after any sign, so signs are set apart while it is applied.
        apart = F.regexp_replace(F.lower(city), r"([^A-Za-z0-9_ ])", "$1\u0001 ")
        titled = F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))
        return (
            F.when(city.rlike("(?i)^(gb|uk|united kingdom)$"), F.lit(""))
            .when(city != F.upper(city), city)
            .otherwise(titled)
        )

    return let(squeeze(F.regexp_replace(value, r"(?i),\s*GB$", "")), spell)


def is_uk_street(value: Column) -> Column:
    saint = value.rlike(r"(?i)^st\.?\s+\S")
    return value.rlike(r"^\d") | (~saint & value.rlike(UK_STREET))


def uk_city_and_postcode(address: Column) -> Column:
    """{city, postal_code}: the last part of the address that is neither country nor street."""

    def read(at: Column) -> Column:
        bare = F.when(
            at["code"].isNotNull(), F.regexp_replace(at["address"], UK_POSTCODE + r"(?s)(.*)$", " $2")
        ).otherwise(at["address"])
        parts = F.filter(
            F.transform(F.split(bare, ","), squeeze),
            lambda p: (p != "") & ~p.rlike("(?i)^(uk|united kingdom|gb)$"),
        )
        undotted = F.transform(F.reverse(parts), lambda p: F.regexp_replace(p, r"[.\s]+$", ""))
        town = F.get(F.filter(undotted, lambda p: (p != "") & ~is_uk_street(p)), F.lit(0))
        return F.struct(
            blank_null(format_uk_city(town)).alias("city"), at["code"].alias("postal_code")
        )

    bound = F.struct(F.coalesce(address, F.lit("")).alias("address"), uk_postcode_in(address).alias("code"))
    return let(bound, read)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


