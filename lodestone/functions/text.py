"""Scalar text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schema import IMAGE_EXTENSIONS

#: What an upload's HTTP status means to a user.
STATUS_MESSAGES = {422: "The image could not be read. Try another photo.", 503: "The service is starting. Try again shortly."}


def slugify(c: Column) -> Column:
    """Lower-case words joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeeze(c: Column) -> Column:
    """Inner white space to single spaces, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def genus(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(squeeze(c), " "), F.lit(1)), F.lit(""))


def epithet(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(squeeze(c), " "), F.lit(2)), F.lit(""))


def display_name(slug: Column) -> Column:
    """Dashes to spaces; only the first letter is a capital."""
    s = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def url_extension(url: Column, default: str = "jpg") -> Column:
    """The last path part's extension if it is a known image type, else the default.

    The last part is what follows the last slash of the whole URL, before any query.
    """
    last = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    ext = F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(F.lit(default))


def resize_url(url: Column, old: str = "square", new: str = "medium") -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def parse_location(c: Column) -> Column:
    """"lat,lon" as a struct of two doubles: both or neither."""
    parts = F.split(c, ",")
    lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    whole = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(whole, lat).alias("lat"), F.when(whole, lon).alias("lon"))


def to_double(c: Column) -> Column:
    """A number or null; NaN counts as missing."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_int(c: Column) -> Column:
    """A whole number in digits or null: "12.0" is null."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))


def default_if_blank(c: Column, default) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def uri_backend(c: Column) -> Column:
    scheme = F.regexp_extract(c, r"^([a-z0-9]+)://", 1)
    return F.when(scheme == "gs", "gcs").when(scheme.isin("s3", "s3a"), "s3").otherwise("file")


def uri_bucket(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-z0-9]+://)?([^/]+)", 1)


def object_key(slug: Column, photo_id: Column, extension: Column, prefix: str = "") -> Column:
    name = F.concat(photo_id.cast("string"), F.lit("."), extension)
    return F.concat_ws("/", *([F.lit(prefix.strip("/"))] if prefix else []), slug, name)


def sample_key(slug: Column, path: Column) -> Column:
    """A file's portable name: its slug and stem."""
    return F.concat(slug, F.lit("/"), F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", ""))


def numbered_name(prefix: str, n: Column, extension: str = "jpg") -> Column:
    return F.format_string(f"{prefix}_%03d.{extension}", n)


def status_message(status: Column) -> Column:
    out = F.when(status.isNull(), F.lit("No connection to the service."))
    for code, message in STATUS_MESSAGES.items():
        out = out.when(status == code, F.lit(message))
    return out.otherwise(F.concat(F.lit("The service failed with status "), status.cast("string"), F.lit(".")))


def percentage(n: Column, d: Column) -> Column:
    return F.coalesce(F.round(100 * F.try_divide(n.cast("double"), d.cast("double")), 2), F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def quota(total: Column, groups: Column) -> Column:
    """Rows a group may give: the ceiling of total over groups, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / groups))


#: Where specimen payloads keep their records, and records their shot, image and sizes.
_SPECIMENS = ("specimenImages", "images")
_SHOT = ("shotType", "shot_type")
_IMAGE = ("image", "url", "imageURL", "originalThumbnailUrl")
_SIZES = ("original", "high")
#: What counts as nothing there.
_NOTHING = ("", "null", "false", "0", "0.0", "[]", "{}")


def _first_there(values: list[Column]) -> Column:
    return F.coalesce(*[F.when(~v.isin(*_NOTHING), v) for v in values])


def specimen_records(payload: Column) -> Column:
    """An array of (shot_type, url): the images that a specimen payload holds, in its order.

    Records are a list, or an object of which the values count, under one of several keys; what is no
    object is passed over.  A record's image is text or an object of sizes; of these the
    original comes first, then the high one, then whatever is first.  JSON objects are read as maps of
    raw values, which keep the document's order (VARIANT sorts keys).  Anything else that is no such
    payload gives an empty array.
    """
    raw = lambda c: F.from_json(c, "map<string,string>")
    top = F.from_json(payload, ", ".join(f"{k} string" for k in _SPECIMENS))
    held = _first_there([top[k] for k in _SPECIMENS])
    parts = F.when(held.startswith("["), F.from_json(held, "array<string>")).when(held.startswith("{"), F.map_values(raw(held)))
    objects = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda r: r.startswith("{"))

    def image(m):
        found = _first_there([F.try_element_at(m, F.lit(k)) for k in _IMAGE])
        sizes = raw(found)
        size = _first_there([F.try_element_at(sizes, F.lit(k)) for k in _SIZES])
        return F.when(found.startswith("{"), F.coalesce(size, F.get(F.map_values(sizes), F.lit(0)))).otherwise(found)

    def record(m):
        return F.struct(F.lower(F.coalesce(_first_there([F.try_element_at(m, F.lit(k)) for k in _SHOT]), F.lit(""))).alias("shot_type"), image(m).alias("url"))

    records = F.transform(F.transform(objects, raw), record)
    return F.filter(records, lambda r: ~F.coalesce(r["url"], F.lit("")).isin(*_NOTHING))
