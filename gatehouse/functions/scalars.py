"""Scalar rules of the portal as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, labels and patterns of the portal's rules.
TITLE_CHARS, NAME_CHARS, REASON_CHARS, LINE_CHARS = 20, 120, 200, 120
NO_REASON = "workflow failed"
FINISHED = ("completed", "error", "paused")
STATUS_LABELS = {"completed": "已完成", "error": "失败", "paused": "已暂停", "waiting": "排队中", "parsing": "解析中", "splitting": "切分中", "indexing": "索引中", "cleaning": "清洗中"}
CONTENT_CHARS, STATUS_CHARS, FILE_BYTES = 8000, 24, 20 * 1024 * 1024
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
FORMULA = r"^[=+\-@\t\r]"
KINDS = {"application/pdf": "pdf", DOCX: "word", "text/plain": "text", "text/markdown": "markdown", "image/png": "image", "image/jpeg": "image"}
COLOURS = {"pdf": "#DC2626", "word": "#2563EB", "text": "#64748B", "markdown": "#0F766E", "image": "#D97706", "generic": "#94A3B8"}


def stripped(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(stripped(x), F.lit("")) == ""


def title(x: Column) -> Column:
    """The first code points of a question."""
    return F.substring(x, 1, TITLE_CHARS)


def safe_filename(x: Column) -> Column:
    """Last path segment with odd characters replaced, no leading dots, bounded; never empty."""
    last = F.substring_index(F.replace(x, F.lit("\\"), F.lit("/")), "/", -1)
    clean = F.substring(F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._\-\x{4e00}-\x{9fff}]", "_"), r"^\.+", ""), 1, NAME_CHARS)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("file"))


def safe_extension(x: Column) -> Column:
    """What follows the last dot, if it is short and plain, else "bin"."""
    own = F.lower(F.regexp_extract(x, r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.lit("bin"))


def mime_type(x: Column) -> Column:
    return F.lower(F.trim(F.substring_index(x, ";", 1)))


def _chosen(x: Column, by: dict[str, str], default: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in by.items():
        out = F.when(x == k, v).otherwise(out)
    return F.coalesce(out, default)


def mime_kind(x: Column) -> Column:
    """pdf, word, text, markdown, image or generic, by the exact type."""
    return _chosen(x, KINDS, F.lit("generic"))


def mime_colour(x: Column) -> Column:
    return _chosen(mime_kind(x), COLOURS, F.lit(COLOURS["generic"]))


def mime_class(x: Column) -> Column:
    """image or document."""
    return F.when(mime_type(x).startswith("image/"), "image").otherwise("document")


def file_reason(name: Column, size: Column, mime: Column) -> Column:
    """Why a file isn't taken: "size" above the limit, "type" for one that isn't allowed, unless its name ends in .txt or .md; null where it is."""
    by_name = F.lower(name).endswith(".txt") | F.lower(name).endswith(".md")
    return F.when(size > FILE_BYTES, "size").when(~F.coalesce(by_name, F.lit(False)) & ~F.coalesce(mime.isin(*KINDS), F.lit(False)), "type")


def status_label(x: Column, error: Column) -> Column:
    """The label of an indexing status, an unknown one as it is, with the beginning of the error, if any."""
    return F.concat(_chosen(x, STATUS_LABELS, x), F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("（"), F.substring(error, 1, STATUS_CHARS), F.lit("）"))).otherwise(""))


def is_finished(x: Column) -> Column:
    return F.coalesce(x.isin(*FINISHED), F.lit(False))


def content_of(query: Column, inputs: Column) -> Column:
    """A turn's question, or where there is none the beginning of its inputs as JSON."""
    return F.coalesce(F.nullif(query, F.lit("")), F.substring(F.to_json(inputs), 1, CONTENT_CHARS))


def workflow_title(order: Column, inputs: Column, query: Column) -> Column:
    """The first code points of the first non-blank input in the form's order, else of the question."""
    own = F.filter(F.transform(order, lambda n: stripped(F.coalesce(F.try_element_at(inputs, n), F.lit("")))), lambda v: v != "")
    return title(F.coalesce(F.try_element_at(own, F.lit(1)), query))


def uuid_of(x: Column) -> Column:
    """A UUID in its usual form from one written with or without hyphens, braces or a urn prefix; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    parts = [F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def iso_utc(x: Column) -> Column:
    """A UTC time as ISO 8601 with its offset; none is empty."""
    return F.coalesce(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def given(params: Column) -> Column:
    """A map's entries that are neither null nor empty."""
    return F.map_filter(params, lambda k, v: F.coalesce(v, F.lit("")) != "")


def redacted(x: Column) -> Column:
    """A failure's reason for readers: no addresses, no long lines, bounded."""
    text = stripped(F.regexp_replace(x, r"(?U)https?://\S+", "[url]"))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: (stripped(s) != "") & (F.length(s) <= LINE_CHARS))
    joined = F.array_join(F.transform(lines, stripped), " ")
    return stripped(F.coalesce(F.nullif(F.substring(F.when(joined == "", text).otherwise(joined), 1, REASON_CHARS), F.lit("")), F.lit(NO_REASON)))


def size_label(n: Column) -> Column:
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    return F.when(n <= 0, "0 B").when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024 / 1024))


def relative_time(at: Column, now: Column) -> Column:
    """The time for the same day, days ago within a week, else month and day."""
    days = F.datediff(now, at)
    return F.when(days == 0, F.date_format(at, "HH:mm")).when(days < 7, F.concat(days.cast("string"), F.lit(" 天前"))).otherwise(F.date_format(at, "MM-dd"))


def detail_label(x: Column) -> Column:
    """A JSON object's entries as "k=v · k=v"; what isn't an object as it is."""
    entries = F.map_entries(F.from_json(x, "map<string,string>"))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), " · "), x)


def csv_guarded(x: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(x.rlike(FORMULA), F.concat(F.lit("'"), x)).otherwise(x)


def first_missing(required: Column, inputs: Column) -> Column:
    """The first of the required names whose input is absent or blank."""
    return F.try_element_at(F.filter(required, lambda n: is_blank(F.try_element_at(inputs, n))), F.lit(1))


def epoch_time(x: Column) -> Column:
    """Seconds, or milliseconds when above 10^12, since 1970; 0 is none."""
    return F.when(x == 0, None).when(x > 10**12, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def stale(server: Column, build: Column) -> Column:
    """Two known versions, neither of them "dev", that differ."""
    return F.coalesce((F.nullif(server, F.lit("")) != F.nullif(build, F.lit(""))) & (server != "dev") & (build != "dev"), F.lit(False))


def upstream_outcome(status: Column, body: Column) -> Column:
    """What a gateway answers for an upstream's status and body: ok, a kept 4xx, or 502, with its message."""
    message = F.coalesce(F.nullif(F.get_json_object(body, "$.message"), F.lit("")), F.nullif(F.get_json_object(body, "$.code"), F.lit("")), F.concat(F.lit("HTTP "), status.cast("string")))
    return F.when(status.isNull(), F.lit("502 unreachable")).when(status >= 500, F.concat(F.lit("502 "), message)).when(status >= 400, F.concat(status.cast("string"), F.lit(" "), message)).when(~is_blank(body) & F.get_json_object(body, "$").isNull(), F.lit("502 no JSON")).otherwise("ok")
