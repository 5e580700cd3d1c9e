"""Column expressions over names, paths, statuses, JSON and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, patterns, sizes and texts that results must equal.
TYPE_EXTENSION = {"bim": ".ifc", "pointcloud": ".las"}
MESH_EXTENSIONS = (".glb", ".gltf", ".obj", ".stl", ".off", ".ply")
COLOR = "^#[0-9a-fA-F]{6}$"
GUID = "^[0-9A-Za-z_$]{22}$"
CHUNK = 5 * 1024 * 1024
IFC_KEYS = ("expressID", "ExpressID", "expressId", "ifcId", "ifcID", "IfcId", "globalId", "GlobalId", "guid", "GUID", "IfcGUID", "ifcGuid")
STATUS_TEXT = {"uploading": "文件上传中", "queued": "解析中", "processing": "解析中", "ready": "已解析", "failed": "处理失败，请重新上传", "terminated": "上传已终止"}
STATUS_TEXT_ELSE = "状态待更新"
STATUS_TAG = {"ready": "success", "uploading": "warning", "queued": "warning", "processing": "warning", "failed": "danger", "terminated": "danger"}
STATUS_TAG_ELSE = "info"
REMESH_TEXT = {"queued": "均匀化排队中", "processing": "均匀化处理中", "succeeded": "网格已均匀化", "failed": "均匀化失败"}
REMESH_TEXT_ELSE = "等待均匀化"
UPLOAD_ERRORS = {400: "请求参数错误，请检查文件类型和大小", 401: "登录状态已失效，请重新登录", 404: "上传会话不存在，请重新上传", 409: "上传偏移不一致，已自动中断，请重新上传", 413: "文件过大，超出服务端限制", 415: "当前文件类型不受支持"}
UPLOAD_ERRORS_FIXED = (401, 404, 413)
UPLOAD_ERROR_SERVER, UPLOAD_ERROR_ELSE = "服务器暂时不可用，请稍后重试", "上传失败，请稍后重试"
NO_TIME = "时间未记录"


def extension(name: Column) -> Column:
    """Lower-case last extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def valid_extension(kind: Column, name: Column) -> Column:
    out = F.lit(False)
    for k, e in TYPE_EXTENSION.items():
        out = F.when(kind == k, extension(name) == e).otherwise(out)
    return out


def mesh_extension(name: Column) -> Column:
    return extension(name).isin(*MESH_EXTENSIONS)


def accepted_extension(name: Column, extensions: Column) -> Column:
    """Extensions without a dot, as upload forms list them."""
    return F.array_contains(F.transform(extensions, lambda e: F.lower(e)), F.lower(F.element_at(F.split(name, r"\."), -1)))


def stored_color(text: Column, fallback: str | None = None) -> Column:
    return F.when(text.rlike(COLOR), F.lower(text)).otherwise(F.lit(fallback))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def contained_path(path: Column) -> Column:
    """Whether a relative path stays below its base: no prefix of its parts climbs above it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    state = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), (s["ok"] & (s["depth"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")))
    return ~path.startswith("/") & state["ok"]


def rebase(path: Column, old: str, new: str) -> Column:
    """path below old as the same path below new; other paths as they are."""
    old, new = old.rstrip("/"), new.rstrip("/")
    below = (path == old) | path.startswith(f"{old}/")
    return F.when(below, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def upload_metadata(text: Column) -> Column:
    """Map of "key base64,key base64"; entries that don't decode are left out."""
    entries = F.transform(F.split(text, ","), lambda e: F.split(F.trim(e), " "))
    entries = F.filter(entries, lambda p: (F.size(p) == 2) & F.try_to_binary(p[1], F.lit("base64")).isNotNull())
    return F.map_from_entries(F.transform(entries, lambda p: F.struct(p[0], F.decode(F.try_to_binary(p[1], F.lit("base64")), "UTF-8"))))


def encoded_metadata(values: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(" "), F.base64(F.encode(e["value"], "UTF-8")))), ",")


def error_message(text: Column, *keys: str) -> Column:
    """The first of the JSON fields that isn't blank, else the text itself; white space collapsed, at most 300 bytes."""
    fields = [F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit("")) for k in keys or ("msg", "message", "detail")]
    return bounded_log(F.coalesce(*fields, text))


def client_error(text: Column) -> Column:
    """msg, else message of a JSON answer, as it is; null where both are blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in (F.get_json_object(text, "$.msg"), F.get_json_object(text, "$.message"))])


def bounded_log(text: Column, most: int = 300) -> Column:
    """White space collapsed, cut to so many bytes of UTF-8 (a character that the cut splits goes whole)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.decode(F.substring(F.encode(flat, "UTF-8"), 1, most), "UTF-8")
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def element_id(name: Column, metadata_id: Column, parent_id: Column) -> Column:
    """A 22-character id as it is, else what stands before the first underscore; without a name the metadata's id, then the parent's."""
    name = F.nullif(F.trim(name), F.lit(""))
    before = F.nullif(F.trim(F.split(name, "_")[0]), F.lit(""))
    return F.when(name.rlike(GUID), name).otherwise(F.coalesce(before, name, metadata_id, parent_id))


def ifc_id(values: Column, *nested: Column) -> Column:
    """The first of the usual keys that isn't blank; then the same in the first of the nested maps that is there."""
    maps = [values, F.coalesce(*nested)] if nested else [values]
    return F.coalesce(*[F.nullif(F.trim(m[k]), F.lit("")) for m in maps for k in IFC_KEYS])


def matrix_from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def histogram_from_json(text: Column) -> Column:
    return F.from_json(text, "struct<binEdges:array<double>,counts:array<bigint>>")


def parameters(text: Column) -> tuple[Column, Column]:
    """(map of parameters, whether the text is valid); null and "null" are no parameters."""
    blank = text.isNull() | (F.trim(text) == "null")
    parsed = F.from_json(text, "map<string,string>")
    return F.when(blank, F.create_map().cast("map<string,string>")).otherwise(parsed), blank | parsed.isNotNull()


def envelope(code: Column, msg: Column, data: Column) -> Column:
    return F.to_json(F.struct(code.alias("code"), msg.alias("msg"), data.alias("data")))


def _plain_year(text: Column) -> Column:
    """Spark puts a plus sign before years of more than four digits."""
    return F.regexp_replace(text, r"^\+", "")


def _utc(epoch: Column, separator: str, end: Column) -> Column:
    """Date and time of day of epoch seconds by arithmetic, so that the session's zone doesn't matter."""
    day = _plain_year(F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string"))
    second = F.pmod(epoch, F.lit(86400))
    return F.concat(day, F.lit(separator), F.format_string("%02d:%02d", F.floor(second / 3600), F.floor(F.pmod(second, F.lit(3600)) / 60)), end)


def rfc3339(epoch: Column) -> Column:
    return _utc(epoch, "T", F.format_string(":%02dZ", F.pmod(epoch, F.lit(60)).cast("bigint")))


def minute_text(epoch: Column, missing: str = NO_TIME) -> Column:
    """Minutes in the session's zone; null and 0 are no time."""
    return F.coalesce(_plain_year(F.date_format(F.timestamp_seconds(F.nullif(epoch, F.lit(0))), "yyyy-MM-dd HH:mm")), F.lit(missing))


def duration_seconds(text: Column) -> Column:
    """Seconds of "7d" (days, either case, alone) or of parts such as 1h30m, 250ms or -1.5s; null for all else."""
    text = F.trim(text)
    days = F.trim(F.substring(text, F.lit(1), F.length(text) - 1))
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*|\.\d+)(ms|us|µs|μs|ns|h|m|s)"), 1).alias("n"), F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*|\.\d+)(ms|us|µs|μs|ns|h|m|s)"), 2).alias("unit"))
    seconds = F.create_map(*[F.lit(v) for pair in (("h", 3600.0), ("m", 60.0), ("s", 1.0), ("ms", 1e-3), ("us", 1e-6), ("µs", 1e-6), ("μs", 1e-6), ("ns", 1e-9)) for v in pair])
    total = F.aggregate(parts, F.lit(0.0), lambda t, p: t + p["n"].cast("double") * F.element_at(seconds, p["unit"]))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    fits = text.rlike(r"^[-+]?(0|((\d+\.?\d*|\.\d+)(ms|us|µs|μs|ns|h|m|s))+)$")
    return F.when(F.lower(text).endswith("d"), days.try_cast("double") * 86400).when(fits, signed)


def file_size(n: Column) -> Column:
    """Base 1024: one decimal, but none for bytes and for values of 100 and more."""
    power = F.when(n <= 0, F.lit(0)).otherwise(F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4))).cast("int")
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    value = n / F.pow(F.lit(1024.0), power)
    whole = (power == 0) | (value >= 100)
    return F.concat(F.when(whole, F.format_string("%.0f", F.floor(value + 0.5).cast("double"))).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)), F.lit(" "), units[power])


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def chunk_counts(offset: Column, size: Column) -> tuple[Column, Column]:
    return F.ceil(offset / CHUNK).cast("bigint"), F.greatest(F.lit(1), F.ceil(size / CHUNK)).cast("bigint")


def three_decimals(v: Column) -> Column:
    return F.format_string("%.3f", v)


def matrix_cell(v: Column) -> Column:
    """Six decimals; exponents from 1000 on and below 1e-4, without leading zeros; what isn't finite as zero."""
    wide = (F.abs(v) >= 1000) | ((v != 0) & (F.abs(v) < 1e-4))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    power = F.regexp_replace(F.format_string("%.6e", v), r"e([+-])0+(\d)", "e$1$2")
    return F.when(~finite, "0.000000").when(wide, power).otherwise(F.format_string("%.6f", v))


def header_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def random_id(digits: int = 24) -> Column:
    """So many random hex digits: 24 for folders, 32 for a whole uuid."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, digits)


def setting(text: Column, low: int, high: int | None, fallback: int) -> Column:
    v = text.try_cast("bigint")
    ok = v >= low if high is None else v.between(low, high)
    return F.when(ok, v).otherwise(F.lit(fallback))


def listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def _cases(value: Column, texts: dict, otherwise) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for k, text in texts.items():
        out = F.when(value == k, text if isinstance(text, Column) else F.lit(text)).otherwise(out)
    return out


def upload_error(code: Column, message: Column, own: Column | None = None) -> Column:
    """What a failed upload tells: some codes by the server's message first, some never; own: the error's own text for all other codes."""
    message = empty_to_null(message)
    texts = {k: F.lit(t) if k in UPLOAD_ERRORS_FIXED else F.coalesce(message, F.lit(t)) for k, t in UPLOAD_ERRORS.items()}
    other = F.lit(UPLOAD_ERROR_ELSE) if own is None else F.coalesce(own, F.lit(UPLOAD_ERROR_ELSE))
    return _cases(code, texts, F.when(code >= 500, F.lit(UPLOAD_ERROR_SERVER)).otherwise(other))


def status_text(status: Column) -> tuple[Column, Column]:
    """(label, tag) of an asset's status."""
    return _cases(status, STATUS_TEXT, STATUS_TEXT_ELSE), _cases(status, STATUS_TAG, STATUS_TAG_ELSE)


def remesh_text(status: Column) -> Column:
    return _cases(status, REMESH_TEXT, REMESH_TEXT_ELSE)


def creation_refusal(length: Column, kind: Column, name: Column, most: int) -> Column:
    """0 if an upload may begin, else 400 (length, type or name) or 413."""
    size, base = length.try_cast("bigint"), F.element_at(F.split(name, "/"), -1)
    named = kind.isin(*TYPE_EXTENSION) & ~base.isin("", ".") & (F.octet_length(base) <= 255) & (F.instr(base, "\0") == 0) & valid_extension(kind, base)
    return F.when(size.isNull() | (size <= 0), 400).when(size > most, 413).when(~F.coalesce(named, F.lit(False)), 400).otherwise(0)


def upload_refusal(status: Column, offset: Column, size: Column, at: Column, n: Column, limit: int) -> Column:
    """0 if a chunk may be appended, else 400 (no offset, or below zero), 409 or 413."""
    return F.when(status != "uploading", 409).when(at.isNull() | (at < 0), 400).when(at != offset, 409).when(size < offset, 409).when(n > F.least(F.lit(limit), size - offset), 413).otherwise(0)


def tile_address(uri: Column, base: Column) -> Column:
    """A tile's address below its tile set's: whole addresses as they are, others in place of what follows the base's last slash."""
    whole = uri.rlike("(?i)^((https?:)?//|blob:|data:)")
    host, folder = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1), F.regexp_extract(base, "^(.*/)", 1)
    return F.when(whole, uri).when(uri.startswith("/"), F.concat(host, uri)).otherwise(F.concat(folder, uri))


def tile_base(base: Column, tileset: Column) -> Column:
    """The folder of tiles, with its slash: the base if there is one, else the tile set's folder."""
    slash = lambda c: F.when(c.endswith("/"), c).otherwise(F.concat(c, F.lit("/")))
    return F.coalesce(slash(empty_to_null(base)), slash(F.regexp_replace(empty_to_null(tileset), "/[^/]*$", "")), F.lit("/"))


def below_base(address: Column, base: Column) -> Column:
    base = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(address.startswith(base), F.substring(address, F.length(base) + 1, F.length(address)))
