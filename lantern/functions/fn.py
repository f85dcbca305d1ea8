"""Column expressions over file catalogs. All are native; only NFKC in normalise_tag may need an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to (high type, low type), by high type.
TYPES = {
    "image": {x: x for x in "jpg png gif bmp heic heif webp svg tiff nef".split()} | {"jpeg": "jpg", "tif": "tiff"},
    "video": {x: x for x in "mp4 avi mov mkv wmv flv webm mpeg".split()} | {"mpg": "mpeg"},
    "audio": {x: x for x in "mp3 flac wav aac ogg wma m4a aiff midi alac caf ra ac3 dts au snd".split()} | {"aif": "aiff", "mid": "midi", "ram": "ra"},
    "document": {x: x for x in "pdf doc docx xls xlsx ppt pptx odt ods".split()},
    "text": {x: x for x in "txt md csv json xml html css js py log".split()},
    "compressed": {x: x for x in "zip gz bz2 xz tar 7z rar tgz zst lz4 cab iso dmg".split()},
    "font": {x: x for x in "ttf otf woff woff2 eot".split()},
}
KNOWN_TYPES = tuple(TYPES)
EXTENSIONS = {ext: (high, low) for high, own in TYPES.items() for ext, low in own.items()}
KIB = 1024
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: Up to this size a partial hash covers the whole file.
SMALL = 128 * KIB


def extension(name: Column) -> Column:
    """The lower-cased part after the last dot; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def classify_high(name: Column) -> Column:
    found = F.try_element_at(_literal_map({e: h for e, (h, _) in EXTENSIONS.items()}), extension(name))
    return F.coalesce(found, F.when(name.startswith("."), "text").otherwise("other"))


def classify_low(name: Column) -> Column:
    ext = extension(name)
    found = F.try_element_at(_literal_map({e: low for e, (_, low) in EXTENSIONS.items()}), ext)
    return F.coalesce(found, F.when(name.startswith("."), "dotfile").when(ext == "", "unknown").otherwise(ext))


def classify(name: Column) -> Column:
    """struct<high, low>: the file's type by its extension; an unknown extension with a leading dot is a dotfile."""
    return F.struct(classify_high(name).alias("high"), classify_low(name).alias("low"))


def format_size(size: Column) -> Column:
    """1023 B, 1.0 KB, ... PB. Exact binary ties round half up."""
    out = F.format_string("%.1f PB", size / float(KIB**5))
    for i in range(4, 0, -1):
        out = F.when(size < KIB ** (i + 1), F.format_string(f"%.1f {UNITS[i]}", size / float(KIB**i))).otherwise(out)
    return F.when(size < KIB, F.format_string("%d B", size)).otherwise(out)


SIZE = r"^([0-9.]+)\s*(B|KB|MB|GB|TB)?$"


def size_of(text: str | float | None) -> int | None:
    """parse_size of one text, for bounds that a plan is made with."""
    t = str("" if text is None else text).strip().upper()
    m = re.fullmatch(SIZE, t)
    try:
        return int(float(m[1]) * KIB ** UNITS.index(m[2] or "B")) if m else int(float(t))
    except (ValueError, OverflowError):
        return None


def parse_size(text: Column) -> Column:
    """Bytes of "1.5 GB"-like text, truncated; a plain number is bytes; else null."""
    t = F.upper(F.btrim(text))
    number = F.regexp_extract(t, SIZE, 1).try_cast("double")
    unit = F.regexp_extract(t, SIZE, 2)
    factor = F.lit(1.0)
    for i in range(1, 5):
        factor = F.when(unit == UNITS[i], float(KIB**i)).otherwise(factor)
    return F.floor(F.coalesce(number * factor, t.try_cast("double"))).cast("long")


def utf8_safe(data: Column) -> Column:
    """Text of bytes; invalid ones become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def norm_inode(inode: Column) -> Column:
    """An unsigned 64-bit number (decimal) as a signed long: order within each half and distinctness stay."""
    x = inode.cast("decimal(20,0)")
    half, whole = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.when(x >= half, (x - whole).cast("long")).otherwise(F.when(x < half, x).cast("long"))


def normalise_tag(tag: Column, nfkc: bool = False) -> Column:
    """Comma to space, white space collapsed and trimmed, lower case. nfkc adds Unicode compatibility folding."""
    if nfkc:
        tag = _nfkc()(tag)
    return F.lower(F.btrim(F.regexp_replace(F.replace(tag, F.lit(","), F.lit(" ")), r"\s+", " ")))


def _nfkc():
    import unicodedata

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return fold


def _nfkc_parts():
    import unicodedata

    fold = lambda part: unicodedata.normalize("NFKC", part).replace(",", " ")  # noqa: E731  a comma that folding makes parts nothing

    @F.pandas_udf("string")
    def fold_all(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else s if s.isascii() else ",".join(map(fold, s.split(","))))

    return fold_all


def parse_tags(text: Column, nfkc: bool = False) -> Column:
    """Tags of a comma list: normalised, empty ones dropped, first of equals kept, in order. Null gives no tags. nfkc folds each tag as normalise_tag does."""
    if nfkc:
        text = _nfkc_parts()(text)
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: normalise_tag(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def parse_mtime(text: Column) -> Column:
    """Epoch seconds of a number or of an ISO time (UTC session zone); else null."""
    t = F.btrim(text)
    return F.coalesce(t.try_cast("double"), F.unix_timestamp(F.try_to_timestamp(t)).cast("double"))


def node_id(kind: str, own: Column) -> Column:
    return F.concat(F.lit({"location": "loc-", "folder": "fld-"}[kind]), own.cast("string"))


def parse_node_id(node: Column) -> Column:
    """struct<kind, id>; both null for other text."""
    prefix = F.regexp_extract(node, r"^(loc|fld)-[0-9]+$", 1)
    kind = F.when(prefix == "loc", "location").when(prefix == "fld", "folder")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.regexp_extract(node, "([0-9]+)$", 1)).try_cast("long").alias("id"))


def escape_like(value: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", value)


def name_matches(name: Column, value: str, mode: str = "anywhere") -> Column:
    """wildcard (* and ?), exact (case counts), starts, ends, or anywhere (case does not)."""
    if mode == "exact":
        return name == value
    v = escape_like(value)
    return name.ilike({"wildcard": v.replace("*", "%").replace("?", "_"), "starts": f"{v}%", "ends": f"%{v}"}.get(mode, f"%{v}%"))


def hidden_own(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1).startswith(".")


def hidden_inherited(rel_path: Column) -> Column:
    """Some segment of the path starts with a dot."""
    return rel_path.rlike(r"(^|/)\.")


def basename(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def dirname(rel_path: Column) -> Column:
    return F.when(F.contains(rel_path, F.lit("/")), F.regexp_replace(rel_path, "/[^/]*$", "")).otherwise("")


def depth(rel_path: Column) -> Column:
    return F.when(rel_path == "", 0).otherwise(F.size(F.split(rel_path, "/")))


def file_stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_ext(name: Column) -> Column:
    """The last extension with its dot, or nothing."""
    return F.substring(name, F.length(file_stem(name)) + 1, F.length(name))


def path_parts(rel_path: Column) -> Column:
    name = basename(rel_path)
    return F.struct(name.alias("basename"), dirname(rel_path).alias("dirname"), file_stem(name).alias("stem"), file_ext(name).alias("ext"), depth(rel_path).alias("depth"))


def ancestors(rel_dir: Column) -> Column:
    """A directory and its ancestors, from the top; none for the root ''."""
    parts = F.split(rel_dir, "/")
    return F.when(rel_dir == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def effective_hash(strong: Column, fast: Column) -> Column:
    return F.coalesce(F.nullif(strong, F.lit("")), F.nullif(fast, F.lit("")))


def effective(strong: Column, fast: Column) -> Column:
    """struct<hash, column>: the strong hash if present, else the fast one, and which it is."""
    kind = F.when(F.nullif(strong, F.lit("")).isNotNull(), "hash_strong").when(F.nullif(fast, F.lit("")).isNotNull(), "hash_fast")
    return F.struct(effective_hash(strong, fast).alias("hash"), kind.alias("column"))


def hash_kind(h: Column) -> Column:
    return F.when(F.length(h) == 64, "strong").when(F.length(h) == 16, "fast")


def location_label(location: Column, agent: Column) -> Column:
    return F.when(agent.isNotNull() & (agent != ""), F.concat(location, F.lit(" ["), agent, F.lit("]"))).otherwise(location)


def stub_text(filename: Column, dest_path: Column, dest_label: Column, date: Column, banner: str = "Consolidated") -> Column:
    """The four lines of a stub that stands for a moved file. The first is the caller's banner."""
    target = F.when(dest_label.isNotNull() & (dest_label != ""), F.concat(dest_label, F.lit(": "), dest_path)).otherwise(dest_path)
    return F.concat(F.lit(f"{banner}\nOriginal: "), filename, F.lit("\nMoved to: "), target, F.lit("\nDate: "), date, F.lit("\n"))


def sources_text(location: Column, rel_path: Column) -> Column:
    return F.concat(F.lit("- "), location, F.lit(": "), rel_path, F.lit("\n"))


def suffix_name(name: Column, n: Column, style: str = "underscore") -> Column:
    """base_n.ext, or base (n).ext."""
    mark = F.concat(F.lit("_"), n.cast("string")) if style == "underscore" else F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    return F.concat(file_stem(name), mark, file_ext(name))


def type_counts_json(counts: Column) -> Column:
    """JSON text of a map, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts))))


def parse_type_counts(text: Column) -> Column:
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("{}")), "map<string,bigint>")


def spread_key(key: Column, row: Column) -> Column:
    """The key of a left join whose null keys match nothing: nulls are dealt by row, so that no task gets them all."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), row.cast("string")))
