"""Column expressions for paths, sizes and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device stems that a path component may not have (fixed values).
DEVICES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def group_key(path: Column) -> Column:
    """The lower-cased extension if it has 1 to 16 bytes and no slash, else empty."""
    ext = F.lower(F.substring_index(path, ".", -1))
    good = (F.instr(path, ".") > 0) & F.octet_length(ext).between(1, 16) & (F.instr(ext, "/") == 0)
    return F.when(good, ext).otherwise("")


def collision_key(path: Column) -> Column:
    return F.lower(path)


def normalize_selector(sel: Column) -> Column:
    return F.regexp_replace(F.translate(sel, "\\", "/"), "/+$", "")


def ancestors(path: Column) -> Column:
    """All folders above a path, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def component_ok(part: Column) -> Column:
    stem = F.lower(F.substring_index(part, ".", 1))
    return (
        (part != "") & (part != ".") & (part != "..")
        & ~part.rlike(r"[\\:<>\"|?*\x00-\x1f]") & ~part.rlike(r"[ .]$") & ~stem.isin(*DEVICES)
    )


def path_ok(path: Column) -> Column:
    return F.forall(F.split(path, "/"), component_ok)


def normalize_rel(path: Column) -> Column:
    """Backslashes become slashes and single dots go; null where a component is refused or nothing is left."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != ".")
    return F.when((F.size(parts) > 0) & F.forall(parts, component_ok), F.array_join(parts, "/"))


def human(n: Column) -> Column:
    """1024 steps, one decimal, whole bytes."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, name in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n.cast("double") / float(1024**power), 1)), F.lit(f" {name}"))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    number = F.regexp_extract(F.trim(text), r"^(\d+)\s*([KkMmGg]?)$", 1)
    unit = F.upper(F.regexp_extract(F.trim(text), r"^(\d+)\s*([KkMmGg]?)$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)


def codec_name(codec: Column) -> Column:
    from .. import model

    out = F.lit("unknown")
    for i, name in model.CODECS.items():
        out = F.when(codec == i, name).otherwise(out)
    return out


#: First bytes, in hexadecimal digits, and the kinds of files they tell (fixed values).
MAGIC = (
    ("504B0304", "zip"), ("377ABCAF271C", "7z"), ("526172211A0700", "rar"), ("526172211A070100", "rar"), ("89504E470D0A1A0A", "png"),
    ("1F8B", "gzip"), ("25504446", "pdf"), ("FFD8FF", "jpeg"), ("494433", "mp3"), ("4D5A", "executable"), ("7F454C46", "executable"),
    ("CFFAEDFE", "executable"), ("28B52FFD", "zstd"), ("FD377A585A00", "xz"),
)


def sniff(head: Column) -> Column:
    """The kind of a file from its first bytes."""
    h = F.hex(F.substring(head, 1, 16))
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav")
    for digits, kind in MAGIC:
        out = out.when(h.startswith(digits), kind)
    return out.otherwise("other")


def stored_bytes(packed: Column, unpacked: Column, length: Column) -> Column:
    """An extent's share of its unit's packed bytes, rounded down."""
    part = (packed * length - F.pmod(packed * length, F.greatest(unpacked, F.lit(1)))) / F.greatest(unpacked, F.lit(1))
    return F.when((unpacked == 0) | (length >= unpacked), packed).otherwise(part).cast("long")


def spread_sample(data: Column, size: Column, runs: int = 8, share: int = 16) -> Column:
    """`runs` runs, one sixteenth of the data in all, at even steps."""
    run = F.floor(size / (share * runs)).cast("int")
    step = F.floor(size / runs).cast("int")
    return F.concat(*[F.substring(data, step * i + 1, run) for i in range(runs)])


#: Kinds of files by extension (fixed values).
KINDS = {
    "image": "jpg jpeg png gif bmp webp heic avif tif tiff svg dds tga",
    "audio": "mp3 flac wav ogg m4a aac opus mid",
    "video": "mp4 mkv avi mov webm wmv m4v",
    "archive": "zip 7z rar gz xz bz2 zst nva tar cab iso",
    "exe": "exe dll so dylib msi sys bin elf",
    "doc": "pdf doc docx odt rtf txt md log",
    "code": "rs c h hpp cpp py js ts tsx java go cs rb php json toml yaml yml xml html css sh ps1 bat",
}


def icon_kind(path: Column) -> Column:
    """The kind of a file by what follows its last dot; all of a path without one."""
    ext, out = F.lower(F.substring_index(path, ".", -1)), F
    for kind, names in KINDS.items():
        out = out.when(ext.isin(*names.split()), kind)
    return F.when(path.isNotNull(), out.otherwise("generic"))


def parent_of(path: Column) -> Column:
    """What stands before the last slash of either kind; a path without one, or with one at its start only, stays."""
    return F.regexp_replace(path, r"(?s)^(.+)[/\\\\][^/\\\\]*$", "$1")


def strip_ext(path: Column) -> Column:
    """A path without its extension: the last dot of the last part and what follows."""
    return F.regexp_replace(path, r"(?s)\.[^./\\\\]*$", "")


def when_text(seconds: Column) -> Column:
    """A time in the session's zone as day.month.year hour:minute; a dash for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "\u2014").otherwise(F.date_format(F.timestamp_seconds(seconds), "dd.MM.yyyy HH:mm"))


def hhmmss(seconds: Column) -> Column:
    """A duration in its two largest units (labels are fixed values)."""
    s = F.greatest(F.lit(0), F.floor(seconds + F.lit(0.5))).cast("long")
    minutes, two = F.floor(s / 60), lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" \u0441")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" \u043c\u0438\u043d "), two(s % 60), F.lit(" \u0441")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" \u0447 "), two(minutes % 60), F.lit(" \u043c\u0438\u043d")))
    )
