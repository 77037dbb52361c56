"""File types from magic bytes and extensions, as Columns and as plain functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordframe.formats.base import RecordFormatError

# What each type begins with, in the order in which they are tried.
# A type is told only from files longer than its group's number of bytes.
MAGIC: tuple[tuple[int, tuple[tuple[bytes, str], ...]], ...] = (
    (8, (
        (b"FCS2.0  ", "facs"),
        (b"FCS3.0  ", "facs"),
        (b"FCS3.1  ", "facs"),
        (b"~VERSION", "las"),
        (b"~Version", "las"),
        (b"\x89PNG\r\n\x1a\n", "png"),
        (b"\x89HDF\r\n\x1a\n", "hdf5"),
        (b"\x04\x03\x02\x01SPAH", "inficon_hapsite"),
        (b"\xaeZTR\r\n\x1a\n", "ztr"),
        (b"\x01\xa1F\x00i\x00n\x00", "thermo_raw"),
        (b"SQLite f", "sqlite"),
    )),
    (4, (
        (b"BAM\x01", "bam"),
        (b"DICM", "dicom"),
        (b"GIF8", "gif"),
        (b"@HD\t", "sam"),
        (b"@SQ\t", "sam"),
        (b"PAR1", "parquet"),
        (b".scf", "scf"),
        (b"\x012\x00\x00", "chemstation_ms"),
        (b"\x02\x02\x00\x00", "masshunter_dad_header"),
        (b"\x0230\x00", "chemstation_mwd"),
        (b"\x03130", "chemstation_mwd"),
        (b"\x0231\x00", "chemstation_dad"),
        (b"\x0281\x00", "chemstation_fid"),
        (b"\x03\x02\x00\x00", "masshunter_dad"),
        (b"\x03131", "chemstation_uv"),
        (b"\x03179", "chemstation_array"),
        (b"\x28\xb5\x2f\xfd", "zstd"),
        (b"Obj\x01", "avro"),
        (b"\xff\xd8\xff\xdb", "jpeg"),
        (b"\xff\xd8\xff\xe0", "jpeg"),
        (b"\xff\xd8\xff\xe1", "jpeg"),
        (b"\xff\xd8\xff\xee", "jpeg"),
        (b"\xff\xff\x05\x00", "thermo_cf"),
        (b"\xff\xff\x06\x00", "thermo_cf"),
    )),
    (1, (
        (b"\x0f\x8b", "gzip"),
        (b"\x1f\x8b", "gzip"),
        (b"BZ", "bzip"),
        (b"\xfd7", "lzma"),
        (b"\x24\x00", "bruker_baf"),
        (b">", "fasta"),
        (b"@", "fastq"),
        (b"\xcd", "netcdf"),
    )),
)
_CF_AT, _CF_MARK, _CF_LONG = 52, "CIsoGC".encode("utf-16-le"), 78

# Types by extension; the first is taken where there are several.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "ami": ("bruker_msms",), "avro": ("avro",), "baf": ("bruker_baf",), "bam": ("bam",),
    "bz": ("bzip",), "bz2": ("bzip",), "bzip": ("bzip",), "cdf": ("netcdf",), "cf": ("thermo_cf",),
    "ch": ("chemstation_array", "chemstation_fid", "chemstation_mwd"), "csv": ("delimited",), "tsv": ("delimited",),
    "dicm": ("dicom",), "dxf": ("thermo_dxf",), "fa": ("fasta",), "faa": ("fasta",), "fasta": ("fasta",), "fna": ("fasta",),
    "faq": ("fastq",), "fastq": ("fastq",), "fq": ("fastq",), "fcs": ("facs",), "lmd": ("facs",), "gif": ("gif",),
    "gz": ("gzip",), "gzip": ("gzip",), "hdf": ("hdf5",), "hps": ("inficon_hapsite",), "idx": ("waters_autospec",),
    "jpg": ("jpeg",), "jpeg": ("jpeg",), "ms": ("chemstation_ms",), "mzxml": ("mzxml",), "png": ("png",), "raw": ("thermo_raw",),
    "sam": ("sam",), "scf": ("scf",), "sd": ("masshunter_dad_header",), "sp": ("masshunter_dad",), "sqlite": ("sqlite",),
    "uv": ("chemstation_dad", "chemstation_uv"), "xz": ("lzma",), "zstd": ("zstd",), "ztr": ("ztr",),
}

#: Parsers by file type; types that are not here have none.
PARSERS = {t: t for t in (
    "bam", "fasta", "fastq", "sam", "png", "chemstation_fid", "chemstation_ms", "chemstation_mwd", "chemstation_dad",
    "chemstation_uv", "chemstation_array", "masshunter_dad", "thermo_cf", "thermo_dxf", "thermo_raw",
)} | {"facs": "flow", "inficon_hapsite": "inficon", "delimited": "tsv"}
#: Other names under which parsers are accepted.
ALIASES = {"inficon_hapsite": "inficon", "facs": "flow"}


def from_magic(data: bytes) -> str:
    """The type of a file by its first bytes; ``unknown:`` and their hexadecimal digits, unpadded, where none fits."""
    for longer, table in MAGIC:
        if len(data) > longer:
            for magic, name in table:
                if data.startswith(magic):
                    if name == "thermo_cf" and not (len(data) >= _CF_LONG and data[_CF_AT : _CF_AT + 12] == _CF_MARK):
                        return "thermo_dxf"
                    return name
    return "unknown:" + "".join(f"{b:x}" for b in data[:8])


def magic_type(content: Column) -> Column:
    """from_magic() over a binary column, in the JVM."""
    size, out = F.length(content), None
    for longer, table in MAGIC:
        for magic, name in table:
            fits = (size > longer) & (F.substring(content, 1, len(magic)) == F.lit(magic))
            kind = F.lit(name)
            if name == "thermo_cf":
                kind = F.when((size >= _CF_LONG) & (F.substring(content, _CF_AT + 1, 12) == F.lit(_CF_MARK)), name).otherwise("thermo_dxf")
            out = F.when(fits, kind) if out is None else out.when(fits, kind)
    pairs = F.regexp_replace(F.regexp_replace(F.lower(F.hex(F.substring(content, 1, 8))), "(..)", "$1 "), r"\b0([0-9a-f]) ", "$1 ")
    return F.when(content.isNotNull(), out.otherwise(F.concat(F.lit("unknown:"), F.replace(pairs, F.lit(" "), F.lit("")))))


def from_extension(name: str) -> tuple[str, ...]:
    return EXTENSIONS.get(name.rsplit(".", 1)[-1] if "." in name else name, ("unknown",))


def extension_types(path: Column) -> Column:
    """The types that a file's extension stands for, as an array."""
    found = F.regexp_extract(path, r"([^./]*)$", 1)
    table = F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[0]), F.array(*map(F.lit, kv[1]))], EXTENSIONS.items(), []))
    return F.coalesce(F.try_element_at(table, found), F.array(F.lit("unknown")))


def parser_name(file_type: str, hint: str | None = None) -> str:
    """The parser for a type; a hint always wins."""
    if hint:
        return ALIASES.get(hint, hint)
    if file_type == "masshunter_dad_header":
        raise RecordFormatError("Reading the .sd file is not supported; use the .sp file beside it")
    if file_type.startswith("unknown"):
        raise RecordFormatError(f"File has an unknown type #{file_type.partition(':')[2]}#")
    if file_type not in PARSERS:
        raise RecordFormatError(f"File type {file_type} has no parser")
    return PARSERS[file_type]


def parser_names(file_type: Column) -> Column:
    """parser_name() without a hint over a column; null where there is none."""
    table = F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[0]), F.lit(kv[1])], PARSERS.items(), []))
    return F.try_element_at(table, file_type)
