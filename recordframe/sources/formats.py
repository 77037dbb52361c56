"""The registry of parsers: name, schema, decoder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from recordframe.formats import chromatography as ch
from recordframe.formats import cytometry, delimited, images, sequences
from recordframe.formats.base import Decoded


def _schema(**columns: str) -> T.StructType:
    kinds = {"L": T.LongType(), "D": T.DoubleType(), "S": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


@dataclass(frozen=True)
class Format:
    """schema is None where the file's head has the columns."""

    name: str
    decode: Callable[..., Decoded]
    schema: T.StructType | None
    options: tuple[str, ...] = ()


_ALIGNMENT = _schema(**{n: "L" if n in ("flag", "pos", "mapq", "pnext", "tlen") else "S" for n in sequences.ALIGNMENT})
_TIMED = _schema(time="D", intensity="D")
_MASSES = _schema(time="D", mz="D", intensity="D")
_WAVES = _schema(time="D", wavelength="D", intensity="D")
_TEXT = ("delimiter", "quote", "skip_lines", "infer_types")

_FORMATS: dict[str, Format] = {}


def register_format(name: str, decode: Callable[..., Decoded], schema: T.StructType | None = None, options: tuple[str, ...] = ()) -> None:
    """Add a parser, or replace one; decode takes the bytes of a file and gives its columns."""
    _FORMATS[name] = Format(name, decode, schema, options)


def get_format(name: str) -> Format:
    if name not in _FORMATS:
        raise ValueError(f"No parser available for the parser {name}")
    return _FORMATS[name]


def names() -> list[str]:
    return sorted(_FORMATS)


def _csv(data: bytes, **options) -> Decoded:
    return delimited.table(data, **{"delimiter": ",", **options})


def _tsv(data: bytes, **options) -> Decoded:
    return delimited.table(data, **{"delimiter": "\t", **options})


register_format("fasta", sequences.fasta, _schema(id="S", sequence="S"))
register_format("fastq", sequences.fastq, _schema(id="S", sequence="S", quality="S"))
register_format("sam", sequences.sam, _ALIGNMENT)
register_format("bam", sequences.bam, _ALIGNMENT)
register_format("csv", _csv, None, _TEXT)
register_format("tsv", _tsv, None, _TEXT)
register_format("flow", cytometry.flow)
register_format("png", images.png, _schema(x="L", y="L", red="L", green="L", blue="L", alpha="L"))
register_format("chemstation_fid", ch.chemstation_fid, _TIMED)
register_format("chemstation_ms", ch.chemstation_ms, _MASSES)
register_format("chemstation_mwd", ch.chemstation_mwd, _schema(time="D", signal="D", intensity="D"))
register_format("chemstation_dad", ch.chemstation_dad, _WAVES)
register_format("chemstation_uv", ch.chemstation_uv, _WAVES)
register_format("chemstation_array", ch.chemstation_array, _TIMED)
register_format("masshunter_dad", ch.masshunter_dad, _WAVES)
register_format("inficon", ch.inficon, _MASSES)
register_format("thermo_cf", ch.thermo_cf, _MASSES)
register_format("thermo_dxf", ch.thermo_dxf, _MASSES)
register_format("thermo_raw", ch.thermo_raw, _MASSES)
