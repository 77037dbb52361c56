"""The detection and scalar functions for SQL: temporary functions whose bodies are expressions, so they are inlined in plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from recordframe.sources import detect


def magic_sql(content: str) -> str:
    """detect.magic_type() as SQL text."""
    whens = []
    for longer, table in detect.MAGIC:
        for magic, name in table:
            fits = f"length({content}) > {longer} AND substring({content}, 1, {len(magic)}) = X'{magic.hex()}'"
            if name == "thermo_cf":
                mark = f"length({content}) >= {detect._CF_LONG} AND substring({content}, {detect._CF_AT + 1}, 12) = X'{detect._CF_MARK.hex()}'"
                whens.append(f"WHEN {fits} THEN CASE WHEN {mark} THEN 'thermo_cf' ELSE 'thermo_dxf' END")
            else:
                whens.append(f"WHEN {fits} THEN '{name}'")
    digits = f"regexp_replace(lower(hex(substring({content}, 1, 8))), '(..)', '$1 ')"
    return f"CASE WHEN {content} IS NULL THEN NULL {' '.join(whens)} ELSE concat('unknown:', replace(regexp_replace({digits}, r'\\b0([0-9a-f]) ', '$1 '), ' ', '')) END"


def _extension_sql(path: str) -> str:
    pairs = ", ".join(f"'{e}', array({', '.join(repr(t) for t in types)})" for e, types in detect.EXTENSIONS.items())
    return f"coalesce(try_element_at(map({pairs}), regexp_extract({path}, r'([^./]*)$', 1)), array('unknown'))"


def _parser_sql(kind: str) -> str:
    return f"try_element_at(map({', '.join(f'{k!r}, {v!r}' for k, v in detect.PARSERS.items())}), {kind})"


def _count(s: str, letters: str) -> str:
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


def register_functions(spark: SparkSession) -> list[str]:
    """record_type, extension_types, record_parser, gc_content, mean_quality, zero_based, packed_intensity, signal_of."""
    u = "upper(sequence)"
    strong, weak, half = (_count(u, x) for x in ("GCS", "ATUW", "RYKM"))
    functions = {
        "record_type(content BINARY) RETURNS STRING": magic_sql("content"),
        "extension_types(path STRING) RETURNS ARRAY<STRING>": _extension_sql("path"),
        "record_parser(file_type STRING) RETURNS STRING": _parser_sql("file_type"),
        "gc_content(sequence STRING) RETURNS DOUBLE": f"CAST(try_divide({strong} + {half} * 0.5D, {strong} + {weak} + {half}) AS DOUBLE)",
        "mean_quality(quality STRING) RETURNS DOUBLE": "try_divide(aggregate(transform(split(quality, ''), c -> CAST(ascii(c) AS BIGINT)), 0L, (a, x) -> a + x), length(quality))",
        "zero_based(pos BIGINT) RETURNS BIGINT": "nullif(pos, 0) - 1",
        "packed_intensity(v BIGINT) RETURNS DOUBLE": "CAST(v & 16383 AS DOUBLE) * power(8D, shiftright(v, 14))",
        "signal_of(name STRING) RETURNS DOUBLE": "coalesce(try_cast(regexp_extract(name, 'Sig=([^,]*)', 1) AS DOUBLE), 0D)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in functions]
