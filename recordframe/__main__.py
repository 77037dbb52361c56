"""python -m recordframe -i FILE [-p PARSER] [-m] [-o OUT]: records, or metadata, as tab-separated text."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from recordframe.formats.base import RecordFormatError
from recordframe.sources.reader import decode
from recordframe.sources.sink import plain


def text(v) -> str:
    if isinstance(v, (list, tuple)):
        return ",".join(map(text, v))
    if isinstance(v, str):
        return f'"{v}"' if "\t" in v else v
    return v.isoformat() if isinstance(v, dt.datetime) else plain(v)


def main(argv: list[str] | None = None, stdin=None, stdout=None) -> int:
    a = argparse.ArgumentParser("recordframe", description=__doc__)
    a.add_argument("-i", "--input")
    a.add_argument("-o", "--output")
    a.add_argument("-p", "--parser")
    a.add_argument("-m", "--metadata", action="store_true")
    o = a.parse_args(argv)
    out = open(o.output, "w") if o.output else stdout or sys.stdout  # noqa: SIM115
    try:
        if o.input:
            from recordframe.api import Reader

            r = Reader(filename=o.input, parser=o.parser)
            found = r._found
        else:
            found, _ = decode((stdin or sys.stdin.buffer).read(), o.parser)
        if o.metadata:
            out.write("key\tvalue\n")
            out.writelines(f"{k}\t{text(v)}\n" for k, v in sorted(found.metadata.items()))
        else:
            out.write("\t".join(map(text, found.columns)) + "\n")
            columns = [c.to_pylist() for c in found.columns.values()]
            out.writelines("\t".join(map(text, row)) + "\n" for row in zip(*columns))
    except (RecordFormatError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        if o.output:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
