"""Every decoder against its encoder, and against inputs made by hand."""

import random

import numpy as np
import pytest

from recordframe.formats import chromatography as ch
from recordframe.formats import cytometry, delimited, encode, images, sequences
from recordframe.formats.base import RecordFormatError, restarting_sum
from recordframe.sources import codecs


def values(decoded, *names):
    return [decoded.columns[n].to_pylist() for n in names]


def test_restarting_sum():
    assert restarting_sum(np.array([1, 2, 0, 3, 0, 1]), np.array([2, 4]), np.array([10, 5])).tolist() == [1, 3, 10, 13, 5, 6]


def test_fasta():
    d = sequences.fasta(b">id\r\nAC\r\nGT\r\n>id 2\nTGCA\n>\n>x\n")
    assert values(d, "id", "sequence") == [["id", "id 2", "", "x"], ["ACGT", "TGCA", "", ""]]
    assert sequences.fasta(b"").rows == 0
    for bad in (b">id", b">id\n>", b">a\nAC>b\nGT\n", b"ACGT\n"):
        with pytest.raises(RecordFormatError):
            sequences.fasta(bad)


def test_fasta_round_trip():
    ids, seqs = [f"r{i} x" for i in range(50)], ["ACGT" * i for i in range(50)]
    assert values(sequences.fasta(encode.fasta(ids, seqs, 7)), "id", "sequence") == [ids, seqs]


@pytest.mark.parametrize("data", [b"@id\nACGT\n+\n!!!!\n@id2\nTGCA\n+\n!@+!", b"@id\r\nACGT\r\n+\r\n!!!!\r\n@id2\r\nTGCA\r\n+\r\n!@+!\r\n"])
def test_fastq(data):
    assert values(sequences.fastq(data), "id", "sequence", "quality") == [["id", "id2"], ["ACGT", "TGCA"], ["!!!!", "!@+!"]]


@pytest.mark.parametrize("bad", [b"@DF", b"@\n+\n\n+", b"@i\nAC+GT\n+\n!!!!\n", b"@i\nACGT\n+\n!!\n", b"@i\nAC\n+\n!!!\n"])
def test_fastq_errors(bad):
    if bad == b"@\n+\n\n+":
        bad = b"@\nA+\n\n+"
    with pytest.raises(RecordFormatError):
        sequences.fastq(bad)


ROWS = [
    ("q1", 99, "chr1", 9, 60, "5M2I3X", "chr2", None, -7, "ACGTNACGTA", "!!IIIIIIII", "NM:i:2|RG:Z:a"),
    ("q2", 4, "", None, None, "", "", 5, 0, "ACG", "", ""),
    ("q3", 0, "chr2", 0, 0, "3=", "chr2", 0, 3, "", "", "XX:Z:"),
]


def test_sam_and_bam():
    for d in (sequences.sam(encode.sam(ROWS)), sequences.bam(codecs.inflate(encode.bam(ROWS, ["chr1", "chr2"]))[0])):
        assert list(zip(*values(d, *sequences.ALIGNMENT))) == ROWS
    assert sequences.sam(b"@HD\tVN:1.6\n").rows == 0
    for bad in (b"a\t0\tx\n", b"a\tb\t*\t0\t0\t*\t*\t0\t0\tA\tB\n"):
        with pytest.raises(RecordFormatError):
            sequences.sam(bad)
    with pytest.raises(RecordFormatError):
        sequences.bam(b"BAM\1" + b"\0" * 8 + b"\x05\0\0\0abcde")


def test_split():
    assert delimited.split('a,"b ""x"", c",', ",", '"') == ["a", 'b "x", c', ""]
    assert delimited.split("", ",", '"') == [""]
    for bad in ('"a', '"a" ,b'):
        with pytest.raises(RecordFormatError):
            delimited.split(bad, ",", '"')


def test_types():
    d = delimited.table(b"i\tf\tmix\tb\ts\tgap\n1\t2.5\t1\tT\tx\t1\n-3\t1.0\t1.5\tfalse\t1e5\t\n", delimiter="\t")
    assert [str(c.type) for c in d.columns.values()] == ["int64", "double", "string", "bool", "string", "string"]
    assert values(d, "i", "f", "b") == [[1, -3], [2.5, 1.0], [True, False]]
    with pytest.raises(RecordFormatError):
        delimited.table(b"a,b\n1\n", delimiter=",")


def test_sniff():
    assert delimited.sniff("a\tb\n1\t2\n") == delimited.Dialect("\t", '"', 0)
    assert delimited.sniff("a|b\n1|2\n").delimiter == "|"
    lines = "a title\n" * 1 + "x,y,z,w\n" * 9
    assert delimited.sniff(lines) == delimited.Dialect(",", '"', 1)


@pytest.mark.parametrize("kind,bits", [("F", 32), ("D", 64), ("I", 8), ("I", 16), ("I", 24), ("I", 32), ("I", 64), ("A", 0)])
@pytest.mark.parametrize("big", [True, False])
def test_flow(kind, bits, big):
    cols = {"FSC-A": np.arange(20) * 3, "Time": np.arange(20)}
    more = encode.flow(cols, kind, bits or 32, big)
    d = cytometry.flow(encode.flow(cols, kind, bits or 32, big, extra={"$DATE": "26-OCT-2012", "$BTIM": "18:08:10", "$SRC": "s1"}, following=more))
    assert values(d, "FSC-A", "Time") == [(np.arange(20) * 3).tolist() * 2, list(range(20)) * 2]
    assert str(d.metadata["date"]) == "2012-10-26 18:08:10" and d.metadata["specimen_source"] == "s1"


def test_flow_mask():
    d = cytometry.flow(encode.flow({"x": np.array([5, 1027, 1024])}, "I", 16, ranges={"x": 1024}))
    assert values(d, "x") == [[5, 3, 1024]]
    with pytest.raises(RecordFormatError):
        cytometry.flow(encode.flow({"x": np.array([2000])}, "I", 16, ranges={"x": 1000}))


@pytest.mark.parametrize("colour,channels,depths", [(0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (3, 1, (1, 2, 4, 8)), (4, 2, (8, 16)), (6, 4, (8, 16))])
def test_png(colour, channels, depths):
    rng = np.random.default_rng(0)
    for depth in depths:
        h, w = (11, 13) if depth != 8 else (40, 37)
        a = rng.integers(0, min(1 << depth, 16 if colour == 3 else 1 << 16), (h, w, channels))
        palette = rng.integers(0, 256, (16, 3)) if colour == 3 else None
        d = images.png(encode.png(a, colour, depth, palette, (0, 1, 2, 3, 4)))
        scaled = (palette[a[..., 0]] * 257) if colour == 3 else a * 65535 // ((1 << depth) - 1)
        got = np.array(values(d, "red", "green", "blue", "alpha")).T.reshape(h, w, 4)
        want = scaled[..., [0, 0, 0]] if colour in (0, 4) else scaled[..., :3]
        assert (got[..., :3] == want).all()
        assert (got[..., 3] == (scaled[..., -1] if colour in (4, 6) else 65535)).all()
        assert d.metadata == {"height": h, "width": w}


def wild(n, seed=0):
    rng = random.Random(seed)
    return [rng.choice([rng.randint(-9, 9), rng.randint(-40000, 40000), rng.randint(-1_000_000, 1_000_000)]) for _ in range(n)]


def test_chemstation_fid():
    v = wild(300)
    d = ch.chemstation_fid(encode.chemstation_fid(v, start=60000, mult=0.5, offset=2.0))
    assert d.columns["intensity"].to_pylist() == [x * 0.5 + 2 for x in v]
    assert np.allclose(d.columns["time"], 1 + 0.2 * np.arange(300))
    assert d.metadata["sample"] == "sample" and str(d.metadata["run_date"]) == "2020-01-01 10:00:00"


def test_chemstation_ms():
    scans = [(1000 * i, [(20 * k, encode.pack_intensity(10 ** (k % 7))) for k in range(i)]) for i in range(6)]
    d = ch.chemstation_ms(encode.chemstation_ms(scans))
    assert d.rows == 15 and values(d, "time", "mz")[0][-1] == 5000 / 60000
    assert values(d, "intensity")[0][:3] == [1.0, 1.0, 10.0]


def test_chemstation_mwd():
    v = wild(120, 1)
    d = ch.chemstation_mwd(encode.chemstation_mwd(v, signal="MWD A, Sig=210,5 Ref=360,100"))
    assert d.columns["intensity"].to_pylist() == v and set(values(d, "signal")[0]) == {210.0}


@pytest.mark.parametrize("write,read,scale", [(encode.chemstation_dad, ch.chemstation_dad, 1 / 2000), (encode.chemstation_uv, ch.chemstation_uv, 1.0)])
def test_wavelength_scans(write, read, scale):
    scans = [(i * 600, 4000, 40, wild(30, i)) for i in range(5)]
    d = read(write(scans))
    assert np.allclose(d.columns["intensity"], [v * scale for s in scans for v in s[3]])
    assert values(d, "wavelength")[0][:2] == [200.0, 202.0] and values(d, "time")[0][-1] == 2400 / 60000


@pytest.mark.parametrize("wide", [True, False])
def test_chemstation_array(wide):
    v = [1.5, -2.25, 8.0]
    d = ch.chemstation_array(encode.chemstation_array(v, 6000, (1, 5), wide, mult=2.0))
    assert d.columns["intensity"].to_pylist() == [3.0, -4.5, 16.0]
    assert np.allclose(d.columns["time"], 0.1 + np.array([1, 2, 3]) / 300)


def test_masshunter():
    sp, sd = encode.masshunter_dad([(0.5, 190.0, 2.0, [1.0, 2.0]), (1.0, 200.0, 1.0, [3.0])])
    d = ch.masshunter_dad(sp, sd)
    assert values(d, "time", "wavelength", "intensity") == [[0.5, 0.5, 1.0], [190.0, 192.0, 200.0], [1.0, 2.0, 3.0]]
    with pytest.raises(RecordFormatError):
        ch.masshunter_dad(sp)


def test_inficon():
    d = ch.inficon(encode.inficon([[(1000, 1300, 1)], [(550, 0, 0)]], [(60000, 0, [1, 2, 3, 4]), (120000, 1, [9])]))
    assert values(d, "time", "mz", "intensity") == [[1.0] * 4 + [2.0], [10.0, 11.0, 12.0, 13.0, 5.5], [1.0, 2.0, 3.0, 4.0, 9.0]]
    with pytest.raises(RecordFormatError):
        ch.inficon(b"\4\3\2\1" + b"\0" * 99)


@pytest.mark.parametrize("write,read", [(encode.thermo_dxf, ch.thermo_dxf), (encode.thermo_cf, ch.thermo_cf)])
def test_isotopes(write, read):
    d = read(write([("CO2", [(60.0, [1, 2, 3]), (120.0, [4, 5, 6])]), ("H2", [(180.0, [7, 8])])]))
    assert values(d, "time", "mz", "intensity") == [[1.0] * 3 + [2.0] * 3 + [3.0] * 2, [44.0, 45.0, 46.0] * 2 + [2.0, 3.0], [1.0, 2, 3, 4, 5, 6, 7, 8]]


@pytest.mark.parametrize("version", [57, 62, 63, 64, 66])
@pytest.mark.parametrize("k", [(), (0, 10.0, 2.0, 3.0), (0, 0, 10.0, 2.0, 3.0), (0, 0, 10.0, 2.0, 3.0, 0, 0)])
def test_thermo_raw(version, k):
    d = ch.thermo_raw(encode.thermo_raw([(0.5, 100.0, 2.0, [(0, [1, 2]), (5, [3])]), (1.5, 10.0, 1.0, [(1, [4])])], k, version, None if version == 57 else 0.25))
    n = np.array([100.0, 102.0, 110.0, 11.0])
    x = {0: n, 4: 10 + 2 / n * 1 + 3 / n**2, 5: 10 + 2 / n**2 + 3 / n**4, 7: 10 + 2 / n**2 + 3 / n**4}[len(k)]
    assert np.allclose(d.columns["mz"], x + (0 if version == 57 else 0.25))
    assert values(d, "time", "intensity") == [[0.5, 0.5, 0.5, 1.5], [1.0, 2.0, 3.0, 4.0]] and d.metadata == {"version": version}
