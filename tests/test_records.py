"""Molecules, meshes and matrices in text files: literal files, tiny splits, round trips."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomgraph.core.session import local_session  # noqa: E402
from loomgraph.sources import records as R  # noqa: E402
from loomgraph.sources import text as S  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WATER = "\n  made\n\n  3  2  0\n    0.0000    0.0000    0.1173 O   0  0\n    0.0000    0.7572   -0.4692 H   0  0\n    0.0000   -0.7572   -0.4692 H   0  0\n  1  2  1  0\n  1  3  1  0\nM  END\n"
OTHER = "sulphur\n\n\n2 2 0\n1.5 2 3 S\n4 5 6 C\n1 2 2\n2 1 1\nM  END\n> <note>\n$5\n\n"


@pytest.mark.parametrize("ends", ["$$$$\n", ""])
def test_sdf(spark, tmp_path, tiny_splits, ends):
    (tmp_path / "m.sdf").write_text(WATER + "$$$$\n" + OTHER + ends)
    nodes, edges = R.read_sdf(spark, str(tmp_path / "m.sdf"))
    got = [(r.graph_id, r.id, r.pos, [int(v) for v in r.x], r.title) for r in nodes.orderBy("graph_id", "id").collect()]
    assert got == [(0, 0, [0.0, 0.0, 0.1173], [0, 0, 0, 1, 0], ""), (0, 1, [0.0, 0.7572, -0.4692], [1, 0, 0, 0, 0], ""),
                   (0, 2, [0.0, -0.7572, -0.4692], [1, 0, 0, 0, 0], ""), (1, 0, [1.5, 2.0, 3.0], [0, 0, 0, 0, 0], "sulphur"), (1, 1, [4.0, 5.0, 6.0], [0, 1, 0, 0, 0], "sulphur")]
    assert rows(edges) == [(0, 1, 0, 0), (0, 1, 1, 1), (0, 2, 0, 0), (1, 0, 0, 0), (1, 0, 1, 1), (2, 0, 0, 0)]


def test_sdf_touching_numbers_and_windows_lines(spark, tmp_path):
    atoms = "".join(f"    {k:.4f}    0.0000    0.0000 C   0  0\r\n" for k in range(120))
    (tmp_path / "m.sdf").write_bytes(f"big\r\n\r\n\r\n120101  0\r\n{atoms}".encode() + b"".join(b"%3d%3d  1  0\r\n" % (k, k + 1) for k in range(10, 111)) + b"M  END\r\n$$$$\r\n")
    nodes, edges = R.read_sdf(spark, str(tmp_path / "m.sdf"), line_end="\r\n")
    assert nodes.count() == 120 and rows(edges.filter("src < dst").select("src", "dst")) == [(k - 1, k) for k in range(10, 111)]


def test_sdf_round_trip_in_tiny_splits(spark, tmp_path, tiny_splits):
    atoms = spark.createDataFrame([(g, i, [float(i), -g / 4, 0.5], "HCNOF"[(g + i) % 5]) for g in range(60) for i in range(g % 7 + 1)], "graph_id long, id long, pos array<double>, symbol string")
    bonds = spark.createDataFrame([(g, i, i + 1, g % 3) for g in range(60) for i in range(g % 7)], "graph_id long, src long, dst long, kind long")
    R.write_sdf(atoms, bonds, str(tmp_path / "out"))
    nodes, edges = R.read_sdf(spark, str(tmp_path / "out"))
    assert spark.read.option("lineSep", "$$$$\n").text(str(tmp_path / "out")).rdd.getNumPartitions() > 10
    assert rows(nodes.selectExpr("graph_id", "id", "pos", "element_at(array('H','C','N','O','F'), int(array_position(x, 1D)))")) == rows(atoms)
    assert rows(edges.filter("src < dst").select("graph_id", "src", "dst", "kind")) == rows(bonds)
    with pytest.raises(Exception, match="999"):
        R.write_sdf(spark.range(1000).selectExpr("0L graph_id", "id", "array(0D, 0D, 0D) pos", "'C' symbol"), bonds, str(tmp_path / "big"))
    with pytest.raises(Exception, match="coordinate"):
        R.write_sdf(spark.range(1).selectExpr("0L graph_id", "id", "array(123456D, 0D, 0D) pos", "'C' symbol"), bonds, str(tmp_path / "far"))


PLY = """ply
format ascii 1.0
comment a square and a pentagon
element vertex 5
property uchar red
property float x
property float y
property float z
element edge 1
property int a
property int b
element face 3
property list uchar int texture
property uchar flag
property list uchar int vertex_indices
end_header
9 0 0 0
9 1 0 0
9 1 1 0
9 0 1 0
9 -1 .5 2e1
0 1
2 7 7 1 4 0 1 2 3
0 1 5 0 1 2 3 4
1 7 0 2 0 1
"""


def test_ply(spark, tmp_path, tiny_splits):
    (tmp_path / "m.ply").write_text(PLY)
    nodes, faces = R.read_ply(spark, str(tmp_path / "m.ply"))
    assert rows(nodes)[4] == (4, [-1.0, 0.5, 20.0]) and nodes.count() == 5
    assert rows(faces) == [(0, 1, 2), (0, 1, 2), (0, 2, 3), (0, 2, 3), (0, 3, 4)]
    (tmp_path / "b.ply").write_text(PLY.replace("ascii", "binary_little_endian"))
    with pytest.raises(ValueError, match="ASCII"):
        R.read_ply(spark, str(tmp_path / "b.ply"))
    with pytest.raises(ValueError, match="header"):
        R.read_ply(spark, file_of(tmp_path, "no mesh\n"))


def file_of(folder, text):
    (folder / "x.txt").write_text(text)
    return str(folder / "x.txt")


def test_mesh_writers(spark, tmp_path, tiny_splits):
    nodes = spark.createDataFrame([(i, [i / 3, float(-i), 1e-7 * i]) for i in range(40)], "id long, pos array<double>")
    faces = spark.createDataFrame([(k, list(range(k, k + 3 + k % 2))) for k in range(30)], "id long, corners array<long>")
    want = sorted((k, k + j, k + j + 1) for k in range(30) for j in range(1, 2 + k % 2))
    for write, read in ((R.write_ply, R.read_ply), (R.write_off, S.read_off)):
        path = str(tmp_path / write.__name__)
        write(nodes, faces, path)
        v, f = read(spark, path)
        assert rows(v) == rows(nodes) and rows(f) == want


def test_matrix_writers(spark, tmp_path, tiny_splits):
    a = spark.createDataFrame([(0, 2, 1.5), (2, 0, -2.0), (2, 3, 1e-9), (2, 3, 1e-9)], "i long, j long, v double")
    R.write_dense(a, 4, 5, str(tmp_path / "d"))
    full, meta = S.read_matrix_market(spark, str(tmp_path / "d"))
    assert (meta.nrow, meta.ncol, full.count()) == (4, 5, 20) and rows(full.filter("v <> 0")) == [(0, 2, 1.5), (2, 0, -2.0), (2, 3, 2e-9)]
    for values, base, header in ((True, 1, True), (True, 0, False), (False, 0, True)):
        path = str(tmp_path / f"c{values}{base}{header}")
        R.write_csr(a, 4, 5, path, values, base, header)
        want = rows(a if values else a.selectExpr("i", "j", "1D v"))
        assert rows(S.read_csr(spark, path, values, base, header)) == want
