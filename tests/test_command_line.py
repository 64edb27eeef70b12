import json
import math

from pyspark.sql import functions as F

from lakefind.__main__ import main
from lakefind.functions.hashed import hashed


def test_hashed(spark):
    rows = spark.createDataFrame([("alpha beta alpha",), ("beta alpha alpha",), ("",), (None,)], "t string").select(hashed(F.col("t"), 16)).collect()
    assert rows[0][0] == rows[1][0] and abs(math.fsum(x * x for x in rows[0][0]) - 1) < 1e-9 and rows[2][0] == rows[3][0] == [0.0] * 16


def test_commands(spark, tmp_path, capsys):
    root, src = str(tmp_path / "index"), tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# Boats\nThe engine of the boat is loud.")
    (src / "b.md").write_text("A quiet garden behind the house, see [[a]].")
    run = lambda *argv: (main(["--root", root, *argv], spark), capsys.readouterr().out)
    assert run("stats", "l")[0] == 1
    code, out = run("index", "l", str(src))
    assert code == 0 and json.loads(out)["added"] == 2
    code, out = run("search", "all", "engine", "--top-k", "1")
    assert code == 0 and json.loads(out)["path"] == "a.md"
    assert "garden" in run("read", "l", "b.md")[1] and run("read", "l", "z.md")[0] == 1 and run("search", "zz", "x")[0] == 1
    assert json.loads(run("stats", "l")[1])["chunks"] == 2 and '"outlinks":["a.md"]' in run("relations", "l")[1]
    assert run("export", "l", str(tmp_path / "ar"))[0] == 0 and run("verify", str(tmp_path / "ar"))[0] == 0 and run("verify", str(tmp_path))[0] == 1
    assert run("index", "l", str(tmp_path / "gone"))[0] == 1 and run("duplicates", "l", "--threshold", "2")[0] == 1
