"""The text data source: ranges of bytes, pushed filters, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beaconry.sources import lines


@pytest.fixture
def folder(tmp_path):
    told = {}
    for k in range(3):
        rows = [[-(k + j) % 90, j % 7 + 0.5, k * 100 + j, j % 13, j % 4] for j in range(50)]
        told[k] = rows
        text = "\n".join("  ".join(map(str, r)) for r in rows) + ("\n" if k else "")
        (tmp_path / f"part-{k}.txt").write_text(text + ("not numbers here at all\n\n1 2\n" if k == 2 else ""))
    (tmp_path / "_SUCCESS").write_text("1 2 3 4 5\n")
    return tmp_path, told


def test_ranges_cover_each_line_once(spark, folder):
    path, told = folder
    lines.register(spark)
    want = sorted((r[2], tuple(map(float, r[:2])), r[3], r[4]) for rows in told.values() for r in rows)
    for split in (7, 100, 1 << 20):
        df = spark.read.format(lines.NAME).option("split", split).load(str(path))
        got = df.collect()
        assert sorted((r["x"], tuple(r["features"]), r["y"], r["floor"]) for r in got) == want, split
        in_order = [r["x"] for r in sorted(got, key=lambda r: r["src_idx"])]
        assert in_order == sorted(in_order)
    assert spark.read.format(lines.NAME).load(f"file://{path}/part-1*").count() == 50
    assert spark.read.format(lines.NAME).load(f"{path}/nothing*").count() == 0
    first = spark.read.format(lines.NAME).option("layout", "places_first").load(f"{path}/part-0.txt").orderBy("src_idx").first()
    assert (first["x"], first["y"], first["floor"], first["features"]) == (0.0, 0.5, 0, [0.0, 0.0])


def test_filters_are_pushed(spark, folder):
    path, told = folder
    lines.register(spark)
    df = spark.read.format(lines.NAME).load(str(path)).where((F.col("floor") == 2) & (F.col("x") >= 110) & F.col("y").isin(1.0, 5.0, 6.0) & (F.size("features") == 2))
    assert sorted(r["x"] for r in df.collect()) == sorted(r[2] for rows in told.values() for r in rows if r[4] == 2 and r[2] >= 110 and r[3] in (1, 5, 6))
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    above = plan[plan.index("Filter") :] if "Filter" in plan else ""
    assert "floor" not in above.split("Condition", 1)[-1].split("\n", 1)[0] if "Condition" in above else True, plan
    assert "PushedFilters" in plan and "EqualTo(floor,2)" in plan.replace(" ", ""), plan


def test_a_stream_reads_new_files(spark, folder, tmp_path_factory):
    path, told = folder
    lines.register(spark)
    out = tmp_path_factory.mktemp("out")
    stream = spark.readStream.format(lines.NAME).load(str(path))

    def drain():
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        q.awaitTermination(120)
        return spark.read.parquet(f"{out}/rows")

    assert drain().count() == 150
    (path / "part-3.txt").write_text("1 2 900 4 1\n")
    rows = drain()
    assert rows.count() == 151 and rows.where("x = 900").first()["features"] == [1.0, 2.0]
