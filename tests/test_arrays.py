"""JSON arrays that are read in byte ranges, against Python's reader."""

import gzip
import json
import random

import pytest

from plumbline.sources import arrays, tables

ODD = ['{', '}', '"', "\\", "\\\"", "}{", "é\n", "a}, {b", "]", "\\}"]


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choices([*ODD, "abc", "x" * r.randrange(60)], k=r.randrange(6)))
    return [{"parent_asin": f"P{i}", "title": word(), "features": [word(), word()], "details": {"k": word(), "deep": {"{": word()}} if i % 3 else {}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_any_ranges_give_all_records(spark, tmp_path, indent):
    want = made(1, 150)
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (1 << 27, 1999, 97):  # whole; records cross some ranges; ranges lie within records
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            parts = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
            assert parts >= (1 if size > 1999 else 8)
            got = [json.loads(r.record) for r in arrays.records(spark, str(tmp_path / "a.json")).collect()]
            assert sorted(got, key=lambda x: int(x["parent_asin"][1:])) == want, size
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_other_elements_and_files(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.json").write_text(' [1, "a{b", null, {"parent_asin": "A"}, [], "}", {"parent_asin": "B", "features": ["x"]}, {"parent_asin": "C", ]')
    (at / "b.json").write_text("[]")
    (at / "c.json").write_text("")
    with gzip.open(at / "d.json.gz", "wt") as f:
        f.write('[{"parent_asin": "D"}\n,\n{}]')
    got = sorted(r.record for r in arrays.records(spark, str(at)).collect())
    assert got == ['{"parent_asin": "A"}', '{"parent_asin": "B", "features": ["x"]}', '{"parent_asin": "D"}', "{}"]
    rows = tables.lenient_catalog(spark, str(at), array=True).collect()
    assert sorted((r.parent_asin or "", r.features) for r in rows) == [("", None), ("A", None), ("B", '["x"]'), ("D", None)]
