"""CSV with line breaks in fields: many splits against the serial reader."""

import csv
import random

import pytest

from resona.sources import csv_split, files


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def cell(rng):
    return "".join(rng.choice(["a", "好", ",", '"', "\n", "\r\n", " ", "x\ny\n", '""\n', "plain"]) for _ in range(rng.randint(0, 9)))


def write(path, rows, end="\n", start=""):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(start)
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "文 本", "c"])
        w.writerows(rows)
    return str(path)


@pytest.mark.parametrize("end,start", [("\n", ""), ("\r\n", "\ufeff")])
def test_many_splits_equal_the_serial_reader(spark, tmp_path, small_splits, end, start):
    rng = random.Random(len(end))
    rows = [(str(i), cell(rng), cell(rng)) for i in range(400)] + [("long", "line\n" * 500, "z"), ("last", "", "q")]
    path = write(tmp_path / "a.csv", rows, end, start)
    assert files._bytes(spark, path) > 10 * files._split_bytes(spark)
    got = files.read_csv(spark, path)
    assert got.columns == ["id", "文 本", "c"]
    want = rows if end == "\n" else [tuple(c.replace("\r\n", "\n") for c in r) for r in rows]
    assert sorted((r[0], r[1] or "", r[2] or "") for r in got.collect()) == sorted(want)
    serial = files.read_csv(spark, path, split=False)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, serial.collect())))


def test_each_file_of_a_folder_has_its_header_and_its_state(spark, tmp_path, small_splits):
    (tmp_path / "d").mkdir()
    rows = {n: [(f"{n}{i}", f"{n}\n,\"{i}", "") for i in range(60)] for n in "ab"}
    for n in rows:
        write(tmp_path / "d" / f"{n}.csv", rows[n])
    got = files.read_csv(spark, str(tmp_path / "d"), split=True)
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(r[:2] for n in rows for r in rows[n])


def test_loose_quotes_go_through_the_serial_reader(spark, tmp_path, small_splits):
    path = tmp_path / "q.csv"
    path.write_text("id,t\n" + "".join(f'{i},tape of 5" width\n' for i in range(300)), encoding="utf-8")
    assert not csv_split.is_strict(csv_split.records(spark, str(path)))
    assert files.read_csv(spark, str(path)).count() == 300


def test_empty_and_header_only(spark, tmp_path):
    for text in ("", "a,b\n"):
        path = tmp_path / f"e{len(text)}.csv"
        path.write_text(text, encoding="utf-8")
        with pytest.raises(files.EmptySourceError):
            files.read_csv(spark, str(path), split=True)


def test_encodings_are_told_apart(spark, tmp_path):
    text = "评论内容,赞\n" + "".join(f"第{i}条很好玩,{i}\n" for i in range(50))
    for name in ("utf-8", "utf-8-sig", "gbk"):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
    with pytest.raises(files.SourceError, match="javaCharsets"):
        files.read_csv(spark, str(tmp_path / "gbk.csv"), encoding="auto")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        got = {n: sorted(map(tuple, files.read_source(spark, str(tmp_path / f"{n}.csv"), encoding="auto").select("评论内容", "赞").collect()))
               for n in ("utf-8", "utf-8-sig", "gbk")}
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert got["utf-8"] == got["utf-8-sig"] == got["gbk"] and ("第7条很好玩", "7") in got["gbk"] and len(got["gbk"]) == 50
