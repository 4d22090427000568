"""One JSON document in many splits against the plain parser and the serial reader."""

import json
import random

import pytest

from resona.sources import files, json_split
from tests.test_csv_split import small_splits  # noqa: F401


def value(rng, deep=0):
    kinds = ["text", "text", "number", "none"] + (["object", "list"] if deep < 3 else [])
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", "好", "\n", "a", '"data": [', " "]) for _ in range(rng.randint(0, 8)))
    if kind == "number":
        return rng.randint(0, 99)
    if kind == "none":
        return None
    return {"k": value(rng, deep + 1), "data": [value(rng, deep + 1)]} if kind == "object" else [value(rng, deep + 1) for _ in range(3)]


def rows(n, seed=1):
    """id, a text with all marks, and a nested value kept as text so that all rows have one schema."""
    rng = random.Random(seed)
    return [{"id": i, "t": json.dumps(value(rng), ensure_ascii=False) + "}" * (i % 3), "n": {"x": [{"y": str(value(rng, 3))}]}} for i in range(n)]


def as_sorted(df):
    return sorted(((r.id, r.t, r.n.x[0].y) for r in df.collect()))


FORMS = {
    "array": lambda r: r,
    "data": lambda r: {"code": 0, "note": 'a } "data": [ b', "page": {"data": [{"id": -1}]}, "before": [{"id": -2}], "data": r,
                       "after": [{"id": -3}, [{"id": -4}]], "end": {"n": 1}},
}


@pytest.mark.parametrize("form,style", [("array", {}), ("array", {"indent": 2}), ("data", {"indent": 2}), (
    "data", {"ensure_ascii": False, "separators": (",", ":")})])
def test_many_splits_equal_the_parser(spark, tmp_path, small_splits, form, style):  # noqa: F811
    want = rows(120)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(FORMS[form](want), **style) + "\n", encoding="utf-8")
    assert files._bytes(spark, str(path)) > 10 * files._split_bytes(spark)
    assert json_split.elements(spark, str(path)) is not None
    got = files.read_source(spark, str(path))
    assert got.columns == ["id", "n", "t"]
    assert as_sorted(got) == sorted((r["id"], r["t"], r["n"]["x"][0]["y"]) for r in want)
    assert as_sorted(files.read_json_document(spark, str(path), split=False)) == as_sorted(got)


def test_an_element_over_many_splits_and_a_folder_of_both_forms(spark, tmp_path, small_splits):  # noqa: F811
    (tmp_path / "d").mkdir()
    want = []
    for name, form in FORMS.items():
        some = rows(40, len(name))
        some[7]["t"] = 'long "} ' * 900
        want += some
        (tmp_path / "d" / f"{name}.json").write_text("\ufeff" + json.dumps(form(some), ensure_ascii=False), encoding="utf-8")
    got = files.read_json_document(spark, str(tmp_path / "d"), split=True)
    assert as_sorted(got) == sorted((r["id"], r["t"], r["n"]["x"][0]["y"]) for r in want)


@pytest.mark.parametrize("text", [
    '{"id": 1, "t": "}"}', '[1, {"id": 2}]', '[[{"id": 1}]]', '[{"id": 1}', '{"data": [{"id": 1}], "x": 1',
    '{"data": [{"id": 1}], "data": [{"id": 2}]}', '{"data": [], "page": {"id": 1}}', "", '[{"id": 1} {"id": 2}]'])
def test_other_forms_are_left_to_the_serial_reader(spark, tmp_path, text):
    path = tmp_path / "o.json"
    path.write_text(text, encoding="utf-8")
    assert json_split.elements(spark, str(path)) is None


def test_single_object_empty_data_and_rows_with_a_data_field(spark, tmp_path):
    for split in (True, False):
        (tmp_path / "s.json").write_text('{"id": 1, "t": "}"}')
        assert [tuple(r) for r in files.read_json_document(spark, str(tmp_path / "s.json"), split=split).collect()] == [(1, "}")]
        (tmp_path / "e.json").write_text('{"data": [], "page": {"id": 1}}')
        with pytest.raises(files.EmptySourceError):
            files.read_json_document(spark, str(tmp_path / "e.json"), split=split)
        (tmp_path / "n.json").write_text('[{"id": 1, "data": [{"z": 1}]}, {"id": 2, "data": []}]')
        got = files.read_json_document(spark, str(tmp_path / "n.json"), split=split)
        assert got.columns == ["data", "id"] and sorted(r.id for r in got.collect()) == [1, 2]
