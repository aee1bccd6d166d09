"""Large JSON files cut into records, against Python's own reader."""

import json

import pytest

from rillmark.sources import datasets


@pytest.fixture
def small_splits(spark):
    """Files in splits of some hundred bytes, so that records span them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def _content(n):
    odd = ['a } b', '{"', '\\', '\\"}', 'x\ny', 'ž§ {{', '', '}}}', '],', '"terms": [', 'long ' * 90]
    terms = [{"id": str(i), "name": odd[i % len(odd)], "x": {"y": {"z": [{"k": i}] * (i % 3)}}} for i in range(n)]
    laws = [{"id": f"f{i}", "law_iri": "l", "text": odd[-1 - i % len(odd)] * (1 + i % 4), "paragraph": None} for i in range(n)]
    return {"version": "a } { b", "info": {"no": {"record": 1}}, "law_fragments": laws, "definitions": [], "links": [{"id": "1", "source": "s", "target": "t"}], "terms": terms, "tags": ["q", "{"], "metadata": [{"law_id": "m", "citace": "c", "name": "n"}]}


def _rows(found):
    return sorted((r.section, json.dumps(json.loads(r.body), sort_keys=True)) for r in found.collect())


def _wanted(content):
    return sorted((k, json.dumps(r, sort_keys=True)) for k, v in content.items() if isinstance(v, list) for r in v if isinstance(r, dict))


@pytest.mark.parametrize("style", ["line", "indented", "bom", "bare end"])
def test_records_are_those_of_the_file(spark, tmp_path, small_splits, style):
    content = _content(60)
    text = json.dumps(content, ensure_ascii=False, indent=2 if style == "indented" else None)
    (tmp_path / "a.json").write_text(("\ufeff" if style == "bom" else "") + text + ("" if style == "bare end" else "\n"))
    found = datasets.records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert _rows(found) == _wanted(content)
    assert datasets.section(found, "terms").count() == 60
    assert sorted(datasets.section(found, "links").first()) == ["1", "s", "t"]
    assert datasets.bad(found, "terms").count() == 0 and datasets.section(found, "definitions").count() == 0


def test_several_files_keep_their_sections_apart(spark, tmp_path, small_splits):
    one, two = {"terms": _content(9)["terms"]}, {"links": [{"id": str(i), "source": "{", "target": "}"} for i in range(30)]}
    for n, c in enumerate((one, two, {}, {"terms": []})):
        (tmp_path / f"{n}.json").write_text(json.dumps(c))
    (tmp_path / "empty.json").write_text("")
    assert _rows(datasets.records(spark, str(tmp_path))) == sorted(_wanted(one) + _wanted(two))


def test_bad_records_stand_aside_and_the_rest_is_read(spark, tmp_path, small_splits):
    good = [{"id": str(i), "name": f"n {i} }}"} for i in range(40)]
    lines = [json.dumps(r) for r in good]
    lines[7] = '{"id": "7", "name": }'
    lines[15] = '{"id": "15", "name": "no end of string}'  # the quote is lost to the end of the line
    lines[15] += ' "}'
    lines[20] = '{"id": "20", "name": 1}}'  # a brace too many
    (tmp_path / "a.json").write_text('{"terms": [\n' + ",\n".join(lines) + '\n],\n"links": [\n{"id": "1"}\n]\n}')
    found = datasets.records(spark, str(tmp_path))
    ids = {r.id for r in datasets.section(found, "terms").collect()}
    assert ids >= {str(i) for i in range(40)} - {"7", "15"} and "7" not in ids
    assert '{"id": "7", "name": }' in {r.body for r in datasets.bad(found, "terms").collect()}
    assert datasets.section(found, "links").count() == 1


def test_a_file_that_was_cut_off_has_one_bad_record(spark, tmp_path, small_splits):
    text = json.dumps({"terms": [{"id": str(i), "name": "x" * i} for i in range(50)]})
    at = text.index('{"id": "30"')
    for n, cut in enumerate((text[: at + 25], text[: text.index("}", at)])):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a.json").write_text(cut)
        found = datasets.records(spark, str(tmp_path / str(n)))
        assert {r.id for r in datasets.section(found, "terms").collect()} == {str(i) for i in range(30)}
        assert [r.body for r in datasets.bad(found, "terms").collect()] == [cut[at:]]
