import json

import pytest
from pyspark.sql import functions as F

from talkloom.operators import filters
from talkloom.sources import jsonl
from talkloom.streaming.filtering import filter_stream

GOOD = {"id": "sft_1", "metadata": {"topic": "t", "cefr_level": "A1", "scenario_type": "normal", "subtopics": ["a", "b", "c"]}, "system_prompt": None, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}]}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_strict_scan(spark, tmp_path):
    put(tmp_path / "ok", "a.jsonl", [GOOD, "", "  ", GOOD])
    assert jsonl.strict(spark, str(tmp_path / "ok")).count() == 2
    for i, bad in enumerate(["{broken", {**GOOD, "extra": 1}, "[1]"]):
        put(tmp_path / f"bad{i}", "a.jsonl", [GOOD, bad])
        with pytest.raises(Exception, match="bad record"):
            jsonl.strict(spark, str(tmp_path / f"bad{i}")).collect()


def test_tolerant_scan(spark, tmp_path):
    wrapped = {"example": {**GOOD, "id": "w"}, "pipeline": {}}
    put(tmp_path, "normal_A1_passed.jsonl", [GOOD, wrapped, "nonsense", "[]", {"example": 5}, {**GOOD, "id": "n", "example": None}])
    put(tmp_path, "normal_A1_failed.jsonl", [GOOD])
    assert sorted(r.id for r in jsonl.tolerant(spark, str(tmp_path)).collect()) == ["sft_1", "w"]
    assert sorted(r.id for r in jsonl.tolerant(spark, str(tmp_path), null_example_is_root=True).collect()) == ["n", "sft_1", "w"]
    assert jsonl.tolerant(spark, str(tmp_path), pattern="redirect*").count() == 0


def test_validation_and_cleaning(spark, tmp_path):
    md = GOOD["metadata"]
    rows = [GOOD, {**GOOD, "metadata": {**md, "cefr_level": "Z9"}}, {**GOOD, "metadata": {**md, "subtopics": ["a", "b"]}}, {**GOOD, "metadata": {**md, "subtopics": list("abcdefg")}}, {**GOOD, "messages": [{"role": "nobody", "content": "x"}]}, {**GOOD, "id": None, "messages": []}]
    put(tmp_path, "a.jsonl", rows)
    df = jsonl.strict(spark, str(tmp_path))
    assert sorted(tuple(r.v) for r in df.select(jsonl.violations().alias("v")).collect()) == [(), ("id", "messages"), ("level",), ("role",), ("subtopics",), ("subtopics",)]
    cleaned = jsonl.clean(df).collect()
    assert len(cleaned) == 5 and {r.locale for r in cleaned} == {"china"} and {r.category for r in cleaned} == {"general"}


def test_sink_and_resume(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", [GOOD, {**GOOD, "id": "sft_2"}])
    df = jsonl.strict(spark, str(tmp_path / "in"))
    jsonl.write(df.where("id = 'sft_1'"), str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(line)["system_prompt"] is None and "system_prompt" in line
    left = jsonl.resume(df, jsonl.existing_ids(spark, str(tmp_path / "out")))
    assert [r.id for r in left.collect()] == ["sft_2"]
    jsonl.write(left, str(tmp_path / "out"), mode="append")
    assert jsonl.resume(df, jsonl.existing_ids(spark, str(tmp_path / "out"))).count() == 0


def test_word_list_and_terms(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿Head-Word;CEFR level;x\nrun;A1;1\n", encoding="utf-8")
    rows = jsonl.word_list(spark, str(tmp_path / "w.csv"), {"word": ["lemma", "head word"], "band": ["cefr_level"], "pos": ["pos"]}).collect()
    assert [tuple(r) for r in rows] == [("run", "A1", None)]
    assert jsonl.term_categories({"_note": ["x"], "food": [" Pizza", {"more": ["pizza", "Bagel"]}], "none": None}) == {"food": ["Pizza", "Bagel"], "none": []}


def test_verdict_cache(spark):
    schema = "entity string, locale string, verdict string, judged_at double"
    old = spark.createDataFrame([("Paris", "china", "out", 1.0), ("Beijing", "", "in", 1.0)], schema)
    new = spark.createDataFrame([("paris", "china", "in", 2.0), ("Rome", "china", "bogus", 3.0)], schema)
    cache = jsonl.upsert_verdicts(old, new, ["in", "out", "ambiguous"])
    wanted = spark.createDataFrame([("PARIS", "china"), ("Beijing", "china"), ("Beijing", "japan"), ("Rome", "china")], "entity string, locale string")
    assert sorted((r.entity, r.locale, r.verdict) for r in jsonl.lookup_verdicts(wanted, cache).collect()) == [("Beijing", "china", "in"), ("Beijing", "japan", None), ("PARIS", "china", "in"), ("Rome", "china", None)]


def test_stream(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", [GOOD, {**GOOD, "id": "t", "messages": [{"role": "assistant", "content": "<think>x</think>"}]}, "broken"])

    def run(df):
        return filters.run_pipeline(df, {"mode_consistency": filters.mode_consistency(df)})

    for name in ("a.jsonl", "b.jsonl"):  # the second file repeats the first one's ids
        (tmp_path / "in" / name).write_text((tmp_path / "in" / "a.jsonl").read_text())
        filter_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), run).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.state) for r in out.select("id", F.col("state")).collect()) == [("sft_1", "passed"), ("t", "failed")]
