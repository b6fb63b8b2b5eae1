"""Scans and sinks of a corpus folder."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from talkloom.sources import corpus, jsonl
from tests.test_sources import GOOD, put

SEED = {"id": "a1", "topic": "t", "setting": "s", "subtopics": ["a", "b", "c"], "user_role": {"name": "U", "description": "u"}, "model_role": {"name": "M", "description": "m"}}
PAIR = {"id": "p", "system_prompt": "s", "metadata": {"cefr_level": "A1"}, "prompt_messages": [{"role": "user", "content": "q"}], "chosen": {"role": "assistant", "content": "c"}, "rejected": {"role": "assistant", "content": "r"}}


def test_pools_by_prefix(spark, tmp_path):
    put(tmp_path, "register_A1_passed.jsonl", [PAIR, {"example": {**PAIR, "id": "w"}, "pipeline": {}}, "junk", {**PAIR, "chosen": None}])
    put(tmp_path, "on_policy_A1_passed.jsonl", [{**PAIR, "id": "o"}, {**PAIR, "prompt_messages": []}])
    put(tmp_path, "sentinel_A1.jsonl", [{**PAIR, "id": "s"}])
    put(tmp_path, "sentinel_A1_failed.jsonl", [PAIR])
    put(tmp_path, "other_A1.jsonl", [PAIR])
    got = {(r.pool, r.id) for r in corpus.pair_pools(spark, str(tmp_path)).collect()}
    assert got == {("register", "p"), ("register", "w"), ("on_policy", "o"), ("sentinel", "s")}


def test_invalid_rows_go_with_a_reason(spark, tmp_path):
    put(tmp_path, "a.jsonl", [GOOD, {**GOOD, "id": None}])
    good, bad = corpus.valid_or_rejected(jsonl.strict(spark, str(tmp_path)), jsonl.violations())
    assert good.count() == 1 and [r.broken for r in bad.collect()] == [["id"]]


def test_seeds_and_holdout(spark, tmp_path):
    put(tmp_path, "A1.jsonl", [SEED, {**SEED, "id": "a0"}, "broken", {**SEED, "id": "a9", "subtopics": ["x"]}])
    put(tmp_path, "B1.jsonl", [{**SEED, "id": "b"}])
    put(tmp_path, "C2.jsonl", [{**SEED, "id": "c"}])
    rows = corpus.seeds(spark, str(tmp_path), ["B1", "A1"]).orderBy("position", "id").collect()
    assert [(r.level, r.id) for r in rows] == [("B1", "b"), ("A1", "a0"), ("A1", "a1"), ("A1", "a9")] and rows[0].user_role.name == "U"
    assert sorted(r.id for r in corpus.holdout(spark, str(tmp_path), ["A1", "B1"]).collect()) == ["a0", "a1", "b"]
    assert sorted(r.id for r in corpus.holdout(spark, str(tmp_path), ["A1", "B1"], 1).collect()) == ["a0", "b"]


def test_scenarios(spark, tmp_path):
    flat = {"id": "f", "topic": "t", "subtopics": "a, b,,c ", "user_role_name": "U", "model_role_description": "m"}
    got = {r.id: r for r in corpus.scenario(spark.createDataFrame([(json.dumps(x),) for x in (SEED, flat, {"id": "n", "topic": "t"})], "line string")).collect()}
    assert got["a1"].subtopics == ["a", "b", "c"] == got["f"].subtopics and got["n"].subtopics == []
    assert (got["a1"].user_role_name, got["f"].user_role_name, got["f"].model_role_description, got["f"].model_role_name) == ("U", "U", "m", "")
    put(tmp_path, "A1.jsonl", [SEED, "", {**SEED, "id": "z", "topic": "last"}])
    path = str(tmp_path / "A1.jsonl")
    assert corpus.pick_scenario(spark, path, "z")["topic"] == "last" and corpus.pick_scenario(spark, path, index=1)["id"] == "z"
    for kw in ({"seed_id": "no"}, {"index": 2}):
        with pytest.raises(ValueError):
            corpus.pick_scenario(spark, path, **kw)
    put(tmp_path, "bad.jsonl", [SEED, "{broken"])
    with pytest.raises(ValueError, match="line 2"):
        corpus.pick_scenario(spark, str(tmp_path / "bad.jsonl"))


def test_configurations():
    assert corpus.locales({"name": "x", "country": "X"}) == ({"x": {"name": "x", "country": "X"}}, "x")
    assert corpus.locales({"locales": {"a": {"c": 1}, "b": None}, "default": "b"}) == ({"a": {"c": 1}, "b": {}}, "b")
    with pytest.raises(ValueError):
        corpus.locales({"locales": {"a": {}}, "default": "z"})
    defaults = [("general", "")]
    doc = {"generation": {"categories": ["food", {"name": "food", "description": "second"}, {"name": " art ", "description": " d "}, 5, {"x": 1}]}}
    assert corpus.categories(doc, defaults) == [("food", ""), ("art", "d")]
    assert corpus.categories({}, defaults) == defaults == corpus.categories({"generation": {"categories": [7]}}, defaults)
    assert corpus.load_document('{"a": 1}') == {"a": 1}
    pytest.importorskip("yaml")
    assert corpus.load_document("a:\n  - 1") == {"a": [1]}


def test_spreadsheet(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>CEFR</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row><row><c r="B3"><v>4</v></c></row><row/></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>word</t></si><si><r><t>ru</t></r><r><t>n</t></r></si></sst>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", shared)
    df = corpus.spreadsheet(spark, str(tmp_path / "w.xlsx"))
    assert df.columns == ["word", "CEFR"] and sorted(map(tuple, df.collect())) == [("", "4"), ("run", "3")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "bad"), ("c", None)], "id string, error string")
    assert corpus.write_with_failures(df, str(tmp_path / "out"), str(tmp_path / "failed")) == (2, 1)
    assert jsonl.existing_ids(spark, str(tmp_path / "out")).count() == 2
    assert jsonl.write(df, str(tmp_path / "wrapped"), envelope="error") == 3
    assert {json.loads(r.value)["pipeline"] for r in spark.read.text(str(tmp_path / "wrapped")).collect()} == {None, "bad"}
    corpus.log_usage(spark.createDataFrame([("gen", 5)], "stage string, tokens int"), str(tmp_path / "usage"))
    assert "logged_at" in spark.read.text(str(tmp_path / "usage")).first().value
    records = spark.createDataFrame([("x", "raw", 1), ("x", "new", 2), ("y", "raw", 3)], "stream string, origin string, id int")
    plan = spark.createDataFrame([("c1", "x", "raw"), ("c2", "x", "new"), ("c2", "y", "raw")], "condition string, stream string, origin string")
    counts = corpus.condition_sets(records, plan, str(tmp_path / "sets"))
    assert sorted(map(tuple, counts.collect())) == [("c1", "x", 1), ("c2", "x", 1), ("c2", "y", 1)]


def test_rewrite_keeps_the_first_original(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.createDataFrame([(str(i),) for i in range(6)], "value string").write.text(path)
    odd = lambda df: (df.where(F.col("value") % 2 == 1), df.where(F.col("value") % 2 == 0))
    assert corpus.rewrite_with_backup(spark, path, odd) == (3, 3)
    assert corpus.rewrite_with_backup(spark, path, lambda df: (df.where("value > 1"), df.where("value <= 1"))) == (2, 1)
    values = lambda p: sorted(r.value for r in spark.read.text(p).collect())
    assert values(path) == ["3", "5"] and values(path + ".bak") == list("012345") and values(path + ".dropped") == ["0", "1", "2", "4"]


def test_report(spark, tmp_path):
    rows = [(f"i{k}", level, [("user", "q"), ("assistant", f"a{k}")]) for k, level in enumerate(["B1", "A1", "A1", "A1"])]
    df = spark.createDataFrame(rows, "id string, level string, messages array<struct<role:string,content:string>>")
    text = corpus.report(df, {"n": 4}, str(tmp_path / "run"))
    assert text.count("## A1") == 2 and "## B1 i0" in text and "**assistant**: a1" in text
    assert json.loads(spark.read.text(str(tmp_path / "run" / "summary")).first().value) == {"n": 4}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from talkloom import session

    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
    Fake.sparkContext.master = "local[4]"
    assert session.shared_dir(Fake()).endswith("spark-warehouse/shared")
    df = session.materialise(spark.range(3), "test")
    assert df.count() == 3 and session.clean_up(spark) >= 1
    with pytest.raises(Exception):
        session.materialise(df, "again")
