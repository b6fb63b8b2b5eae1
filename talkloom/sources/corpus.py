"""Scans and sinks of a corpus folder: seeds, hold-outs, pools by file prefix, configurations, reports.

Configurations are small documents that the driver reads (JSON, or YAML where
that library is there); everything with rows is a plan.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.sources import jsonl

_S = lambda *names: [T.StructField(n, T.StringType()) for n in names]
ROLE = T.StructType(_S("name", "description"))
SEED = T.StructType([*_S("id", "topic", "setting", "cefr_level", "locale", "category"), T.StructField("subtopics", T.ArrayType(T.StringType())), T.StructField("user_role", ROLE), T.StructField("model_role", ROLE)])
MESSAGE = T.StructType(_S("role", "content"))
PAIR = T.StructType([*_S("id", "system_prompt"), T.StructField("metadata", T.StructType(_S("cefr_level", "locale", "category", "axis"))), T.StructField("prompt_messages", T.ArrayType(MESSAGE)), T.StructField("chosen", MESSAGE), T.StructField("rejected", MESSAGE)])
#: Pools of preference pairs by file prefix.
POOLS = ["register", "on_policy", "sentinel"]


def valid_or_rejected(df: DataFrame, rules: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with ``broken``): ``rules`` is an array of broken rules' names."""
    marked = df.withColumn("broken", rules)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def pair_pools(spark: SparkSession, folder: str) -> DataFrame:
    """All preference pairs of passed files with ``pool`` from the file's prefix; malformed and incomplete pairs go."""
    df = jsonl.lines(spark, folder).where(~F.col("file").rlike(r"_failed\.[^.]*$"))
    example = F.get_json_object("line", "$.example")
    record = F.from_json(F.coalesce(example, F.col("line")), PAIR)
    pool = F.coalesce(*[F.when(F.col("file").startswith(p), F.lit(p)) for p in POOLS])
    rows = df.select("file", pool.alias("pool"), record.alias("r")).where(F.col("pool").isNotNull())
    whole = F.col("id").isNotNull() & F.col("chosen.content").isNotNull() & F.col("rejected.content").isNotNull() & (F.size("prompt_messages") > 0)
    return rows.select("file", "pool", "r.*").where(F.coalesce(whole, F.lit(False)))


def seeds(spark: SparkSession, folder: str, levels: list[str]) -> DataFrame:
    """``level, position, id`` and the body of the seeds of ``<level>.jsonl``; ``position`` is the level's place in the list."""
    df = jsonl.parsed(jsonl.lines(spark, folder), SEED).withColumn("level", F.regexp_extract("file", r"^(.*)\.jsonl$", 1))
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level")).cast("int")
    return df.where(F.col("level").isin(levels) & F.col("record").isNotNull()).select("level", position.alias("position"), "record.*")


def holdout(spark: SparkSession, folder: str, levels: list[str], per_level: int | None = None) -> DataFrame:
    """Seeds that are whole (id, topic, three subtopics or more), by id the first ``per_level`` of each level."""
    whole = F.col("id").isNotNull() & F.col("topic").isNotNull() & F.coalesce(F.size("subtopics") >= 3, F.lit(False))
    rows = seeds(spark, folder, levels).where(whole)
    if per_level is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("level").orderBy("id"))).where(F.col("_r") <= per_level).drop("_r")


def scenario(df: DataFrame) -> DataFrame:
    """``id, topic, subtopics, user_role_name, ..., model_role_description`` of scenario documents (column ``line``), flat or nested; a comma-separated string of subtopics is taken apart."""
    def role(field: str, part: str) -> Column:
        whole = F.get_json_object("line", f"$.{field}.name").isNotNull() & F.get_json_object("line", f"$.{field}.description").isNotNull()
        return F.when(whole, F.get_json_object("line", f"$.{field}.{part}")).otherwise(F.coalesce(F.get_json_object("line", f"$.{field}_{part}"), F.lit("")))

    raw = F.get_json_object("line", "$.subtopics")
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)))
    roles = [role(f, p).alias(f"{f}_{p}") for f in ("user_role", "model_role") for p in ("name", "description")]
    return df.select(F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.topic").alias("topic"), F.filter(listed, lambda x: x != "").alias("subtopics"), *roles)


def pick_scenario(spark: SparkSession, path: str, seed_id: str | None = None, index: int = 0) -> dict:
    """One scenario of a JSON-lines file, by id or by its place among the lines that aren't blank; raises ValueError on a malformed line or a missing one."""
    lines = [r.value for r in spark.read.text(path).where(F.trim("value") != "").collect()]  # a seeds file of one level
    rows = []
    for number, line in enumerate(lines, 1):
        try:
            rows.append(json.loads(line))
        except ValueError as error:
            raise ValueError(f"{path}: line {number} is malformed") from error
    found = [i for i, r in enumerate(rows) if r.get("id") == seed_id] if seed_id is not None else [index] if 0 <= index < len(rows) else []
    if not found:
        raise ValueError(f"{path}: no such scenario")
    return scenario(spark.createDataFrame([(lines[found[0]],)], "line string")).first().asDict()


def load_document(text: str) -> dict:
    """A configuration as JSON, or as YAML where PyYAML is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def locales(document: dict) -> tuple[dict[str, dict], str]:
    """(locale name to its settings, the default's name): a document of one locale, or of several under ``locales``."""
    if "locales" in document:
        many = {str(k): dict(v or {}) for k, v in document["locales"].items()}
        if not many:
            raise ValueError("no locale is configured")
        default = document.get("default", next(iter(many)))
        if default not in many:
            raise ValueError(f"the default locale {default!r} is not configured")
        return many, default
    name = document.get("name", jsonl.DEFAULT_LOCALE)
    return {name: dict(document)}, name


def categories(document: dict, defaults: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(name, description) of configured categories, strings or objects, the first of a name; the defaults if none is usable."""
    raw = ((document.get("generation") or {}).get("categories")) or []
    found: dict[str, str] = {}
    for item in raw if isinstance(raw, list) else []:
        name, text = (item, "") if isinstance(item, str) else (item.get("name"), item.get("description", "")) if isinstance(item, dict) else (None, "")
        if isinstance(name, str) and name.strip():
            found.setdefault(name.strip(), str(text or "").strip())
    return list(found.items()) or list(defaults)


def _cells(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str]]:
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", space)]
    for row in ElementTree.fromstring(book.read(sheet)).iterfind(".//m:row", space):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", space):
            letters = "".join(x for x in c.get("r", "A") if x.isalpha())
            column = 0
            for letter in letters:
                column = 26 * column + ord(letter) - 64
            value = c.find("m:v", space)
            text = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
            cells[column - 1] = shared[int(text)] if c.get("t") == "s" else text
        yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an XLSX word list as strings, its first row the names. The driver reads it: a workbook is one compressed file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    import io

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheet = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))[0]
        head, *rows = list(_cells(book, sheet)) or [[]]
    names = [h or f"column_{i}" for i, h in enumerate(head)]
    width = len(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple((r + [""] * width)[:width]) for r in rows if any(r)], schema)


def log_usage(df: DataFrame, path: str) -> None:
    """Append usage rows with the time they were written."""
    jsonl.write(df.withColumn("logged_at", F.current_timestamp().cast("string")), path, "append")


def write_with_failures(df: DataFrame, path: str, failures: str, error: str = "error") -> tuple[int, int]:
    """Append rows without an error to ``path`` and the others to ``failures``; how many each."""
    good, bad = df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
    return jsonl.write(good, path, "append"), jsonl.write(bad, failures, "append")


def condition_sets(records: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Write each ablation condition's rows: ``plan`` (condition, stream, origin) says which origin's records of a stream it takes; counts by condition and stream.

    The folder is replaced as a whole, a sub-folder a condition and stream.
    """
    chosen = records.join(plan, ["stream", "origin"])
    chosen.write.mode("overwrite").partitionBy("condition", "stream").parquet(path)
    return records.sparkSession.read.parquet(path).groupBy("condition", "stream").agg(F.count(F.lit(1)).alias("n"))


def rewrite_with_backup(spark: SparkSession, path: str, change) -> tuple[int, int]:
    """Replace a JSON-lines folder by ``change(DataFrame) -> (kept, dropped)``: (rows kept, rows dropped).

    The first rewrite keeps the original in ``<path>.bak``; dropped rows are
    appended to ``<path>.dropped``. The result is written beside the folder and
    then takes its place, so a failed job leaves it as it was.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, backup, fresh = (hadoop.Path(p) for p in (path, f"{path}.bak", f"{path}.new"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    kept, dropped = change(spark.read.text(path))
    files.delete(fresh, True)
    n = jsonl.write_lines(kept, fresh.toString())
    m = jsonl.write_lines(dropped, f"{path}.dropped", "append")
    if files.exists(backup):
        files.delete(at, True)
    else:
        files.rename(at, backup)
    files.rename(fresh, at)
    return n, m


def report(df: DataFrame, metrics: dict, folder: str, samples_per_level: int = 2) -> str:
    """Write the examples as JSON lines and the metrics as JSON; the Markdown of the first samples by level is returned."""
    spark = df.sparkSession
    jsonl.write(df, f"{folder}/examples")
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy("level").orderBy("id"))).where(F.col("_r") <= samples_per_level)
    rows = first.orderBy("level", "id").select("level", "id", "messages").collect()  # a few a level
    return "\n".join(f"## {r.level} {r.id}\n\n" + "\n".join(f"**{m.role}**: {m.content}" for m in r.messages) + "\n" for r in rows)
