"""JSON-lines sources and sinks of corpus records, and keyed tables.

Readers parse text lines inside the JVM; a line's validity is a column, so
strict and tolerant scans are filters over one parse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
#: A stored record, and the values its enums may take.
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("topic", "cefr_level", "learner_cefr_target", "scenario_type", "locale", "category")] + [T.StructField("subtopics", T.ArrayType(T.StringType()))])),
        T.StructField("system_prompt", T.StringType()),
        T.StructField("messages", MESSAGES),
    ]
)
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
SCENARIOS = ["normal", "redirect", "evaluation", "unleveled_natural"]
ROLES = ["system", "user", "assistant"]
DEFAULT_LOCALE, DEFAULT_CATEGORY = "china", "general"


def lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """``file, line`` of all lines that aren't blank."""
    text = spark.read.option("pathGlobFilter", pattern).text(path)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def parsed(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Add ``record`` (null if the line is no JSON object), ``unknown`` (top-level keys the schema lacks)."""
    json = F.try_parse_json(F.col("line"))
    # the parser stops at the first value's end
    is_object = json.isNotNull() & F.schema_of_variant(json).startswith("OBJECT") & F.trim("line").endswith("}")
    keys = F.json_object_keys(F.col("line"))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    return df.withColumn("record", F.when(is_object, F.from_json("line", schema))).withColumn("unknown", F.when(is_object, F.array_except(keys, known)))


def strict(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """All records; a malformed line or an unknown field raises when the rows are read."""
    df = parsed(lines(spark, path), schema)
    bad = F.col("record").isNull() | (F.size("unknown") > 0)
    checked = df.withColumn("record", F.when(bad, F.raise_error(F.concat(F.lit("bad record in "), F.col("file"))).cast(schema)).otherwise(F.col("record")))
    return checked.select("record.*")


def tolerant(spark: SparkSession, path: str, pattern: str = "*.jsonl", null_example_is_root: bool = False) -> DataFrame:
    """``file`` and record columns of passed files, bare or in an envelope.

    Files whose stem ends in ``_failed`` are left out, as are lines that are no
    JSON object and rows whose ``example`` is present but no object. A null
    ``example`` drops the row too, unless ``null_example_is_root``.
    """
    df = lines(spark, path, pattern).where(~F.col("file").rlike(r"_failed\.[^.]*$"))
    df = parsed(df)
    example = F.get_json_object("line", "$.example")
    has = F.array_contains(F.json_object_keys("line"), "example")
    inner = F.when(F.trim(example).startswith("{"), F.from_json(example, RECORD))
    root_stands = ~has | (example.isNull() if null_example_is_root else F.lit(False))
    record = F.when(root_stands, F.col("record")).otherwise(inner)
    return df.where(F.col("record").isNotNull()).withColumn("record", record).where(F.col("record").isNotNull()).select("file", "record.*")


def violations() -> Column:
    """Names of the rules a record breaks, as an array; empty for a valid one."""
    md = F.col("metadata")
    rules = {
        "id": F.col("id").isNull(),
        "level": ~F.coalesce(F.coalesce(md["cefr_level"], md["learner_cefr_target"]).isin(LEVELS), F.lit(False)),
        "scenario": ~F.coalesce(md["scenario_type"].isin(SCENARIOS), F.lit(False)),
        "subtopics": ~F.coalesce(F.size(md["subtopics"]).between(3, 6), F.lit(False)),
        "messages": F.coalesce(F.size("messages"), F.lit(0)) < 1,
        "role": F.coalesce(F.exists("messages", lambda m: ~F.coalesce(m["role"].isin(ROLES), F.lit(False))), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())


def clean(df: DataFrame) -> DataFrame:
    """Messages without null role or content; rows without id, metadata or any message left go; defaults filled in."""
    kept = df.withColumn("messages", F.filter("messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull()))
    kept = kept.where(F.col("id").isNotNull() & F.col("metadata").isNotNull() & (F.size("messages") > 0))
    md = F.col("metadata")
    return kept.withColumn("level", F.coalesce(md["cefr_level"], md["learner_cefr_target"])).withColumn("locale", F.coalesce(md["locale"], F.lit(DEFAULT_LOCALE))).withColumn("category", F.coalesce(md["category"], F.lit(DEFAULT_CATEGORY)))


def write(df: DataFrame, path: str, mode: str = "overwrite", envelope: str | None = None) -> int:
    """One JSON object a line, null fields written out; the number of rows.

    With ``envelope`` (a column) lines are ``{"example": row, "pipeline": that column}``.
    """
    row = F.struct("*") if envelope is None else F.struct(F.struct(*[c for c in df.columns if c != envelope]).alias("example"), F.col(envelope).alias("pipeline"))
    return write_lines(df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")), path, mode)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write a column of lines and count them on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).text(path)
    return seen.get["n"]


def existing_ids(spark: SparkSession, path: str, field: str = "id") -> DataFrame:
    """The distinct ids of a sink's lines; malformed lines are ignored."""
    return lines(spark, path, "*").select(F.get_json_object("line", f"$.{field}").alias("id")).where("id is not null").distinct()


def resume(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose id isn't done yet; rows without an id stay."""
    return work.join(done.select(F.col("id").alias(key)), key, "left_anti")


def sniff_delimiter(first_line: str) -> str:
    """Tab, comma or semicolon, whichever the header has most of."""
    return max("\t,;", key=lambda c: (first_line.count(c), -"\t,;".index(c)))


def word_list(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A delimited list; columns are bound by name, ignoring case, spaces, hyphens and underscores, the first alias winning."""
    # bytes that are no UTF-8 come as replacement characters
    head = spark.read.option("encoding", "UTF-8").text(path).first()
    df = spark.read.csv(path, sep=sniff_delimiter((head[0] if head else "").lstrip("﻿")), header=True, encoding="UTF-8")
    plain = lambda s: "".join(c for c in s.lstrip("﻿").lower() if c not in " _-")
    names = {plain(c): c for c in reversed(df.columns)}
    bound = {want: next((names[plain(a)] for a in options if plain(a) in names), None) for want, options in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(want) for want, c in bound.items()])


def flatten_terms(value) -> list[str]:
    """Strings of nested lists and dicts, trimmed, distinct without regard to case, the first spelling kept."""
    if isinstance(value, str):
        found = [value]
    elif isinstance(value, dict):
        found = reduce(lambda a, v: a + flatten_terms(v), value.values(), [])
    elif isinstance(value, list):
        found = reduce(lambda a, v: a + flatten_terms(v), value, [])
    else:
        found = []
    return list({t.lower(): t for t in reversed([x.strip() for x in found if x.strip()])}.values())[::-1]


def term_categories(document: dict) -> dict[str, list[str]]:
    """Categories and their terms; keys that start with an underscore are left out."""
    return {c: flatten_terms(v) for c, v in document.items() if not c.startswith("_")}


def upsert_verdicts(cache: DataFrame, new: DataFrame, valid: list[str]) -> DataFrame:
    """The last verdict per (entity, locale), without regard to case; invalid verdicts are ignored.

    Of verdicts of the same time the new ones win, and of those the greatest.
    """
    key = [F.lower("entity"), F.coalesce("locale", F.lit(""))]
    last = Window.partitionBy(*key).orderBy(F.desc("judged_at"), F.desc("_new"), F.desc("verdict"))
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).where(F.col("verdict").isin(valid))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def lookup_verdicts(wanted: DataFrame, cache: DataFrame, default_locale: str = DEFAULT_LOCALE) -> DataFrame:
    """``wanted`` with ``verdict``; rows cached without a locale count for the default locale alone, and after its own."""
    c = cache.select(F.lower("entity").alias("_e"), F.when(F.coalesce("locale", F.lit("")) == "", F.lit(default_locale)).otherwise(F.col("locale")).alias("_l"), "verdict", (F.coalesce("locale", F.lit("")) == "").alias("_legacy"))
    best = c.groupBy("_e", "_l").agg(F.min_by("verdict", "_legacy").alias("verdict"))
    return wanted.join(best, (F.lower("entity") == F.col("_e")) & (F.col("locale") == F.col("_l")), "left").drop("_e", "_l")
