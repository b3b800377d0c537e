"""Results folders of an evaluation run: trial records, event logs, rubrics."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_trials(spark: SparkSession, run: str, schema=None) -> DataFrame:
    """run/<task>/*.json, one record a file; tool lists and transcripts beside them are left out."""
    reader = spark.read.option("multiLine", "true")
    own = (reader.schema(schema) if schema else reader).json(f"{run}/*/*.json")
    name = F.col("_metadata.file_name")
    return own.where(~name.contains("-tools") & ~name.contains("-transcript"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(trial_id, line_no, value): trial_id is the log's file name; line_no rises with the lines of a log, not one by one.

    Long logs are read in splits: the number is the split's first byte and the line's number in its task. A task reads no
    more bytes than a full split has, so what comes before a split never reaches its numbers.
    """
    name = F.regexp_extract("_metadata.file_name", r"\A(.*?)(?:\.ndjson|\.jsonl)?\z", 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(name.alias("trial_id"), place.alias("line_no"), F.regexp_replace("value", "\r\\z", "").alias("value"))
    return lines.where(F.trim("value") != "")


def address(spark: SparkSession, folder: str) -> str:
    """folder's whole address, such as file:/data/run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def _opened(path: str):
    """The pyarrow file system of a whole address, and the place in it."""
    from pyarrow.fs import FileSystem

    scheme, host, place = re.fullmatch(r"(\w+):(?://([^/]*))?(/.*)", path, re.S).groups("")
    return FileSystem.from_uri(f"{scheme}://{host}{quote(place)}")


def with_text(df: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """df and a column ``text``: what the file folder/name holds, null where there is none. Tasks read one file after
    another, empty ones too, which Spark's own readers leave out."""
    root = address(df.sparkSession, folder)

    def read(frames):
        for df in frames:
            for i, own in enumerate(df[name]):
                fs, place = _opened(f"{root}/{own}") if own else (None, None)
                found = None
                if own and fs.get_file_info(place).is_file:
                    with fs.open_input_stream(place) as f:
                        found = f.read().decode("utf-8", "replace")
                yield df.iloc[i : i + 1].assign(**{text: found})

    schema = StructType([*df.schema.fields, StructField(text, StringType())])
    return df.mapInPandas(read, schema)


RECORD = "path string, task_id string, repetition int, response string, scored boolean"


def read_records(spark: SparkSession, run: str) -> DataFrame:
    """(path, task_id, repetition, response, scored) of run/<task>/*.json: where the record is, its trial, the name of its
    response's file relative to run, and whether it has scores. What is no record has nulls; no folder has no records."""
    root = address(spark, run)
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RECORD)
    own = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.json").load(root)
    own = own.select("path", F.expr(f"substring(path, {len(root) + 2})").alias("name"), F.col("content").cast("string").alias("text"))
    own = own.where(F.regexp_like("name", F.lit(r"\A[^/]+/[^/]+\z")) & ~F.regexp_like("name", F.lit(r"/[^/]*-(tools|transcript)[^/]*\z")))
    taken = lambda path, kind: F.try_variant_get("v", path, kind)
    own = own.select("path", F.try_parse_json("text").alias("v"))
    scored = taken("$.quality.fact_score", "double").isNotNull()
    return own.select("path", taken("$.meta.task_id", "string").alias("task_id"), taken("$.meta.repetition", "int").alias("repetition"), taken("$.artifacts.response", "string").alias("response"), scored.alias("scored"))


def update_record(path: str, quality: dict) -> None:
    """Put quality into the record at path: the new file is written beside the old one and moved onto it."""
    fs, place = _opened(path)
    with fs.open_input_stream(place) as f:
        data = json.loads(f.read())
    data["quality"] = (data.get("quality") or {}) | quality
    part = f"{place}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(data, indent=2).encode())
    fs.move(part, place)


RUBRIC = "task_id string, facts array<struct<pattern:string,description:string,weight:double>>, checks array<struct<type:string,description:string,applies_to:string,expected:string,field:string>>, criteria string, reference string"


def read_rubric_files(tasks: DataFrame, folder: str) -> DataFrame:
    """tasks: task_id. (task_id, facts, checks, criteria, reference) of those that have a rubric file in folder, read and
    parsed by tasks; reference is a file's name."""

    def parse(frames):
        import yaml

        for df in frames:
            rows = []
            for task, text in zip(df["task_id"], df["text"]):
                data = yaml.safe_load(text) or {}
                facts = [{"pattern": f["pattern"], "description": f.get("description", ""), "weight": float(f.get("weight", 1.0))} for f in data.get("required_facts") or []]
                checks = [{"type": c["type"]} | {k: None if c.get(k) is None else str(c[k]) for k in ("description", "applies_to", "expected", "field")} for c in data.get("structure_checks") or []]
                rows.append((task, facts, checks, data.get("judge_criteria") or None, Path(data.get("reference_answer") or "").name))
            yield pd.DataFrame(rows, columns=["task_id", "facts", "checks", "criteria", "reference"])

    named = tasks.select("task_id", F.concat("task_id", F.lit(".rubric.yaml")).alias("name")).where("task_id IS NOT NULL").distinct()
    return with_text(named, folder, "name", "text").where("text IS NOT NULL").mapInPandas(parse, RUBRIC)


def read_rubrics(spark: SparkSession, folder: str, tasks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, checks) of the tasks' rubric files; a task without a file has none."""
    own = read_rubric_files(spark.createDataFrame([(t,) for t in tasks], "task_id string"), folder)
    return facts_of(own), checks_of(own)


def facts_of(rubrics: DataFrame) -> DataFrame:
    return rubrics.select("task_id", F.explode("facts").alias("f")).select("task_id", "f.*")


def checks_of(rubrics: DataFrame) -> DataFrame:
    return rubrics.select("task_id", F.explode("checks").alias("c")).select("task_id", "c.*")


def read_reference(folder: str, name: str) -> str:
    path = Path(folder, Path(name).name)
    return path.read_text() if name and path.exists() else ""
