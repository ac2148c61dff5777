"""Scans of question files, result logs, caches and listings (S-01 .. S-10)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("question", "answer", "video_paths")


def file_name(path=None):
    return F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1)


def json_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, item): the elements of JSON array files with their position; items are VARIANT, as their fields have several types."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<variant>").alias("items"))
    return raw.select("file", F.posexplode("items").alias("pos", "item"))


def questions(spark: SparkSession, folder: str, categories: Iterable[str]) -> DataFrame:
    """S-01, F-01, P-01 .. P-04: entries of qa_<category>.json files; categories without a file are skipped.

    An item counts if it has the keys question, answer and video_paths, whatever their values.
    """
    names = list(categories)
    rows = json_arrays(spark, f"{folder}/qa_*.json").withColumn("category", F.regexp_extract(file_name(F.col("file")), "^qa_(.*)\\.json$", 1))
    rows = rows.where(F.col("category").isin(names))
    text = F.to_json("item")
    keys = F.json_object_keys(text)
    rows = rows.where(F.forall(F.array(*map(F.lit, REQUIRED)), lambda k: F.array_contains(keys, k)))
    get = lambda path, kind="string": F.try_variant_get("item", path, kind)
    by_letter = get("$.options", "map<string,string>")
    listed = get("$.options", "array<string>")
    options = F.when(by_letter.isNotNull(), F.transform(F.array_sort(F.map_entries(by_letter)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))).otherwise(listed)
    answer = F.coalesce(get("$.answer"), F.to_json(get("$.answer", "map<string,string>")))
    key = F.concat_ws("_", F.coalesce(get("$.scene_id"), F.lit("scene")), F.coalesce(get("$.question_type"), F.col("category")), F.col("pos").cast("string"))
    return rows.select(
        "category",
        "pos",
        key.alias("key"),
        get("$.question").alias("question"),
        options.alias("candidates"),
        F.when(options.isNotNull(), F.lower(answer)).otherwise(answer).alias("correct_answer"),
        F.coalesce(get("$.question_type"), F.col("category")).alias("question_type"),
        get("$.video_paths", "array<string>").alias("video_paths"),
        get("$.camera_names", "map<string,string>").alias("camera_names"),
        get("$.stsg_metadata.cameras", "array<string>").alias("needed_cameras"),
        get("$.stsg_metadata.num_cameras", "int").alias("num_needed_cameras"),
        get("$.reasoning").alias("gt_reasoning"),
    )


def by_source(spark: SparkSession, files: dict[str, list[str]], legacy: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """S-03, S-04: items of several sources' files with their source, and the number of items of every file; legacy files are counted only."""
    parts = [json_arrays(spark, paths).withColumn("source", F.lit(source)) for source, paths in files.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("name", file_name(F.col("file")))
    counts = rows.groupBy("source", "name").agg(F.count("*").alias("items"))
    old = list(legacy)
    return (rows.where(~F.col("name").isin(old)) if old else rows), counts


def jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """S-05, S-06: rows of JSON lines; blank lines and lines that don't parse are skipped; adds the file and, for a stable order, the line's place."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.where(F.trim("value") != "").withColumn("ok", F.try_parse_json("value").isNotNull())
    return parsed.where("ok").select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def cache_files(paths: list[str], listing: list[str]) -> list[str]:
    """S-07: the files of a cache: a path with _shard alone; else the file and its _shard* siblings, in order."""
    out = []
    for p in paths:
        if "_shard" in p.rsplit("/", 1)[-1]:
            out.append(p)
            continue
        base = p.removesuffix(".jsonl")
        out += [x for x in [p] if x in listing] + sorted(x for x in listing if x.startswith(f"{base}_shard") and x.endswith(".jsonl"))
    return list(dict.fromkeys(out))


def summary_cache(spark: SparkSession, files: list[str]) -> DataFrame:
    """W-04, F-11: the last valid summary of each video, over files in order."""
    from ..plans.planning import last_wins

    rows = jsonl(spark, files, "video string, summary string, error string, prompt_ver string")
    names = F.array(*[F.lit(f.rsplit("/", 1)[-1]) for f in files])
    valid = (F.coalesce("summary", F.lit("")) != "") & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("prompt_ver", F.lit("v1")) == "v1")
    placed = rows.where(valid).withColumn("ordinal", F.array_position(names, file_name(F.col("file"))))
    return last_wins(placed.select("video", "summary", "ordinal", "line"), "video", "ordinal", "line").select("video", "summary")


def results_tree(spark: SparkSession, root: str) -> DataFrame:
    """S-08: entries of <root>/<model>/<dataset>/<strategy>/*.json files, a JSON object each, with what the path says; judge sidecars are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,variant>").alias("m"))
    part = F.split("file", "/")
    rows = rows.withColumn("model", F.element_at(part, -4)).withColumn("dataset", F.element_at(part, -3)).withColumn("strategy", F.element_at(part, -2)).withColumn("name", F.element_at(part, -1))
    rows = rows.where(~F.contains("name", F.lit("_judge_")))
    stem = F.regexp_replace("name", "\\.json$", "")
    mark = F.concat(F.lit("_"), F.col("strategy"), F.lit("_"))
    at = F.instr(stem, mark)
    rows = rows.withColumn("category", F.when(at > 0, F.substr(stem, at + F.length(mark))).otherwise(stem))
    return rows.select("model", "dataset", "strategy", "category", F.explode("m").alias("key", "entry"))


def _flow(text: str) -> dict[str, str]:
    """A YAML flow map of plain values; an error if it is none."""
    if not (text.startswith("{") and text.endswith("}")):
        raise ValueError(text)
    out = {}
    for pair in filter(None, (x.strip() for x in text[1:-1].split(","))):
        key, colon, value = pair.partition(":")
        if not colon or ":" in value or not value.strip():
            raise ValueError(pair)
        out[key.strip().strip("\"'")] = value.strip()
    return out


def price_table(spark: SparkSession, text: str) -> DataFrame:
    """S-09: (model, input, output, cached_input) of a YAML price list; a missing price is 0; models with a price that is no number are left out; a list that doesn't parse gives an empty table."""
    rows: dict[str, dict[str, str]] = {}
    model, out = None, []
    try:
        for line in text.splitlines():
            bare = line.split("#", 1)[0].rstrip()
            if not bare.strip():
                continue
            name, colon, value = bare.strip().partition(":")
            name, value = name.strip("\"'"), value.strip()
            if not colon:
                raise ValueError(bare)
            if bare[0] != " ":
                model = name
                rows[model] = _flow(value) if value else {}
            elif model is None or not value:
                raise ValueError(bare)
            else:
                rows[model][name] = value
    except ValueError:
        rows = {}
    for m, r in rows.items():
        try:
            v = {k: float(x) for k, x in r.items()}
        except ValueError:
            continue
        out.append((m, v.get("input", 0.0), v.get("output", 0.0), v.get("cached_input")))
    return spark.createDataFrame(out, "model string, input double, output double, cached_input double")


#: Question categories by dataset where no configuration says otherwise. Fixed values.
DEFAULT_CATEGORIES = {
    "nuscenes": ["counting", "spatial", "temporal", "event_ordering", "summarization"],
    "meva": ["counting", "spatial", "temporal", "event_ordering", "best_camera", "summarization"],
    "ego-exo4d": ["temporal", "event_ordering", "best_camera", "summarization"],
    "agibot": ["temporal", "event_ordering", "summarization"],
}


def category_config(text: str | None) -> dict[str, list[str]]:
    """S-02: dataset -> categories of a YAML text with one map ``categories`` of flow lists or of dashed items; {} if there is none or it doesn't parse."""
    out: dict[str, list[str]] = {}
    inside, name = False, None
    for line in (text or "").splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        if bare[0] not in " -":
            inside, name = bare.strip() == "categories:", None
        elif inside and bare.strip().startswith("- ") and name:
            out[name].append(bare.strip()[2:].strip().strip("\"'"))
        elif inside:
            name, colon, value = bare.strip().partition(":")
            name, value = name.strip().strip("\"'"), value.strip()
            if not colon or value and not (value.startswith("[") and value.endswith("]")):
                return {}
            out[name] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
    return out


def categories(spark: SparkSession, configured: dict[str, list[str]] | None = None, defaults: dict[str, list[str]] = DEFAULT_CATEGORIES) -> DataFrame:
    """S-02: (dataset, pos, category), from the configuration or, for datasets it lacks, the defaults; the order counts."""
    merged = {**defaults, **(configured or {})}
    return spark.createDataFrame([(d, i, c) for d, cs in merged.items() for i, c in enumerate(cs)], "dataset string, pos int, category string")


def chance_rows(spark: SparkSession, path: str) -> DataFrame:
    """S-10: (task_type, options) of a JSON array of questions."""
    rows = json_arrays(spark, path)
    return rows.select(F.try_variant_get("item", "$.task_type", "string").alias("task_type"), F.coalesce(F.try_variant_get("item", "$.options", "array<string>"), F.array().cast("array<string>")).alias("options"))
