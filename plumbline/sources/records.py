"""Readers and writers of the engine's records. All go through Spark, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.batch import is_refused

EVENT = "struct<type:string,index:int,details:struct<phrase:string,context:string,pattern:string,match:string,ngram_tuple:array<string>,ngram_string:string,remove_stopwords_active:boolean,suppression_detail_key:string>,original_token_string:string,fixed:boolean>"
GENERATION = f"prompt_id string, prompt string, generation string, status string, error string, events array<{EVENT}>, duration_sec double, tokens_generated_prompt long, refusal_detected boolean, refusal_label string, refusal_confidence double"
SHAREGPT = "conversations array<struct<`from`:string,value:string>>, prompt string, text string"
PROFILE = "`human-authored` struct<num_texts_analyzed:double,avg_length:double,top_bigrams:array<struct<ngram:string,frequency:double>>,top_trigrams:array<struct<ngram:string,frequency:double>>>"
TIMING = "chunk int, ctx_len int, api_sec double, validators_sec double"


def prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_id, prompt`` of a JSON list of strings; anything else in it is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"), F.from_json("value", "array<variant>").alias("v"))
    strings = F.coalesce(F.forall("v", lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    checked = whole.select(F.when(strings, F.col("a")).otherwise(F.raise_error(F.lit("not a list of strings")).cast("array<string>")).alias("a"))
    return checked.select(F.posexplode("a").alias("prompt_id", "prompt")).withColumn("prompt_id", F.col("prompt_id").cast("long"))


def sharegpt(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dialogue dataset in JSON lines."""
    return spark.read.schema(SHAREGPT).json(path)


def generations(spark: SparkSession, path: str) -> DataFrame:
    """A generation log, with the folders of its waves; malformed lines and lines without an id are left out."""
    rows = spark.read.schema(GENERATION).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return rows.where("prompt_id is not null")


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files in a folder."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine's own."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def log_ids(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_id`` of a log; none where there is no log yet."""
    return generations(spark, path).select("prompt_id") if exists(spark, path) else spark.createDataFrame([], "prompt_id string")


def refusals(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_id`` of the rows of an earlier log that count as refused, each once. A missing file is an error; lines without an id are left out."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = generations(spark, path)
    return rows.where(is_refused(F.col("refusal_detected"), F.col("status"), F.col("generation"))).select("prompt_id").distinct()


def dataset(spark: SparkSession, path: str, split: str = "train", config: str | None = None, limit: int | None = None) -> DataFrame:
    """``conversations, prompt, text`` of a dialogue dataset on disk: a folder or file of parquet or JSON lines.

    A folder may have its configuration and its split as folders within, or as the beginnings of
    file names. Columns that it lacks are null.
    """
    base = f"{path.rstrip('/')}/{config}" if config else path.rstrip("/")
    folder = f"{base}/{split}" if exists(spark, f"{base}/{split}") else base
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(F.col("path").rlike(r"\.(parquet|jsonl?|json\.gz|jsonl\.gz)$"))
    files = [r["path"] for r in named.collect()]  # names only
    if folder == base and any(f.rsplit("/", 1)[-1].startswith(split) for f in files):
        files = [f for f in files if f.rsplit("/", 1)[-1].startswith(split)]
    if not files:
        raise FileNotFoundError(f"no dataset files under {folder}")
    tables = [f for f in files if f.endswith(".parquet")]
    found = spark.read.parquet(*tables) if tables else spark.read.schema(SHAREGPT).json(files)
    turns = "array<struct<`from`:string,value:string>>"
    kinds = {"conversations": turns, "prompt": "string", "text": "string"}
    rows = found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return rows if limit is None else rows.limit(limit)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log that are not valid."""
    parsed = F.from_json("value", GENERATION + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    return spark.read.text(path).select(parsed["_corrupt_record"].alias("line")).where("line is not null")


def texts(rows: DataFrame) -> DataFrame:
    """Rows that have a generation; none at all is an error."""
    found = rows.where("generation is not null")
    if found.isEmpty():
        raise ValueError("no generations")
    return found


def human_profile(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Items ``ngram, frequency`` for n-grams of 2 or 3, and one row ``chars``: the characters that the profile was made from."""
    p = spark.read.schema(PROFILE).option("multiLine", True).json(path).select("human-authored.*")
    items = p.select(F.inline(F.col({2: "top_bigrams", 3: "top_trigrams"}[n])))
    return items, p.select((F.col("num_texts_analyzed") * F.col("avg_length")).alias("chars"))


def latest_timings(spark: SparkSession, folder: str) -> DataFrame:
    """The timing table written last under a folder."""
    rows = spark.read.schema(TIMING).option("header", True).csv(folder).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    last = rows.groupBy("file", "at").count().orderBy(F.desc("at"), F.desc("file")).limit(1).select("file")
    return rows.join(F.broadcast(last), "file", "left_semi").drop("file", "at")


def append_generations(rows: DataFrame, path: str) -> None:
    """Append to a generation log; preference pairs do not go there."""
    rows.drop("ftpo_samples").write.mode("append").json(path)


def put(rows: DataFrame, path: str) -> None:
    """Write a part of a log or of pairs, in place of what an earlier try left there."""
    rows.write.mode("overwrite").json(path)


def append_pairs(rows: DataFrame, path: str) -> None:
    """Append preference pairs."""
    rows.write.mode("append").json(path)


def write_analysis(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV table for each comparison."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_timings(rows: DataFrame, path: str) -> None:
    rows.select("chunk", "ctx_len", "api_sec", "validators_sec").write.mode("append").option("header", True).csv(path)
