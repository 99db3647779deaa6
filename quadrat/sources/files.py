"""Readers and writers of the file formats: explicit schemas, checks as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quadrat.functions.scalar import parse_values


def manifest_csv(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> DataFrame:
    """A CSV with header, all columns as strings; a byte order mark is dropped; a repeated key is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)
    df = df.withColumns({c: F.regexp_replace(c, "^\ufeff", "") for c in columns})
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: repeated {key}")
    return df


ENDINGS = (".jsonl.gz", ".jsonl")


def located(spark: SparkSession, path: str):
    """The file system of a path and the path there, without detours by ``..`` and with links resolved as far as it exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    place, rest = fs.makeQualified(place), []
    while not fs.exists(place) and place.getParent() is not None:
        rest.append(place.getName())
        place = place.getParent()
    place = fs.resolvePath(place)
    for name in reversed(rest):
        place = jvm.org.apache.hadoop.fs.Path(place, name)
    return fs, place


def prediction_files(spark: SparkSession, path: str, models: Sequence[str]) -> dict[str, str | None]:
    """model -> its file of JSON lines, ``{model}.jsonl.gz`` or ``{model}.jsonl`` (or a folder of parts of that name), None if there is none."""
    found: dict[str, str | None] = {}
    for m in models:
        places = (f"{path.rstrip('/')}/{m}{end}" for end in ENDINGS)
        found[m] = next((x for x in places if (at := located(spark, x))[0].exists(at[1])), None)
    return found


def read_predictions(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    """Records of the models' files in a folder: model, member, index, prediction, correct, logits, error, broken.

    ``logits`` is the record's ``logits_10`` if it has that field, else its
    ``logits``; null if that isn't a list of numbers.  Fields are read as text, so
    that one of an odd type doesn't spoil the others.  A line that isn't a JSON
    object has ``broken``, the line itself.  A model without a file has no record
    (``prediction_files``).
    """
    # a scan for each model: its name is a constant, not cut out of a path for each line
    files = [spark.read.text(x).select("value", F.lit(m).alias("model")) for m, x in prediction_files(spark, path, models).items() if x]
    lines = reduce(DataFrame.unionByName, files) if files else spark.createDataFrame([], "value string, model string")
    told = lines.select("model", "value", F.from_json("value", "map<string,string>").alias("r"))
    object_ = F.col("r").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    logits = F.from_json(F.when(F.map_contains_key("r", F.lit("logits_10")), F.col("r")["logits_10"]).otherwise(F.col("r")["logits"]), "array<double>")
    correct = F.when(F.col("r")["correct"].isin("true", "false"), F.col("r")["correct"] == "true")
    text = lambda c: F.when(object_, F.col("r")[c]).alias(c)
    fields = [text("member"), F.when(object_, F.expr("try_cast(r['index'] AS bigint)")).alias("index"), text("prediction"), F.when(object_, correct).alias("correct"), F.when(object_, logits).alias("logits"), text("error"), F.when(~object_, F.col("value")).alias("broken")]
    return told.select("model", *fields)


#: Codes of single records.
RECORD_CODES = ("inference_error", "invalid_logits", "argmax_mismatch", "historical_correctness_mismatch", "manifest_index_mismatch")


def prediction_groups(records: DataFrame, manifest: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(member, model, listed, n, *RECORD_CODES): the records of a member and model that aren't broken and how many of them have each fault; a member of the manifest has a row with a null model too.

    ``listed``: it is in the manifest (member, index, class_id; a member once);
    only then are faults counted.  A record goes to its member as the few values
    that are held against the manifest, once, and all that follows stays there.
    """
    n, logits = len(classes), F.col("logits")
    finite = F.coalesce((F.size(logits) == n) & F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    first = (F.array_position(logits, F.array_max(logits)) - 1).cast("tinyint")
    names = F.array(*map(F.lit, classes))
    r = records.where("broken is null and member is not null").select("model", "member", "index", "correct", "prediction", (~F.coalesce(F.col("error"), F.lit("")).isin("", "false", "0", "[]", "{}")).alias("_failed"), finite.alias("_finite"), first.alias("_first"))
    r = r.withColumn("_told", F.col("prediction").eqNullSafe(F.get(names, F.col("_first").cast("int")))).drop("prediction")
    m = manifest.select("member", F.col("index").alias("_at"), F.col("class_id").alias("_class"), F.lit(True).alias("_listed")).where("member is not null")
    # side by side in one shuffle, so a member's rows aren't dealt again by what follows
    of_member = Window.partitionBy("member")
    held = r.unionByName(m, allowMissingColumns=True).withColumns({c: F.max(c).over(of_member) for c in ("_listed", "_at", "_class")})
    wrong = (
        F.col("_failed"),
        ~F.col("_finite"),
        F.col("_finite") & ~F.col("_told"),
        F.col("_finite") & ~F.col("correct").eqNullSafe(F.get(names, F.col("_first").cast("int")) == F.col("_class")),
        ~F.col("index").eqNullSafe(F.col("_at")),
    )
    counted = [F.count_if(F.col("_listed") & F.col("model").isNotNull() & bad).alias(code) for code, bad in zip(RECORD_CODES, wrong, strict=True)]
    return held.groupBy("member", "model").agg(F.coalesce(F.bool_or("_listed"), F.lit(False)).alias("listed"), F.count("*").alias("n"), *counted)


def prediction_issues(records: DataFrame, manifest: DataFrame, classes: Sequence[str], models: Sequence[str], absent: Sequence[str] = ()) -> DataFrame:
    """(model, member, code) of all that is wrong with the records of a manifest (member, index, class_id).

    Each record is held against its row of the manifest: the array is as wide as
    the classes and finite, its first greatest place is the prediction, the
    recorded correctness follows from it, the index is the manifest's.  Members
    that a model has several times, not at all, and broken lines are issues too;
    records of other members are not.  Of a model in ``absent``, one without a
    file, every member is missing with its file.
    """
    g = prediction_groups(records, manifest, classes).where("listed")
    issue = lambda model, code: F.struct(model.alias("model"), F.lit(code).alias("code"))
    kinds = [(c, F.col(c)) for c in RECORD_CODES] + [("duplicate_prediction", F.col("n") - 1)]
    found = F.flatten(F.array(*[F.array_repeat(issue(F.col("model"), c), F.when(F.col("model").isNotNull(), k).otherwise(0).cast("int")) for c, k in kinds]))
    # a row for each model of a member: no list is longer than its models and their issues
    per = g.groupBy("member").agg(F.collect_set("model").alias("has"), F.flatten(F.collect_list(found)).alias("found"))
    code = lambda m: F.when(m.isin(*absent), "missing_prediction_file").otherwise("missing_prediction")
    gone = F.transform(F.array_except(F.array(*map(F.lit, models)), "has"), lambda m: F.struct(m.alias("model"), code(m).alias("code")))
    told = per.select("member", F.inline(F.concat("found", gone))).select("model", "member", "code")
    broken = records.where("broken is not null").select("model", F.lit(None).cast("string").alias("member"), F.lit("malformed_record").alias("code"))
    return told.unionByName(broken)


def annotations(raw: DataFrame, key: str, column: str = "value") -> DataFrame:
    """(key, field, value) of JSON objects whose values are a string or a list of strings."""
    fields = F.from_json(column, "map<string,string>")
    d = raw.select(key, F.explode(fields).alias("field", "_v"))
    return d.select(key, "field", F.explode(parse_values(F.col("_v"))).alias("value"))


def annotation_files(spark: SparkSession, path: str, member: str = "features") -> tuple[DataFrame, DataFrame]:
    """(values, issues) of a folder of JSON files, one a target: (target, field, value); (target, code).

    The target is the file's name without ``.json``.  A file is an object whose
    ``member`` is an object, its values a string or a list of strings.  Spark
    lists the folder and its subfolders, and packs small files into partitions
    by their size and ``spark.sql.files.openCostInBytes``, so very many files are
    few tasks; a file is read whole.  Issues: ``malformed_annotation`` (no JSON
    object), ``missing_features`` (without ``member``), ``repeated_target`` (a name
    in several folders).
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    raw = raw.select(F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("target"), "value")
    whole = F.from_json("value", "map<string,string>")
    object_ = whole.isNotNull() & F.rlike("value", F.lit(r"^\s*\{"))
    raw = raw.withColumn("features", F.when(object_, whole[member]))
    inner = F.from_json("features", "map<string,string>").isNotNull() & F.rlike("features", F.lit(r"^\s*\{"))
    code = F.when(~object_, "malformed_annotation").when(~F.coalesce(inner, F.lit(False)), "missing_features")
    issues = raw.select("target", code.alias("code")).where("code is not null")
    again = raw.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select("target", F.lit("repeated_target").alias("code"))
    return annotations(raw.where(inner).select("target", F.col("features").alias("value")), "target"), issues.unionByName(again)


def dictionary(schema: DataFrame, exclusive: Sequence[str]) -> DataFrame:
    """One row for each (field, possible value)."""
    d = schema.select("field", F.explode(F.from_json("possible_values", "array<string>")).alias("value"))
    return d.withColumn("exclusive", F.col("value").isin(*exclusive))


def write_tables(df: DataFrame, path: str, protected: Sequence[str] = ()) -> None:
    """Parquet and CSV of the same rows; an existing place is refused, and one that is a protected input, lies in it or holds it."""

    def told(p: str) -> str:
        uri = located(df.sparkSession, p)[1].toUri()  # in parts: one place has several spellings as a whole
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath().rstrip('/')}/"

    mine = told(path)
    for p in protected:
        other = told(p)
        if mine.startswith(other) or other.startswith(mine):
            raise ValueError(f"{path} isn't apart from the protected {p}")
    df.write.mode("errorifexists").parquet(f"{path}/parquet")
    flat = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    df.withColumns(flat).write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
