"""Sources: a registry of data sets as rows, readers by kind, one prompts table out."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators.normalize import capped

TEMPLATE = "id string, text string, slots array<string>, task_type string, level string, token_length int, source string, compatible_with array<string>"
OPTION = "id string, value string, slot string, compatible_task_types array<string>, compatible_templates array<string>, token_length int, source string, tags array<string>, source_option_id string, option_type string"
SEGMENT = "span_text string, taxonomy_label string, level string, source_prompt string, classification_method string"


@dataclass(frozen=True)
class Source:
    """One entry of a registry. kind: parquet, jsonl, json (one array, or an object whose first list holds the rows), csv."""

    name: str
    kind: str
    paths: tuple[str, ...]
    fields: tuple[str, ...]
    sample: int = 0
    options: dict = field(default_factory=dict)


def rows(spark: SparkSession, source: Source) -> DataFrame:
    reader = spark.read.options(**source.options)
    if source.kind == "parquet":
        return reader.parquet(*source.paths)
    if source.kind == "jsonl":
        return reader.json(list(source.paths))
    if source.kind == "csv":
        return reader.option("header", True).csv(list(source.paths))
    if source.kind == "json":
        df = reader.option("multiLine", True).json(list(source.paths))
        held = next((f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
        named = set(source.fields) <= set(df.columns)
        return df if named or held is None else df.select(F.inline(held))
    raise ValueError(f"unknown kind of source: {source.kind}")


def field_text(df: DataFrame, name: str):
    """A field as text: strings as they are; of message lists the content (or value, or text) of the user's turns; lists of
    strings a line each; anything else as JSON. A field that is missing is null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        have = kind.elementType.fieldNames()
        roles = [n for n in ("role", "from") if n in have]
        said = lambda m: F.coalesce(*[F.nullif(m[n].cast("string"), F.lit("")) for n in ("content", "value", "text") if n in have], F.lit(None).cast("string"))
        mine = lambda m: F.lower(F.coalesce(*[m[n] for n in roles], F.lit(""))).isin("user", "human", "")
        return F.array_join(F.filter(F.transform(F.filter(c, mine), said), lambda t: t.isNotNull()), "\n")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.array_join(c, "\n")
    return F.to_json(c) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")


def load_prompts(spark: SparkSession, registry: list[Source], only: list[str] | None = None) -> DataFrame:
    """(source, prompt): all sources of a registry, blank texts dropped, at most `sample` rows a source picked by hash of
    the text (0: all). A source that can't be read is left out and named in a warning."""
    import warnings

    out = spark.createDataFrame([], "source string, prompt string")
    for s in registry:
        if only and s.name not in only:
            continue
        try:
            df = rows(spark, s)
            text = X.instruction_text(*[field_text(df, f) for f in s.fields])
            df = df.select(F.lit(s.name).alias("source"), text.alias("prompt")).where(~X.blank("prompt"))
        except Exception as e:  # noqa: BLE001 - one source must not end the others
            warnings.warn(f"source {s.name} left out: {str(e)[:200]}", stacklevel=2)
            continue
        if s.sample:
            df = df.withColumn("_h", F.md5(F.concat(F.lit("42|"), "prompt")))
            df = capped(df, "source", "_h", s.sample).drop("_h")
        out = out.unionByName(df)
    return out


def load_store(spark: SparkSession, templates: list[str], options: list[str], form: str = "") -> tuple[DataFrame, DataFrame]:
    """Templates and options from JSON arrays, JSON lines (form jsonl) or Parquet (form parquet, or by the files' names), old level names brought up to date, rows numbered by arrival.
    Empty lists of paths give empty tables."""
    old = F.create_map(*[F.lit(x) for kv in V.OLD_LEVELS.items() for x in kv])

    def table(paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], schema)
        if form == "parquet" or not form and all(p.rstrip("/").endswith(".parquet") for p in paths):
            return spark.read.schema(schema).parquet(*paths)
        if form == "jsonl":
            return spark.read.schema(schema).json(paths)
        return spark.read.schema(schema).option("multiLine", True).json(paths)

    t = table(templates, TEMPLATE).withColumn("level", F.coalesce(F.element_at(old, F.col("level")), "level"))
    return t.withColumn("template_seq", F.monotonically_increasing_id()), table(options, OPTION).withColumn("option_seq", F.monotonically_increasing_id())


def load_segments(spark: SparkSession, path: str) -> DataFrame:
    """(source_prompt, segments): cached segments by prompt, in file order within a file."""
    s = spark.read.schema(SEGMENT).json(path).withColumn("_seq", F.monotonically_increasing_id())
    return s.groupBy("source_prompt").agg(F.array_sort(F.collect_list(F.struct("_seq", "span_text", "taxonomy_label", "level"))).alias("segments"))


def load_few_shots(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, prompt, annotation): a JSON object of lists, one row an example; annotation is null where not annotated."""
    one = "array<struct<prompt:string,annotation:struct<templates:array<struct<text:string,slots:array<string>,task_type:string,level:string>>,options:array<struct<value:string,slot:string>>>>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{one}>")).alias("dataset", "x")).select("dataset", F.inline("x"))


def scrape_strings(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): string literals of ten characters or more in source files."""
    f = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    found = F.concat(F.regexp_extract_all("value", F.lit(r'"((?:[^"\\\n]|\\.){10,})"'), F.lit(1)), F.regexp_extract_all("value", F.lit(r"'((?:[^'\\\n]|\\.){10,})'"), F.lit(1)))
    return f.select("file", F.explode(found).alias("text"))
