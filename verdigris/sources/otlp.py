"""OTLP/JSON traces of generative-AI spans: flattened, checked, and reduced to tasks, events and edges without content."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import canonical_json, sha256, strict_json
from ..operators import graphs
from ..schemas import EvidenceError

#: The attributes that pass, and the operations that are calls of models.
ALLOWED = ("gen_ai.operation.name", "gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model", "gen_ai.tool.name", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_creation.input_tokens", "error.type")
MODEL_OPERATIONS = ("chat", "embeddings", "generate_content", "image_generation", "text_completion")
#: The semantic conventions that attributes are read by, and what a contract calls this source.
CONVENTIONS = {"semantic_conventions_version": "1.43.0", "semantic_conventions_genai_commit": "799e014b68f0e786dc44d9117c30758c5f864510"}
ADAPTER = {"source_id": "source.otel-genai", "source_version": "1", "task_unit": "contract-approved-otel-trace", "privacy_mode": "content-dropped-semantic-attributes-only"} | CONVENTIONS
VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>"
ATTRIBUTE = f"struct<key:string,value:{VALUE}>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<{ATTRIBUTE}>,status:struct<code:string>>"
SCHEMA = f"resourceSpans array<struct<scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{SPAN}>>>>>"


KINDS = ("stringValue", "boolValue", "intValue", "doubleValue", "arrayValue", "kvlistValue", "bytesValue")


def value_problem(value: object) -> str | None:
    """Why an attribute's value isn't one of the seven kinds; None if it is."""
    if not isinstance(value, dict) or len(value) != 1 or next(iter(value)) not in KINDS:
        return "a value must be exactly one of the seven kinds"
    kind, given = next(iter(value.items()))
    if kind == "stringValue" and not isinstance(given, str) or kind == "boolValue" and not isinstance(given, bool):
        return f"{kind} is of another type"
    if kind == "intValue" and (isinstance(given, bool) or not isinstance(given, (int, str)) or not re.fullmatch("0|-?[1-9][0-9]*", str(given))):
        return "intValue must be a whole number in plain digits"
    if kind == "doubleValue" and (isinstance(given, bool) or not isinstance(given, (int, float)) or given < 0):
        return "doubleValue must be a number, 0 or more"
    return None


def document_problems(raw: bytes) -> list[str]:
    """What is wrong with the form of one export: its JSON, empty or missing arrays, values of attributes."""
    try:
        root = strict_json(raw, "the export")
    except ValueError as error:
        return [str(error)]
    found: list[str] = []

    def several(item: object, name: str, at: str) -> list:
        inner = item.get(name) if isinstance(item, dict) else None
        if not isinstance(inner, list) or not inner or not all(isinstance(x, dict) for x in inner):
            found.append(f"{at}{name} must be a list of objects that isn't empty")
            return []
        return inner

    for i, resource in enumerate(several(root, "resourceSpans", "")):
        for j, scope in enumerate(several(resource, "scopeSpans", f"resourceSpans[{i}].")):
            place = f"resourceSpans[{i}].scopeSpans[{j}]."
            for k, span in enumerate(several(scope, "spans", place)):
                given = span.get("attributes", [])
                if not isinstance(given, list) or not all(isinstance(a, dict) and isinstance(a.get("key"), str) and a["key"] for a in given):
                    found.append(f"{place}spans[{k}].attributes must be a list of keys and values")
                    continue
                keys = [a["key"] for a in given]
                if len(set(keys)) < len(keys):
                    found.append(f"{place}spans[{k}]: repeated attribute key")
                found += [f"{place}spans[{k}] {a['key']}: {p}" for a in given if (p := value_problem(a.get("value")))]
    return found


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, message) of every export whose form isn't sound, each file decoded strictly where it is read; 20 messages of a file at most."""

    def run(batches):
        for batch in batches:
            rows = [(p, m) for p, c in zip(batch["path"], batch["content"], strict=True) for m in document_problems(bytes(c))[:20]]
            yield pd.DataFrame(rows, columns=["file", "message"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, message string")


def flatten(traces: DataFrame) -> DataFrame:
    """(scope, span) of every span of resourceSpans[].scopeSpans[].spans[]."""
    scopes = traces.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s"))
    has_scope = "scope" in scopes.schema["s"].dataType.fieldNames()
    return scopes.select((F.col("s.scope") if has_scope else F.lit(None).cast("struct<name:string,version:string>")).alias("scope"), F.explode("s.spans").alias("span"))


def attribute_value(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def decoded_id(text: Column, size: int) -> Column:
    """Lower-case hex of an id given as hex or base64; null if it isn't ``size`` bytes."""
    hexadecimal = text.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$")
    other = F.lower(F.hex(F.try_to_binary(text, F.lit("base64"))))
    return F.when(hexadecimal, F.lower(text)).when(F.length(other) == 2 * size, other)


def timestamp_of(nanos: Column) -> Column:
    """Nanoseconds since 1970, as canonical decimal text, to ISO text with nine digits."""
    canonical = nanos.rlike("^(0|[1-9][0-9]{0,18})$")
    n = F.when(canonical, nanos).cast("bigint")
    seconds = F.floor(n / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("bigint")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((n - seconds * 1_000_000_000).cast("string"), 9, "0"), F.lit("Z"))


def spans(traces: DataFrame) -> DataFrame:
    """One row per span: ids, timestamp, the attributes that pass, its kind and status, and ``problem`` (null if there is none)."""
    flat = flatten(traces).select("scope", "span.*")
    passed = F.filter(F.coalesce("attributes", F.array()), lambda a: a["key"].isin(*ALLOWED))
    text = lambda k: F.nullif(attribute_value(F.col("passed"), k)["stringValue"], F.lit(""))
    number = lambda k: attribute_value(F.col("passed"), k)["intValue"].try_cast("bigint")
    rows = flat.withColumn("passed", passed).select(
        decoded_id(F.col("traceId"), 16).alias("trace_id"),
        decoded_id(F.col("spanId"), 8).alias("span_id"),
        F.nullif(decoded_id(F.col("parentSpanId"), 8), F.lit("0" * 16)).alias("parent_id"),
        timestamp_of(F.col("startTimeUnixNano")).alias("timestamp"),
        text("gen_ai.operation.name").alias("operation"),
        F.coalesce(text("gen_ai.response.model"), text("gen_ai.request.model")).alias("model"),
        text("gen_ai.tool.name").alias("tool"),
        number("gen_ai.usage.input_tokens").alias("input_tokens"),
        number("gen_ai.usage.output_tokens").alias("output_tokens"),
        number("gen_ai.usage.cache_read.input_tokens").alias("cache_read"),
        number("gen_ai.usage.cache_creation.input_tokens").alias("cache_creation"),
        F.coalesce(text("gen_ai.provider.name"), F.lit("")).alias("provider"),
        F.concat_ws("@", "scope.name", F.nullif(F.col("scope.version"), F.lit(""))).alias("scope"),
        F.when(F.col("status.code").isin("2", "STATUS_CODE_ERROR") | text("error.type").isNotNull(), "error").otherwise("ok").alias("status"),
        (F.size(F.transform("attributes", lambda a: a["key"])) != F.size(F.array_distinct(F.transform("attributes", lambda a: a["key"])))).alias("_repeated"),
        (F.coalesce(F.col("scope.name"), F.lit("")) == "").alias("_unscoped"),
        (F.coalesce(F.col("parentSpanId"), F.lit("")) != "").alias("_has_parent"),
        decoded_id(F.col("parentSpanId"), 8).isNull().alias("_bad_parent"),
    )
    kind = F.when(F.col("operation") == "execute_tool", "tool").when(F.col("operation").isin(*MODEL_OPERATIONS), "model").when(F.col("operation").isNull(), "structural")
    rows = rows.withColumn("kind", kind)
    model, tokens = F.col("kind") == "model", F.coalesce("input_tokens", F.lit(-1)) + F.coalesce("output_tokens", F.lit(0))
    problem = (
        F.when(F.col("_unscoped"), "scope has no name")
        .when(F.col("trace_id").isNull() | F.col("span_id").isNull() | (F.col("_has_parent") & F.col("_bad_parent")), "invalid id")
        .when(F.col("timestamp").isNull(), "invalid start time")
        .when(F.coalesce("_repeated", F.lit(False)), "repeated attribute key")
        .when(kind.isNull(), "unsupported operation")
        .when((F.col("kind") == "tool") & F.col("tool").isNull(), "tool span without a tool name")
        .when(model & F.col("model").isNull(), "model span without a model")
        .when(model & (F.least("input_tokens", "output_tokens", F.coalesce("cache_read", F.lit(0)), F.coalesce("cache_creation", F.lit(0))) < 0), "negative tokens")
        .when(model & (F.col("input_tokens").isNull() | F.col("output_tokens").isNull()), "model span without tokens")
        .when(model & (tokens <= 0), "model span without positive tokens")
    )
    return rows.withColumn("problem", problem).drop("_repeated", "_unscoped", "_has_parent", "_bad_parent")


@dataclass(frozen=True)
class Traces:
    """``events``: (task_id, event_id, timestamp, kind, name, model, tokens, status); ``tasks``: (task_id, input_digest, started_at); ``edges``."""

    events: DataFrame
    tasks: DataFrame
    edges: DataFrame
    inventory: dict
    source_id: str = "source.otel-genai"


def inspect(spark: SparkSession, path: str) -> Traces:
    """Reads a file or folder of OTLP/JSON; what isn't sound is refused with every reason found (20 of a kind at most are named).

    The tasks, spans and edges of the result stay in Spark. Its inventory has their counts and their digests; the digest
    of the spans streams them through the driver one by one.
    """
    if broken := [f"{r['file'].rpartition('/')[2]}: {r['message']}" for r in file_problems(spark, path).limit(20).collect()]:
        raise EvidenceError(sorted(broken))
    table = spans(spark.read.schema(SCHEMA).option("multiLine", True).json(path)).persist()
    wrong = [f"span {r['span_id']}: {r['problem']}" for r in table.where("problem is not null").limit(20).collect()]
    twice = table.groupBy("trace_id", "span_id").count().where("count > 1")
    wrong += [f"span {r['span_id']}: comes more than once" for r in twice.limit(20).collect()]
    economic = table.where("kind <> 'structural'")
    if not wrong and economic.isEmpty():
        wrong.append("no span of a model or tool")
    if wrong:
        raise EvidenceError(wrong)
    node = F.concat_ws(":", "trace_id", "span_id")
    tree = table.select(node.alias("node"), F.when(F.col("parent_id").isNotNull(), F.concat_ws(":", "trace_id", "parent_id")).alias("parent"), (F.col("kind") != "structural").alias("economic"))
    event = F.concat(F.lit("otel-event-"), F.sha2(F.concat("trace_id", F.lit("\0"), "span_id"), 256))
    task = F.concat(F.lit("otel-task-"), F.sha2("trace_id", 256))
    is_model = F.col("kind") == "model"
    named = economic.withColumn("node", node).withColumn("event_id", event)
    tokens = [F.when(is_model, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")]
    events = named.select(task.alias("task_id"), "event_id", "timestamp", F.col("kind").alias("event_type"), F.when(is_model, F.col("operation")).otherwise(F.col("tool")).alias("name"), F.when(is_model, F.col("model")).otherwise("").alias("model"), *tokens, "status")
    tasks = table.groupBy("trace_id").agg(F.min("timestamp").alias("started_at")).select(task.alias("task_id"), F.sha2(F.unhex("trace_id"), 256).alias("input_digest"), "started_at")
    above = graphs.nearest_marked(tree, "node", "parent", "economic").withColumnRenamed("node", "parent")
    ids = named.select(F.col("node").alias("nearest"), F.col("event_id").alias("source_event_id"))
    children = tree.where("economic and parent is not null").join(above, "parent").where("nearest is not null").join(ids, "nearest")
    edges = children.join(named.select("node", F.col("event_id").alias("target_event_id")), "node").select("source_event_id", "target_event_id").distinct()
    counts = table.agg(F.count("*").alias("span_count"), F.count_if(F.col("kind") == "structural").alias("structural_span_count"), F.count_distinct("trace_id").alias("task_count"), F.count_if(is_model).alias("model_call_count"), F.count_if(F.col("kind") == "tool").alias("tool_call_count"), F.sort_array(F.collect_set("scope")).alias("scopes"), F.sort_array(F.collect_set(F.when(is_model, F.col("model")))).alias("models"), F.sort_array(F.collect_set(F.when(F.col("kind") == "tool", F.col("tool")))).alias("tools")).first().asDict()
    cache = [F.when(is_model, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(f"{c}_input_tokens") for c in ("cache_read", "cache_creation")]
    listed = named.select("event_id", task.alias("task_id"), "timestamp", "scope", "operation", F.col("kind").alias("event_type"), F.when(is_model, F.col("model")).otherwise("").alias("model"), F.when(is_model, F.lit("")).otherwise(F.col("tool")).alias("tool_name"), "provider", *tokens, *cache, "status")
    links = [list(r) for r in edges.orderBy("source_event_id", "target_event_id").toLocalIterator()]
    summary = {
        "semconv_version": CONVENTIONS["semantic_conventions_version"],
        "semconv_genai_commit": CONVENTIONS["semantic_conventions_genai_commit"],
        "span_count": counts["span_count"],
        "structural_span_count": counts["structural_span_count"],
        "tasks": [{"task_id": r["task_id"], "trace_id_sha256": r["input_digest"], "started_at": r["started_at"]} for r in table.groupBy("trace_id").agg(F.min("timestamp").alias("started_at")).orderBy("trace_id").select(task.alias("task_id"), F.sha2(F.unhex("trace_id"), 256).alias("input_digest"), "started_at").toLocalIterator()],
        "economic_spans": [r.asDict() for r in listed.orderBy("task_id", "timestamp", "event_id").toLocalIterator()],
        "dependency_edges": links,
    }
    raw = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).orderBy("h").collect()]
    inventory = counts | {"dependency_edge_count": len(links), "raw_sha256": raw[0] if len(raw) == 1 else sha256(canonical_json(raw)), "inventory_sha256": sha256(canonical_json(summary))}
    return Traces(events, tasks, edges, inventory)
