"""Cluster documents and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS
from fleetvitals.plans.lineage import cut_lineage

SCHEMA_VERSION = 3

# Top-level members of a cluster document: (name, is it a list).
MEMBERS = [
    ("schemaVersion", False), ("project", False), ("reportVersion", False), ("inspectionDate", False),
    ("reportDate", False), ("cluster", False), ("healthScore", False), ("overallAssessment", False),
    ("issues", True), ("correlations", True), ("paramJudgments", True), ("backupAssessment", False),
    ("securityAssessment", False), ("nodes", True), ("recommendations", True), ("hcConfig", False),
    ("disabledRulesApplied", False),
]


# Members whose value in a document is this one column, not an object.
PLAIN = {
    "schemaVersion": "value", "project": "value", "reportVersion": "value", "inspectionDate": "value", "reportDate": "value",
    "overallAssessment": "label", "disabledRulesApplied": "value",
}
# The part whose rows are the addresses that the document lists inside its member "cluster".
ADDRESSES = "cluster.ips"
HORIZONS = ("immediate", "short_term", "mid_term", "long_term")
# By which column the items of a list member stand in the document; items of equal value by their text.
ITEM_ORDER = {"issues": "seq", "nodes": "node_order", "correlations": "code", "paramJudgments": "name", ADDRESSES: "node_order"}


def document_parts(members: dict[str, DataFrame], cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Every member of every cluster's document: (cluster, member, json, position), list members one row per item.

    A document stays in parts because a cluster may hold a third of all
    nodes; its parts are written by many tasks and read back by cluster.
    position is the item's place as a sortable text, null for other members.
    """

    def part(name: str, df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns if c not in cluster_keys]
        body = F.to_json(F.struct(*columns))
        by = ITEM_ORDER.get(name)
        place = F.lit(None) if by not in df.columns else F.lpad(by, 19, "0") if dict(df.dtypes)[by] in ("int", "bigint") else F.col(by)
        return df.select(*cluster_keys, F.lit(name).alias("member"), body.alias("json"), place.cast("string").alias("position"))

    return reduce(DataFrame.unionByName, [part(name, df) for name, df in members.items()])


def cluster_documents(parts: DataFrame, slice_items: int = 1000, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Every cluster's document as rows of bounded size: (cluster, member, chunk_no, n_items, json).

    json is the member's value, or for a list member an array of about
    slice_items of its items; the arrays of all its chunks together are the
    list. A cluster of any size keeps every item, and no task holds more than a
    slice. Members without items have one chunk: null, or an empty array.
    """
    sizes = parts.groupBy(*cluster_keys, "member").agg(F.ceil(F.count(F.lit(1)) / slice_items).alias("_chunks"))
    by_chunk = parts.join(sizes, [*cluster_keys, "member"]).withColumn("chunk_no", F.pmod(F.xxhash64("json"), "_chunks"))
    chunks = by_chunk.groupBy(*cluster_keys, "member", "chunk_no").agg(F.array_sort(F.collect_list("json")).alias("items"))
    names = F.array(*[F.struct(F.lit(n).alias("member"), F.lit(is_list).alias("is_list")) for n, is_list in MEMBERS])
    expected = parts.select(*cluster_keys).distinct().select(*cluster_keys, F.explode(names).alias("m")).select(*cluster_keys, "m.*")
    listed = F.concat(F.lit("["), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), F.lit("]"))
    return expected.join(chunks, [*cluster_keys, "member"], "left").select(
        *cluster_keys,
        "member",
        F.coalesce("chunk_no", F.lit(0)).cast("bigint").alias("chunk_no"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.when(F.col("is_list"), listed).otherwise(F.coalesce(F.get("items", F.lit(0)), F.lit("null"))).alias("json"),
    )


def _plain_json(json: Column, field: str) -> Column:
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant")), F.lit("null"))


def _value() -> Column:
    """A part's value as it stands in the document."""
    value = F.col("json")
    for name, field in (*PLAIN.items(), (ADDRESSES, "node_ip"), ("recommendations", "text")):
        value = F.when(F.col("member") == name, _plain_json(F.col("json"), field)).otherwise(value)
    return value


def _slot_of() -> Column:
    horizon = F.get_json_object("json", "$.horizon")
    return F.when(F.col("member") == "recommendations", F.concat(F.lit("recommendations."), horizon)).otherwise(F.col("member"))


@dataclass(frozen=True)
class Slot:
    """A place in the text of a document: what stands around the rows of one part, and what stands for none."""

    member: str
    is_list: bool
    before: str
    after: str
    default: str = "null"


def _slots() -> list[Slot]:
    out = []
    for name, is_list in MEMBERS:
        if name == "cluster":
            # The object stays open for its addresses.
            out.append(Slot(name, False, f'"{name}":', "", '{"name":null'))
            out.append(Slot(ADDRESSES, True, ',"ips":[', "]}"))
        elif name == "recommendations":
            # An object with a list of texts per horizon.
            for i, h in enumerate(HORIZONS):
                out.append(Slot(f"{name}.{h}", True, (f'"{name}":{{' if i == 0 else ",") + f'"{h}":[', "]}" if h == HORIZONS[-1] else "]"))
        elif is_list:
            out.append(Slot(name, True, f'"{name}":[', "]"))
        else:
            out.append(Slot(name, False, f'"{name}":', ""))
    last = len(out) - 1
    open_ones = {"cluster", *(f"recommendations.{h}" for h in HORIZONS[:-1])}
    inside = {i for i, s in enumerate(out) if i < last and s.member not in open_ones}  # followed by a comma
    return [
        Slot(s.member, s.is_list, ("{" if i == 0 else "") + s.before, s.after + ("}" if i == last else "," if i in inside else ""), s.default)
        for i, s in enumerate(out)
    ]


def document_lines(parts: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Every cluster's document as the lines of one JSON text: (cluster, line), in order within each task.

    A member is a line or a few; a list member one line an item. All lines of a
    cluster lie in one partition, sorted; they pass through its task one by one
    (the sort spills), so a document may be larger than any row or an
    executor's memory. Members without parts are null, lists empty; of several
    parts of a single member the first by its text counts.
    """
    slots = _slots()
    no = {s.member: i for i, s in enumerate(slots)}
    frame = [(i, step, text) for i, s in enumerate(slots) for step, text in ((0, s.before), (3, s.after))]
    frame += [(i, 2, s.default) for i, s in enumerate(slots) if not s.is_list]
    structs = [F.struct(F.lit(i).alias("slot"), F.lit(step).alias("step"), F.lit(text).alias("text")) for i, step, text in frame]
    around = (
        parts.select(*cluster_keys).distinct().select(*cluster_keys, F.explode(F.array(*structs)).alias("f"))
        .select(*cluster_keys, "f.slot", "f.step", F.lit(None).cast("string").alias("position"), "f.text")
    )
    member = F.col("member")
    # The cluster's object stays open, without its last brace.
    value = F.when(member == "cluster", F.regexp_replace("json", r"\}$", "")).otherwise(_value())
    numbers = F.create_map(*[F.lit(x) for pair in no.items() for x in pair])
    given = parts.select(
        *cluster_keys, numbers[_slot_of()].alias("slot"), F.lit(1).alias("step"), "position", value.alias("text")
    ).where("slot IS NOT NULL")
    ordered = Window.partitionBy(*cluster_keys).orderBy("slot", "step", F.col("position").asc_nulls_first(), "text")
    follows = F.lag("step", 1, 0).over(ordered) == 1  # a value of the same slot, as every slot opens with step 0
    in_list = F.col("slot").isin([i for i, s in enumerate(slots) if s.is_list])
    line = (
        F.when(~follows | (F.col("step") == 3), F.col("text"))
        .when((F.col("step") == 1) & in_list, F.concat(F.lit(","), F.col("text")))
    )
    return around.unionByName(given).select(*cluster_keys, line.alias("line")).where("line IS NOT NULL")


# What a document must hold: path, kind, required, minimum length.
DOCUMENT_FIELDS = [
    ("project", "string", True, 0), ("reportVersion", "string", False, 0), ("inspectionDate", "string", True, 0),
    ("reportDate", "string", True, 0), ("cluster.topology", "string", True, 0), ("cluster.nodeCount", "number", True, 0),
    ("cluster.ips", "array", True, 1), ("healthScore", "object", False, 0), ("overallAssessment", "string", True, 0),
    ("issues", "array", True, 0), ("correlations", "array", False, 0), ("paramJudgments", "array", False, 0),
    ("backupAssessment", "object", False, 0), ("securityAssessment", "object", False, 0), ("nodes", "array", True, 1),
    ("recommendations", "object", False, 0),
]
NODE_FIELDS = [("ip", "string", True), ("role", "string", True), ("hostname", "string", False)]
PRIORITY_TEXT = r"^P[0-3]$"
VERSION_TEXT = r"^\d+\.\d+"


def _kind(value: Column) -> Column:
    """Kind of a VARIANT: number, string, boolean, array, object or null; null for a value that is not there."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.isNotNull(), "number")
    )


def read_documents(spark: SparkSession, path: str, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Written documents, one row each: (keys, json). keys are the folders they lie in."""
    return spark.read.text(path, wholetext=True).select(*keys, F.col("value").alias("json"))


def _variant(json: Column) -> Column:
    return F.try_parse_json(json)


def whole_members(documents: DataFrame, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """(keys, member, value VARIANT) of whole documents (keys, json); none of a text that is no object."""
    parsed = documents.select(*keys, _variant(F.col("json")).alias("doc")).where(_kind(F.col("doc")) == "object")
    named = F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))
    return parsed.select(*keys, F.explode(named).alias("m")).select(*keys, F.col("m.key").alias("member"), F.col("m.value").alias("value"))


def part_members(parts: DataFrame, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """(keys, member, value VARIANT) of documents in parts, as document_lines would write them; each item of a list is a row.

    So a document of any size can be validated. List members that have no part
    are empty lists, other members null.
    """
    member, value = F.col("member"), _value()
    lists = [n for n, is_list in MEMBERS if is_list and n != "recommendations"]
    text = (
        F.when(member == ADDRESSES, F.concat(F.lit('{"ips":['), value, F.lit("]}")))
        .when(member == "recommendations", F.concat(F.lit('{"'), F.get_json_object("json", "$.horizon"), F.lit('":['), value, F.lit("]}")))
        .when(member.isin(lists), F.concat(F.lit("["), value, F.lit("]")))
        .otherwise(value)
    )
    owner = F.when(member == ADDRESSES, "cluster").otherwise(member)
    empty = [*((n, "[]") for n in lists), ("recommendations", "{}"), ("cluster", '{"ips":[]}')]
    around = F.array(*[F.struct(F.lit(n).alias("member"), F.lit(t).alias("json")) for n, t in empty])
    always = parts.select(*keys).distinct().select(*keys, F.explode(around).alias("e")).select(*keys, "e.*")
    given = parts.select(*keys, owner.alias("member"), text.alias("json")).unionByName(always)
    return given.select(*keys, "member", _variant(F.col("json")).alias("value"))


def _finding(level, path, message) -> Column:
    def text(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(text(level).alias("level"), text(path).alias("path"), text(message).alias("message"))


def _checked(kind: Column, wanted: Column, required: Column, path: Column) -> Column:
    """The finding on one value of a kind; null where there is none."""
    missing = kind.isNull() | (kind == "null")
    return F.when(missing & required, _finding("ERROR", path, "missing")).when(
        ~missing & (kind != wanted), _finding("ERROR", path, F.concat(F.lit("not of kind "), wanted, F.lit(": "), kind))
    )


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def validate_members(members: DataFrame, documents: DataFrame, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Findings (keys, level, path, message, n) on documents given as members: (keys, member, value VARIANT).

    documents: the keys of all documents, so one without a single member is
    judged too. Paths of DOCUMENT_FIELDS are looked up in the members' values,
    whatever columns or members exist. A list member may come in several rows;
    its length is their sum. n counts the items a finding holds for.
    """
    fields = F.array(*[
        F.struct(
            F.lit(path).alias("path"), F.lit(path.partition(".")[0]).alias("member"),
            F.lit("$" + path[len(path.partition(".")[0]) :]).alias("inside"),
            F.lit(kind).alias("kind"), F.lit(required).alias("required"), F.lit(least).alias("least"),
        )
        for path, kind, required, least in DOCUMENT_FIELDS
    ])
    looked_up = (
        members.select(*keys, "value", F.explode(F.filter(fields, lambda f: f["member"] == F.col("member"))).alias("f"))
        .select(*keys, F.col("f.path").alias("path"), F.col("f.kind").alias("wanted"), F.try_variant_get("value", F.col("f.inside"), "variant").alias("found"))
        .select(*keys, "path", "wanted", _kind(F.col("found")).alias("kind"), F.size(F.try_variant_get("found", "$", "array<variant>")).alias("length"))
        .where("kind IS NOT NULL")
    )
    # Of several rows one of a wrong kind counts, whatever the others are.
    wrong = F.when((F.col("kind") != F.col("wanted")) & (F.col("kind") != "null"), F.col("kind"))
    held = looked_up.groupBy(*keys, "path").agg(
        F.coalesce(F.min(wrong), F.max(F.nullif("kind", F.lit("null")))).alias("kind"), F.sum("length").alias("length")
    )
    every = documents.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.path", F.col("f.kind").alias("wanted"), "f.required", "f.least")
    judged = every.join(held, [*keys, "path"], "left")
    short = (F.col("kind") == F.col("wanted")) & (F.col("length") < F.col("least"))
    on_fields = judged.select(
        *keys,
        F.coalesce(
            _checked(F.col("kind"), F.col("wanted"), F.col("required"), F.col("path")),
            F.when(short, _finding("ERROR", F.col("path"), "too short")),
        ).alias("r"),
    )
    singles = documents.join(
        members.where(F.col("member").isin("schemaVersion", "collectorVersion"))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("member") == m, _text(F.col("value")))).alias(m) for m in ("schemaVersion", "collectorVersion")]),
        keys, "left",
    )
    version = F.col("schemaVersion").try_cast("double")
    on_versions = singles.select(*keys, F.explode(F.array(
        F.when(F.col("schemaVersion").isNull(), _finding("WARN", "schemaVersion", "missing"))
        .when(version > SCHEMA_VERSION, _finding("WARN", "schemaVersion", "newer than supported"))
        .when(version < SCHEMA_VERSION, _finding("WARN", "schemaVersion", "older than current")),
        F.when((F.col("collectorVersion") != "") & ~F.col("collectorVersion").rlike(VERSION_TEXT), _finding("WARN", "collectorVersion", "not a version")),
    )).alias("r"))
    items = members.where(F.col("member").isin("nodes", "issues")).select(
        *keys, "member", F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("item")
    )

    def inner(name: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", "variant")

    of_node = F.array(*[_checked(_kind(inner(n)), F.lit(kind), F.lit(required), F.lit(f"nodes.{n}")) for n, kind, required in NODE_FIELDS])
    priority, description = _text(inner("priority")), _text(inner("description"))
    of_issue = F.array(
        F.when(F.coalesce(priority, F.lit("")) == "", _finding("ERROR", "issues.priority", "missing"))
        .when(~priority.rlike(PRIORITY_TEXT), _finding("WARN", "issues.priority", "not P0-P3")),
        F.when(F.coalesce(description, F.lit("")) == "", _finding("WARN", "issues.description", "missing")),
    )
    on_items = items.select(*keys, F.explode(F.when(F.col("member") == "nodes", of_node).otherwise(of_issue)).alias("r"))
    found = on_fields.unionByName(on_versions).unionByName(on_items).where("r IS NOT NULL").select(*keys, "r.*")
    return found.groupBy(*keys, "level", "path", "message").agg(F.count(F.lit(1)).alias("n"))


def validate_documents(documents: DataFrame, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Findings on whole documents (keys, json). A text that is no JSON object has this one finding."""
    broken = F.coalesce(_kind(_variant(F.col("json"))), F.lit("null")) != "object"
    none = documents.where(broken).select(
        *keys, F.lit("ERROR").alias("level"), F.lit("$").alias("path"), F.lit("not an object").alias("message"), F.lit(1).cast("bigint").alias("n")
    )
    return validate_members(whole_members(documents, keys), documents.where(~broken).select(*keys), keys).unionByName(none)


def validate_parts(parts: DataFrame, keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Findings on documents in parts, of any size. The parts are computed once, as every check reads them."""
    parts = cut_lineage(parts)
    return validate_members(part_members(parts, keys), parts.select(*keys).distinct(), keys)


def _violations(df: DataFrame, checks: list[tuple[Column, str, str, str]], keys: list[str]) -> DataFrame:
    """Rows (keys, level, path, message, n): violations counted per check in one pass."""
    counts = df.groupBy(*keys).agg(*[F.count_if(c).alias(f"v{i}") for i, (c, *_) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"), F.lit(path).alias("path"), F.lit(message).alias("message"), F.col(f"v{i}").alias("n")
            )
            for i, (_, level, path, message) in enumerate(checks)
        ]
    )
    return (
        counts.select(*keys, F.explode(rows).alias("r")).filter("r.n > 0").select(*keys, "r.*")
    )


DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"


def validate(
    headers: DataFrame, issues: DataFrame, nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """Data-quality findings per cluster.

    headers: one row per cluster with schema_version, project, topology,
    n_nodes, overall_assessment; further columns are checked where the table
    has them: inspection_date, report_date (texts), node_count, node_ips
    (array), health_total, and for each list member (issues, correlations,
    param_judgments, recommendations) has_<member>, whether it is there.
    """
    version = F.col("schema_version")
    header_checks: list[tuple[Column, str, str, str]] = [
        (version.isNull(), "WARN", "schemaVersion", "missing"),
        (version > SCHEMA_VERSION, "WARN", "schemaVersion", "newer than supported"),
        (version < SCHEMA_VERSION, "WARN", "schemaVersion", "older than current"),
        (F.col("project").isNull(), "ERROR", "project", "missing"),
        (F.col("topology").isNull(), "ERROR", "cluster.topology", "missing"),
        (F.coalesce("n_nodes", F.lit(0)) < 1, "ERROR", "nodes", "too short"),
        (F.col("overall_assessment").isNull(), "ERROR", "overallAssessment", "missing"),
    ]
    have = set(headers.columns)
    for column, path in (("inspection_date", "inspectionDate"), ("report_date", "reportDate")):
        if column in have:
            header_checks += [
                (F.col(column).isNull(), "ERROR", path, "missing"),
                (~F.col(column).rlike(DATE_TEXT), "ERROR", path, "not a date"),
            ]
    if "node_count" in have:
        header_checks += [
            (F.col("node_count").isNull(), "ERROR", "cluster.nodeCount", "missing"),
            (F.col("node_count") != F.col("n_nodes"), "ERROR", "cluster.nodeCount", "not the number of nodes"),
        ]
    if "node_ips" in have:
        header_checks.append((F.coalesce(F.size("node_ips"), F.lit(0)) < 1, "ERROR", "cluster.ips", "too short"))
    if "health_total" in have:
        header_checks += [
            (F.col("health_total").isNull(), "ERROR", "healthScore.total", "missing"),
            (~F.col("health_total").between(0, 100), "ERROR", "healthScore.total", "not within 0 and 100"),
        ]
    for member, path in (
        ("issues", "issues"), ("correlations", "correlations"), ("param_judgments", "paramJudgments"), ("recommendations", "recommendations"),
    ):
        if f"has_{member}" in have:
            header_checks.append((~F.coalesce(f"has_{member}", F.lit(False)), "ERROR", path, "missing"))
    issue_checks: list[tuple[Column, str, str, str]] = [
        (F.col("priority").isNull(), "ERROR", "issues.priority", "missing"),
        (~F.col("priority").rlike("^P[0-3]$"), "WARN", "issues.priority", "not P0-P3"),
        (F.coalesce("description", F.lit("")) == "", "WARN", "issues.description", "missing"),
    ]
    if "type" in issues.columns:
        issue_checks.append((F.coalesce("type", F.lit("")) == "", "WARN", "issues.type", "missing"))
    node_checks: list[tuple[Column, str, str, str]] = [
        (F.col("node_ip").isNull(), "ERROR", "nodes.ip", "missing"),
        (F.col("role").isNull(), "ERROR", "nodes.role", "missing"),
    ]
    if "hostname" in nodes.columns:
        node_checks.append((F.col("hostname").isNull(), "WARN", "nodes.hostname", "missing"))
    found = [
        _violations(headers, header_checks, cluster_keys),
        _violations(issues, issue_checks, cluster_keys),
        _violations(nodes, node_checks, cluster_keys),
    ]
    return reduce(DataFrame.unionByName, found)
