"""Imports, calls and assignments as fact tables: classification by rule-table joins, taint by a closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.helpers.bytes import SOURCE
from artifactgate.sources.shared import written


def classified_imports(facts: DataFrame, danger: DataFrame | None = None, safe: list[str] | None = None) -> DataFrame:
    """(module, name, severity, category) of the distinct (module, name) that are not known to be safe.

    The whole name goes before the module, and the module before its nearest parent.
    """
    spark = facts.sparkSession
    danger = spark.createDataFrame(rules.DANGEROUS_IMPORTS, "prefix string, severity int, category string") if danger is None else danger
    safe = rules.SAFE_IMPORT_PREFIXES if safe is None else safe
    full = F.concat_ws(".", "module", F.when(F.col("name") != "", F.col("name")))
    names = facts.select("module", "name").distinct().withColumn("full", full)
    parts = F.split("module", r"\.")
    parents = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    tried = names.select("module", "name", "full", F.posexplode(F.concat(F.array("full"), parents)).alias("order", "prefix"))
    hits = tried.join(F.broadcast(danger), "prefix").groupBy("module", "name").agg(F.min(F.struct("order", "severity", "category")).alias("hit"))
    starts = F.lit(False)
    for p in safe:
        starts = starts | F.startswith("full", F.lit(p)) | F.startswith("module", F.lit(p))
    joined = names.join(hits, ["module", "name"], "left").where(F.col("hit").isNotNull() | ~starts)
    hint = F.lower("full").rlike(rules.HINTS)
    return joined.select("module", "name", F.coalesce("hit.severity", F.when(hint, rules.MEDIUM).otherwise(rules.LOW)).alias("severity"), F.coalesce("hit.category", F.lit("unknown-import")).alias("category"))


def import_findings(facts: DataFrame) -> DataFrame:
    """(file, module, name, severity, category, invoked) of (file, module, name, calls)."""
    kinds = classified_imports(facts)
    calls = facts.groupBy("file").agg((F.sum("calls") > 0).alias("invoked"))
    return facts.select("file", "module", "name").distinct().join(kinds, ["module", "name"]).join(calls, "file").select("file", "module", "name", "severity", "category", "invoked")


def gadget_findings(facts: DataFrame) -> DataFrame:
    """(file, rule_id, severity): pivots that are called, many imports with many calls, deep imports."""
    full = F.concat_ws(".", "module", "name")
    sums = facts.groupBy("file").agg(F.bool_or(full.isin(rules.PIVOTS)).alias("pivot"), F.sum("gadget_calls").alias("calls"), F.countDistinct("module", "name").alias("imports"), F.max(F.size(F.split(full, r"\.")) - 1).alias("dots"))
    said = F.array_compact(
        F.array(
            F.when(F.col("pivot") & (F.col("calls") > 0), F.struct(F.lit("DEEP_GADGET_PIVOT").alias("rule_id"), F.lit(rules.HIGH).alias("severity"))),
            F.when((F.col("imports") >= 8) & (F.col("calls") >= 8), F.struct(F.lit("DEEP_GADGET_CHAIN").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity"))),
            F.when(F.col("dots") >= 4, F.struct(F.lit("DEEP_GADGET_DEEP_IMPORT").alias("rule_id"), F.lit(rules.LOW).alias("severity"))),
        )
    )
    return sums.select("file", F.explode(said).alias("f")).select("file", "f.*")


def call_kind(call: Column) -> Column:
    """struct<severity, category> of a dotted name: by the whole name, then by its beginning; decoders by themselves; null for any other."""
    kind = lambda severity, category: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))
    known = F.create_map(*(x for name, severity, category in rules.PYTHON_CALLS for x in (F.lit(name), kind(severity, category))))
    out = F.when(call.isin(rules.DECODERS), kind(rules.LOW, "obfuscation"))
    for prefix, severity, category in reversed(rules.PYTHON_CALL_PREFIXES):
        out = F.when(F.startswith(call, F.lit(prefix)), kind(severity, category)).otherwise(out)
    return F.coalesce(F.try_element_at(known, call), out)


def call_findings(calls: DataFrame) -> DataFrame:
    """(file, call, line, severity, category, on_import), distinct by file, call and line; decoders only where the file also evaluates code."""
    known = calls.withColumn("kind", call_kind(F.col("call"))).where("kind IS NOT NULL")
    evaluating = calls.where(F.col("call").isin("eval", "exec")).select("file").distinct().withColumn("evaluates", F.lit(True))
    found = known.groupBy("file", "call", "line", "kind").agg(F.bool_or("on_import").alias("on_import")).join(evaluating, "file", "left")
    decoder = F.col("kind.category") == "obfuscation"
    return found.where(~decoder | F.col("evaluates")).select("file", "call", "line", F.when(decoder, rules.HIGH).otherwise(F.col("kind.severity")).alias("severity"), F.col("kind.category").alias("category"), "on_import")


def environment_findings(facts: DataFrame) -> DataFrame:
    """(file, rule_id, severity, line): sources that read the process environment, at the last line that does."""
    used = facts.where("fact = 'attribute' AND name = 'os.environ'").groupBy("file").agg(F.max("line").alias("line"))
    return used.select("file", F.lit("PY_ENV_HARVEST").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity"), "line")


def _closure(known: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``known`` with all that its rows reach over ``edges`` (key, src, dst), name by name; the values beside the name go along.

    Each round goes one edge further from what the last one has added; rounds
    end when there is nothing new, so that chains may be of any length.
    """
    new = known = written(known, "known")
    step_of = written(edges.select(*key, F.col("src").alias("name"), "dst").distinct(), "edges")
    values = [c for c in known.columns if c not in (*key, "name")]
    while True:
        step = new.join(step_of, [*key, "name"]).select(*key, F.col("dst").alias("name"), *values)
        step = step.groupBy(*key, "name").agg(*(F.max(v).alias(v) for v in values)) if values else step.distinct()
        new = written(step.join(known.select(*key, "name"), [*key, "name"], "left_anti"), "new")
        if new.isEmpty():
            return known
        known = written(known.unionByName(new), "known")


def tainted(assigns: DataFrame) -> DataFrame:
    """(file, scope, name): names reached from a source over (file, scope, dst, src, is_source) assignments, scope by scope."""
    known = assigns.where("is_source").select("file", "scope", F.col("dst").alias("name")).distinct()
    return _closure(known, assigns.select("file", "scope", "src", "dst"), ["file", "scope"])


def tainted_flows(assigns: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, scope, call, line, arg): sinks that take a tainted name."""
    sinks = calls.where(call_kind(F.col("call"))["category"].isin(rules.SINKS))
    return sinks.join(tainted(assigns).withColumnRenamed("name", "arg"), ["file", "scope", "arg"], "left_semi").select("file", "scope", "call", "line", "arg").distinct()


def flow_findings(facts: DataFrame) -> DataFrame:
    """(file, rule_id, name, severity, category, line, on_import): decoded data that reaches a sink, and callables under another name.

    facts: (file, fact, scope, name, line, on_import, arg), as ``source_facts``
    gives them. A name is tainted if its value uses decoded data or a tainted
    name. A name is a callable if it is bound to a sink, to a callable, or to
    what getattr finds under a tainted name.
    """
    key = ["file", "scope"]
    assigns = facts.where("fact = 'assign'").select(*key, F.col("name").alias("dst"), F.col("arg").alias("src"), (F.col("arg") == SOURCE).alias("is_source"))
    taint = tainted(assigns).withColumnRenamed("name", "arg")
    taint = written(taint.unionByName(facts.select(*key).distinct().withColumn("arg", F.lit(SOURCE))), "taint")
    kind = call_kind(F.col("arg"))
    bound = facts.where("fact = 'alias'").select(*key, "name", "arg")
    direct = bound.where(kind["category"].isin(rules.SINKS)).select(*key, "name", F.when(F.col("arg") == "compile", rules.CRITICAL).otherwise(kind["severity"]).alias("severity"), kind["category"].alias("category"))
    resolved = facts.where("fact = 'resolve'").join(taint, [*key, "arg"], "left_semi").select(*key, "name", F.lit(rules.CRITICAL).alias("severity"), F.lit("indirection").alias("category"))
    first = direct.unionByName(resolved).groupBy(*key, "name").agg(F.max(F.struct("severity", "category")).alias("kind"))
    callables = _closure(first, bound.select(*key, F.col("arg").alias("src"), F.col("name").alias("dst")), key)
    calls = facts.where("fact = 'call'").select(*key, "name", "line", "on_import", "arg")
    renamed = calls.join(callables, [*key, "name"]).select("file", F.lit("PY_DYNAMIC_CALL").alias("rule_id"), "name", F.col("kind.severity").alias("severity"), F.col("kind.category").alias("category"), "line", "on_import")
    invoked = facts.where("fact = 'invoke'").join(taint, [*key, "arg"], "left_semi").select("file", F.lit("PY_DYNAMIC_CALL").alias("rule_id"), "name", F.lit(rules.CRITICAL).alias("severity"), F.lit("indirection").alias("category"), "line", "on_import")
    own = call_kind(F.col("name"))["category"]
    flows = calls.where(own.isin(rules.SINKS)).join(taint, [*key, "arg"], "left_semi").join(callables.select(*key, "name"), [*key, "name"], "left_anti")
    flows = flows.select("file", F.lit("PY_TAINTED_FLOW").alias("rule_id"), "name", F.lit(rules.CRITICAL).alias("severity"), own.alias("category"), "line", "on_import")
    every = renamed.unionByName(invoked).unionByName(flows)
    return every.groupBy("file", "rule_id", "name", "line").agg(F.max(F.struct("severity", "category")).alias("k"), F.bool_or("on_import").alias("on_import")).select("file", "rule_id", "name", "k.severity", "k.category", "line", "on_import")
