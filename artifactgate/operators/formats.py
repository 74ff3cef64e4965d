"""Formats by first bytes, and rules of single formats, as column expressions and rule-table joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.functions import text as fn
from artifactgate.helpers.archives import small_members
from artifactgate.helpers.bytes import json_facts, whole_pickles, xml_values, yaml_facts
from artifactgate.operators.facts import classified_imports


def _starts(content: Column, digits: str, at: int = 1) -> Column:
    return F.substring(content, at, len(digits) // 2) == F.unhex(F.lit(digits))


def extension(path: Column) -> Column:
    """The last extension with its dot, lower-case; empty for none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_strong_pickle(content: Column) -> Column:
    """Protocol 2 to 5: the PROTO opcode and its version."""
    return _starts(content, "80") & F.hex(F.substring(content, 2, 1)).isin("02", "03", "04", "05")


def is_safetensors_head(content: Column) -> Column:
    """A little-endian length from 1 to 500,000,000 in 8 bytes, then a brace or a space."""
    digits = F.hex(F.substring(content, 1, 9))
    low = F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)))
    return (F.substring(digits, 9, 8) == "00000000") & (low > "00000000") & (low <= "1DCD6500") & F.substring(digits, 17, 2).isin("7B", "20")


def is_loose_pickle(content: Column) -> Column:
    """A strong head, or one of the opcodes that a pickle without a protocol begins with."""
    return is_strong_pickle(content) | F.hex(F.substring(content, 1, 1)).isin("28", "5D", "7D", "63", "8C", "29")


def zip_kind(ext: Column) -> Column:
    return F.when(ext == ".pt2", "pt2").when(ext == ".mar", "mar").when(ext == ".skops", "skops").when(ext == ".keras", "keras_v3").when(ext == ".npz", "numpy").otherwise("archive")


def text_kind(ext: Column, name: Column, head: Column) -> Column:
    """Formats that are text: by what the first 8 KiB hold."""
    json = F.when(F.contains(head, F.lit('"weightsManifest"')), "tfjs").when(F.contains(F.lower(name), F.lit("config")), "hf_config").otherwise("unknown")
    return F.when(ext == ".json", json).when(F.contains(head, F.lit("<PMML")), "pmml").when(F.contains(head, F.lit("<?xml")) & F.contains(head, F.lit("<net")), "openvino").otherwise("unknown")


def detect(path: Column, content: Column) -> Column:
    """The format; first bytes go before the extension, in this order."""
    ext, name = extension(path), F.element_at(F.split(path, "/"), -1)
    head = fn.latin1(F.substring(content, 1, 8192))
    steps = [
        (name == "MLmodel", F.lit("mlflow")),
        (_starts(content, "747265650A76657273696F6E3D") | (ext == ".lgb"), F.lit("lightgbm")),
        (_starts(content, "894844460D0A1A0A"), F.lit("keras_h5")),
        (_starts(content, "47475546"), F.lit("gguf")),
        (F.hex(F.substring(content, 1, 4)).isin("6C6D6767", "666D6767", "746A6767", "616C6767", "67676D6C") | (ext == ".ggml"), F.lit("ggml")),
        (_starts(content, "934E554D5059"), F.lit("numpy")),
        (_starts(content, "54464C33", 5), F.lit("tflite")),
        (_starts(content, "504B0304"), zip_kind(ext)),
        (is_strong_pickle(content) & (ext != ".safetensors") & ~is_safetensors_head(content), F.when(ext == ".joblib", "joblib").otherwise("pickle")),
        (ext == ".safetensors", F.lit("safetensors")),
        (ext == ".py", F.lit("python_source")),
        (ext.isin(".json", ".xml", ".pmml"), text_kind(ext, name, head)),
        *((ext.isin(*exts), F.lit(kind)) for kind, exts in rules.BY_EXTENSION),
        (is_safetensors_head(content) & ext.isin("", ".bin"), F.lit("safetensors")),
        (is_loose_pickle(content), F.when(ext == ".joblib", "joblib").otherwise("pickle")),
        (ext.isin(*rules.STRICT_PICKLE), F.lit("pickle")),
    ]
    out = F.lit("unknown")
    for test, value in reversed(steps):
        out = F.when(test, value).otherwise(out)
    return out


#: Extension and format of files whose real first bytes can't begin a pickle, and bytes up to which one is read through.
STRUCTURED = {".onnx": "onnx", ".pb": "tf_savedmodel", ".tflite": "tflite", ".pte": "executorch", ".pdmodel": "paddle"}
MOST_TRIED = 4_000_000


def disguised_files(artifacts: DataFrame) -> DataFrame:
    """(target_id, path, claimed, format) of files of a structured format by name that are something else.

    A pickle without a protocol has no first bytes of its own: a file that begins like one is read through as opcodes.
    """
    content, ext = F.col("content"), extension(F.col("path"))
    rows = artifacts.where(ext.isin(*STRUCTURED)).select("target_id", "path", "content", ext.alias("claimed"))
    # Exploded, so that the filter does not repeat the whole detection.
    found = rows.select("target_id", "path", "claimed", F.explode(F.array(detect(F.col("path"), content))).alias("format"))
    tried = whole_pickles(rows.where(is_loose_pickle(content) & (F.length(content) <= MOST_TRIED))).withColumn("pickled", F.lit(True))
    want = F.create_map(*(F.lit(x) for kv in STRUCTURED.items() for x in kv))
    # First bytes that tell a format go before what reads as a pickle.
    own = F.when(F.col("pickled") & (F.col("format") == F.element_at(want, F.col("claimed"))), F.lit("pickle")).otherwise(F.col("format"))
    return found.join(tried, ["target_id", "path"], "left").select("target_id", "path", "claimed", own.alias("format")).where(F.element_at(want, F.col("claimed")) != F.col("format"))


def carries_magic(content: Column) -> Column:
    """First bytes of a scannable binary format."""
    return (
        _starts(content, "894844460D0A1A0A") | _starts(content, "47475546") | F.hex(F.substring(content, 1, 4)).isin("6C6D6767", "666D6767", "746A6767", "616C6767", "67676D6C")
        | _starts(content, "934E554D5059") | _starts(content, "504B0304") | _starts(content, "54464C33", 5) | is_strong_pickle(content)
    )


#: Parts of a path that a walk passes over, and extensions of documents and configuration.
SKIPPED_PARTS = [".git", ".DS_Store", "__pycache__", ".cache"]
DOCUMENT_EXTENSIONS = [".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".cfg", ".gitattributes", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".license"]


def scannable(path: Column, content: Column) -> Column:
    """A walk keeps the file: not in a passed-over folder, and no document unless a model manifest, a configuration, or with model bytes."""
    ext, name = extension(path), F.element_at(F.split(path, "/"), -1)
    kept = (name == "model.json") | ((ext == ".json") & F.contains(F.lower(name), F.lit("config"))) | carries_magic(F.substring(content, 1, 16))
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_PARTS))) & (~ext.isin(*DOCUMENT_EXTENSIONS) | kept)


def archive_kinds(members: DataFrame) -> DataFrame:
    """(archive, kind) of (archive, member): what the members' names make of an archive."""
    m = F.col("member")
    some = lambda test: F.bool_or(test)
    facts = members.groupBy("archive").agg(
        some((m == "model.ini") | F.endswith(m, F.lit("/model.ini"))).alias("mojo"),
        some(m == "schema.json").alias("skops"),
        some(F.endswith(m, F.lit("data.pkl"))).alias("torch"),
        (some(F.endswith(m, F.lit("config.json"))) & some(F.endswith(m, F.lit("metadata.json")) | F.endswith(m, F.lit("model.weights.h5")))).alias("keras"),
    )
    return facts.select("archive", F.expr("CASE WHEN mojo THEN 'h2o_mojo' WHEN skops THEN 'skops' WHEN torch THEN 'pytorch' WHEN keras THEN 'keras_v3' ELSE 'archive' END").alias("kind"))


def archive_findings(members: DataFrame) -> DataFrame:
    """(archive, member, rule_id, severity): bombs by their sums, and members that leave the archive where there is no bomb."""
    sums = members.groupBy("archive").agg(F.sum("file_size").alias("plain"), F.sum("compress_size").alias("packed"))
    bombs = sums.where("plain > 4294967296 OR (plain > 104857600 AND plain > 200 * greatest(packed, 1))").select("archive")
    out = bombs.select("archive", F.lit(None).cast("string").alias("member"), F.lit("ARCHIVE_BOMB").alias("rule_id"), F.lit(rules.HIGH).alias("severity"))
    escaping = members.where(fn.path_escapes(F.col("member"))).join(bombs, "archive", "left_anti").select("archive", "member", F.lit("ARCHIVE_PATH_TRAVERSAL").alias("rule_id"), F.lit(rules.CRITICAL).alias("severity")).distinct()
    return out.unionByName(escaping)


def marker_findings(artifacts: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(path, rule_id, marker, severity): markers of a format that an artifact of it holds; where ``first_only``, the first by order.

    artifacts: (path, format, text), text in latin-1 where bytes. markers: (format, rule_id, marker, severity, first_only, ord).
    """
    if markers is None:
        markers = artifacts.sparkSession.createDataFrame(rules.MARKERS, "format string, rule_id string, marker string, severity int, first_only boolean, ord int")
    found = artifacts.join(F.broadcast(markers), "format").where(F.contains("text", "marker"))
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("path", "rule_id").orderBy("ord")))
    return ranked.where("NOT first_only OR k = 1").select("path", "rule_id", "marker", "severity")


def python_layers(artifacts: DataFrame) -> DataFrame:
    """(path, rule_id, severity): text networks that declare a layer in Python."""
    return artifacts.where(F.col("text").rlike(rules.CAFFE_PYTHON)).select("path", F.lit("CAFFE_PYTHON_LAYER").alias("rule_id"), F.lit(rules.HIGH).alias("severity"))


def member_findings(members: DataFrame) -> DataFrame:
    """(archive, member, rule_id, severity) of (archive, kind, member): Python that a checkpoint or a served archive brings along, and checkpoints without a pickle."""
    source = F.endswith("member", F.lit(".py"))
    brought = members.where(source & F.col("kind").isin("pytorch", "mar"))
    brought = brought.select("archive", "member", F.when(F.col("kind") == "mar", "MAR_HANDLER_CODE").otherwise("PYTORCH_EMBEDDED_SOURCE").alias("rule_id"), F.lit(rules.HIGH).alias("severity")).distinct()
    bare = members.where("kind = 'pytorch'").groupBy("archive").agg(F.bool_or(F.endswith("member", F.lit(".pkl"))).alias("pickled")).where("NOT pickled")
    return brought.unionByName(bare.select("archive", F.lit(None).cast("string").alias("member"), F.lit("PYTORCH_NO_PICKLE").alias("rule_id"), F.lit(rules.INFO).alias("severity")))


def keras_nodes(objects: DataFrame) -> DataFrame:
    """(path, rule_id, layer, severity) of (path, at, key, value) JSON facts of any depth: Lambda layers, and layers that come with no framework.

    A node that names its module is custom if the module's first part is none of
    a framework's; one that does not, if its class is no built-in one.
    """
    nodes = objects.where(F.col("key").isin("class_name", "module")).groupBy("path", "at").agg(F.max(F.when(F.col("key") == "class_name", F.col("value"))).alias("layer"), F.max(F.when(F.col("key") == "module", F.col("value"))).alias("module")).where("layer IS NOT NULL")
    own = F.when(F.col("module").isNotNull(), F.substring_index("module", ".", 1).isin(rules.KERAS_MODULES)).otherwise(F.col("layer").isin(rules.KERAS_LAYERS))
    rule = F.when(F.col("layer") == "Lambda", F.struct(F.lit("KERAS_LAMBDA_LAYER").alias("rule_id"), F.lit(rules.CRITICAL).alias("severity"))).when(~F.col("layer").isin(rules.KERAS_CONTAINERS) & ~own, F.struct(F.lit("KERAS_CUSTOM_LAYER").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity")))
    return nodes.select("path", "layer", rule.alias("r")).where("r IS NOT NULL").select("path", "r.rule_id", "layer", "r.severity").distinct()


def schema_types(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (path, at, key, value) JSON facts of skops schemas: the distinct (path, module, name) that loading imports, and (path, rule_id, severity, loader) of nodes that fall back on pickles."""
    own = objects.where(F.col("key").isin("__module__", "__class__", "__loader__"))
    part = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    nodes = own.groupBy("path", "at").agg(part("__module__").alias("module"), F.coalesce(part("__class__"), F.lit("")).alias("name"), part("__loader__").alias("loader"))
    fallback = nodes.where(F.contains(F.lower("loader"), F.lit("pickle"))).select("path", F.lit("SKOPS_PICKLE_FALLBACK").alias("rule_id"), F.lit(rules.HIGH).alias("severity"), "loader")
    return nodes.where("module <> ''").select("path", "module", "name").distinct(), fallback


def flex_ops(artifacts: DataFrame, danger: DataFrame | None = None) -> DataFrame:
    """(path, op, severity): distinct Flex operators of (path, text), by the severity of their base operator."""
    danger = artifacts.sparkSession.createDataFrame(rules.FLEX_OPS, "base string, severity int") if danger is None else danger
    ops = artifacts.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("Flex[A-Z][A-Za-z0-9]{1,48}"), F.lit(0)))).alias("op"))
    return ops.withColumn("base", F.substring("op", 5, 60)).join(F.broadcast(danger), "base", "left").select("path", "op", F.coalesce("severity", F.lit(rules.LOW)).alias("severity"))


def layer_findings(artifacts: DataFrame, builtins: DataFrame | None = None, cap: int = 200) -> DataFrame:
    """(path, layer, rule_id, severity): Lambda layers, and distinct layers that no built-in is called, from class_name entries."""
    builtins = artifacts.sparkSession.createDataFrame([(x,) for x in rules.KERAS_LAYERS + rules.KERAS_CONTAINERS], "layer string") if builtins is None else builtins
    names = artifacts.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r'"class_name":\s*"([A-Za-z0-9_.]{1,80})"'), F.lit(1))).alias("pos", "layer"))
    firsts = names.groupBy("path", "layer").agg(F.min("pos").alias("pos"))
    lambdas = firsts.where("layer = 'Lambda'").select("path", "layer", F.lit("KERAS_LAMBDA_LAYER").alias("rule_id"), F.lit(rules.CRITICAL).alias("severity"))
    custom = firsts.where("layer <> 'Lambda'").join(F.broadcast(builtins), "layer", "left_anti")
    capped = custom.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("k") <= cap)
    return lambdas.unionByName(capped.select("path", "layer", F.lit("KERAS_CUSTOM_LAYER").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity")))


def template_findings(artifacts: DataFrame) -> DataFrame:
    """(path, rule_id, severity, match): chat templates that reach for the object graph, the system or code, where the text has a template."""
    found = [F.regexp_extract("text", pattern, 0) for pattern, _ in rules.TEMPLATE_PATTERNS]
    hit = [F.when(m != "", F.struct(F.lit("GGUF_TEMPLATE_INJECTION").alias("rule_id"), F.lit(severity).alias("severity"), F.substring(m, 1, 160).alias("match"))) for m, (_, severity) in zip(found, rules.TEMPLATE_PATTERNS)]
    return artifacts.where(F.contains("text", F.lit("tokenizer.chat_template"))).select("path", F.explode(F.array_compact(F.array(*hit))).alias("f")).select("path", "f.*")


def external_locations(artifacts: DataFrame, cap: int = 10) -> DataFrame:
    """(path, location): distinct escaping locations of external data: the key, a tag byte, a length byte, and so many characters.

    A value is read by its length from where it stands, whatever else it holds, another key included.
    """
    key = F.lit(r"location\x12([\x01-\x7f])(?=([\s\S]{0,127}))")
    both = F.zip_with(F.regexp_extract_all("text", key, F.lit(1)), F.regexp_extract_all("text", key, F.lit(2)), lambda n, rest: F.struct(n.alias("n"), rest.alias("rest")))
    raw = artifacts.select("path", F.posexplode(both).alias("pos", "m"))
    cut = raw.select("path", "pos", F.expr("substring(m.rest, 1, ascii(m.n))").alias("location")).where(fn.path_escapes(F.col("location")))
    firsts = cut.groupBy("path", "location").agg(F.min("pos").alias("pos"))
    return firsts.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("k") <= cap).select("path", "location")


def header_findings(files: DataFrame) -> DataFrame:
    """(path, rule_id): safetensors whose header length is out of bounds or whose header is no object of tensors.

    files: (path, header_len, size, header), header as text.
    """
    tensors = F.from_json("header", "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>")
    bad_length = (F.col("header_len") < 2) | (F.col("header_len") > 100_000_000) | (F.col("header_len") + 8 > F.col("size"))
    missing = F.exists(F.map_entries(tensors), lambda e: (e["key"] != "__metadata__") & e["value"]["data_offsets"].isNull())
    return files.select("path", F.when(bad_length, "SAFETENSORS_BAD_HEADER").when(tensors.isNull() | (F.size(tensors) == 0) | missing, "SAFETENSORS_MALFORMED").alias("rule_id")).where("rule_id IS NOT NULL")


def tensor_findings(tensors: DataFrame, share: float = 0.01, first: int = 200_000) -> DataFrame:
    """(file, tensor, rule_id): spans that dtype and shape don't give, and more than a share of non-finite values at the head."""
    sizes = F.create_map(*(F.lit(x) for kv in rules.DTYPE_BYTES.items() for x in kv))
    want = F.element_at(sizes, F.col("dtype")) * F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, d: a * d)
    head = F.slice("values", 1, first)
    odd = F.size(F.filter(head, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))) > share * F.size(head)
    hit = F.explode(F.array_compact(F.array(F.when(want != F.col("span"), F.lit("WEIGHTS_SIZE_MISMATCH")), F.when(odd, F.lit("WEIGHTS_NON_FINITE")))))
    return tensors.select("file", "tensor", hit.alias("rule_id"))


#: Configuration keys that arm code of the repository, by severity.
ARMING_KEYS = [("auto_map", rules.HIGH), ("custom_pipelines", rules.MEDIUM), ("trust_remote_code", rules.MEDIUM)]


def config_targets(facts: DataFrame) -> DataFrame:
    """(target_id, path, target) of ``json_facts``: what auto_map entries name at any depth, as ``module.Class``.

    An entry is a text, or a list of texts and nulls; a name with ``--`` is one of another repository.
    """
    n = F.size("steps")
    back = lambda k: F.get("steps", n - 1 - k)
    in_list = F.startswith(back(0), F.lit("["))
    named = (back(0) == ".auto_map") | (back(1) == ".auto_map") | ((back(2) == ".auto_map") & F.startswith(back(1), F.lit(".")) & in_list)
    name = F.col("value")
    return facts.where((F.col("kind") == "string") & named & F.contains(name, F.lit(".")) & ~F.contains(name, F.lit("--"))).select("target_id", "path", name.alias("target")).distinct()


def config_findings(facts: DataFrame, most: int = 20) -> DataFrame:
    """(target_id, path, rule_id, key, severity, targets) of ``json_facts``: keys at any depth that arm code of the repository, with the first ``most`` sorted targets of auto_map."""
    severity = F.create_map(*(F.lit(x) for kv in ARMING_KEYS for x in kv))
    own = F.startswith(F.element_at("steps", -1), F.lit("."))
    found = facts.where((F.col("kind") != "error") & own & F.col("key").isin([k for k, _ in ARMING_KEYS])).select("target_id", "path", "key").distinct()
    targets = config_targets(facts).groupBy("target_id", "path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("target")), 1, most), ",").alias("targets")).withColumn("key", F.lit("auto_map"))
    out = found.join(targets, ["target_id", "path", "key"], "left")
    return out.select("target_id", "path", F.lit("HF_CONFIG_REMOTE_CODE").alias("rule_id"), "key", F.element_at(severity, F.col("key")).alias("severity"), "targets")


def armed_sources(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, path, target, source_path): what a configuration names, and the file of the target that holds it; null where none is bundled.

    files: (target_id, path). A module's file lies beside the configuration, or below it for a dotted module.
    """
    named = config_targets(facts)
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    module = F.translate(F.regexp_extract("target", r"^(.*)\.[^.]*$", 1), ".", "/")
    named = named.withColumn("source_path", F.concat(folder, module, F.lit(".py")))
    own = files.where(F.endswith("path", F.lit(".py"))).select("target_id", F.col("path").alias("source_path"), F.lit(True).alias("bundled")).distinct()
    out = named.join(own, ["target_id", "source_path"], "left")
    return out.select("target_id", "path", "target", F.when(F.col("bundled"), F.col("source_path")).alias("source_path"))


def shard_escapes(manifests: DataFrame) -> DataFrame:
    """(path, shard): shard paths of (path, body) manifests that leave their folder."""
    groups = F.from_json(F.get_json_object("body", "$.weightsManifest"), "array<struct<paths:array<string>>>")
    return manifests.select("path", F.explode(F.flatten(F.transform(groups, lambda g: g["paths"]))).alias("shard")).where(fn.path_escapes(F.col("shard")))


def spoofed_heads(files: DataFrame) -> DataFrame:
    """(path, rule_id): files whose extension promises first bytes that they lack."""
    content, ext = F.col("content"), extension(F.col("path"))
    checks = [((ext == ".tflite") & ~_starts(content, "54464C33", 5), "TFLITE_BAD_MAGIC"), ((ext == ".pte") & ~_starts(content, "4554", 5), "EXECUTORCH_BAD_MAGIC"), ((ext == ".gguf") & ~_starts(content, "47475546"), "GGUF_BAD_MAGIC"), ((ext == ".keras") & ~_starts(content, "504B0304"), "KERAS_NOT_ZIP")]
    out = F.lit(None).cast("string")
    for test, rule in reversed(checks):
        out = F.when(F.coalesce(test, F.lit(True)), rule).otherwise(out)
    return files.select("path", out.alias("rule_id")).where("rule_id IS NOT NULL")


def xml_findings(artifacts: DataFrame, cap: int = 100) -> DataFrame:
    """(path, rule_id, severity, value) of (path, text) XML graphs: entities, texts that are not well-formed, and the first ``cap`` shared libraries and escaping paths among attribute values and texts.

    A document that declares an entity is not parsed.
    """
    declares = F.col("text").rlike(r"<!(?:DOCTYPE|ENTITY)")
    said = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("value"))
    rest = artifacts.where(~declares).select(F.lit(None).cast("string").alias("target_id"), "path", F.encode("text", "UTF-8").alias("content"))
    read = xml_values(rest)
    v = F.trim("value")
    library = v.rlike(r"(?i)\.(?:so|dll|dylib)(?:\.\d+)*$")
    odd = library | (fn.path_escapes(v) & ~F.contains(v, F.lit("://")))
    values = read.where(F.col("value").isNotNull() & (v != "") & (F.length(v) <= 4096) & odd).select("path", "ord", v.alias("value"), F.when(library, rules.HIGH).otherwise(rules.MEDIUM).alias("severity"))
    firsts = values.groupBy("path", "value", "severity").agg(F.min("ord").alias("ord"))
    first = firsts.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord", "value"))).where(F.col("k") <= cap)
    refs = first.select("path", F.lit("OPENVINO_EXTERNAL_REF").alias("rule_id"), "severity", "value")
    return said(artifacts.where(declares), "OPENVINO_XXE", rules.HIGH).unionByName(said(read.where("error IS NOT NULL"), "OPENVINO_MALFORMED", rules.LOW)).unionByName(refs)


def extension_scripts(artifacts: DataFrame) -> DataFrame:
    """(path, rule_id, severity): PMML with entities, or with an extension that speaks of code in the 2000 characters from its start; one finding of each.

    Windows may overlap: each extension is looked at from where it stands.
    """
    windows = F.regexp_extract_all("text", F.lit(r"(?s)(?=<Extension\b[^>]*>)(?=(.{1,2000}))<Extension\b[^>]*>"), F.lit(1))
    script = F.exists(windows, lambda w: w.rlike("(?i)script|python|exec|eval|code"))
    said = lambda test, rule, severity: F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity")))
    rows = F.array_compact(F.array(said(F.col("text").rlike("<!ENTITY"), "PMML_XXE", rules.HIGH), said(script, "PMML_EXTENSION_SCRIPT", rules.MEDIUM)))
    return artifacts.select("path", F.explode(rows).alias("f")).select("path", "f.*")


def loader_modules(descriptors: DataFrame) -> DataFrame:
    """(path, rule_id, severity, loader_module, code) of (path, text) model descriptors whose python_function flavour names what it imports, in any style of YAML."""
    facts = yaml_facts(descriptors.select(F.lit(None).cast("string").alias("target_id"), "path", F.encode("text", "UTF-8").alias("content")))
    flavour = [".flavors", ".python_function"]
    own = facts.where((F.slice("steps", 1, 2) == F.array(*map(F.lit, flavour))) & ((F.size("steps") == 3) | ((F.size("steps") == 2) & (F.col("kind") == "object"))))
    value = lambda key: F.coalesce(F.max(F.when((F.col("key") == key) & (F.size("steps") == 3), F.col("value"))), F.lit(""))
    rows = own.groupBy("path").agg(value("loader_module").alias("loader_module"), value("code").alias("code"))
    return rows.select("path", F.lit("MLFLOW_PYFUNC_LOADER").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity"), "loader_module", "code")


def skops_findings(artifacts: DataFrame) -> DataFrame:
    """(target_id, path, rule_id, severity, name) of (target_id, path, content) skops archives: the types that loading imports, nodes that fall back on pickles, and archives without a schema that can be read."""
    schemas = small_members(artifacts, "schema.json", depth=1)
    archive = F.regexp_replace("path", "!schema\\.json$", "")
    facts = json_facts(schemas.where("content IS NOT NULL").select("target_id", archive.alias("path"), "content"))
    types, fallback = schema_types(facts)
    kinds = classified_imports(types)
    unknown = F.col("category") == "unknown-import"
    named = types.join(kinds, ["module", "name"]).select("path", F.when(unknown, "SKOPS_UNKNOWN_TYPE").otherwise("SKOPS_DANGEROUS_TYPE").alias("rule_id"), F.when(unknown, rules.LOW).otherwise(F.col("severity")).alias("severity"), F.concat_ws(".", "module", "name").alias("name"))
    good = facts.groupBy("path").agg(F.bool_or(F.col("kind") == "error").alias("broken")).where("NOT broken")
    bad = artifacts.select("path").join(good, "path", "left_anti").select("path", F.lit("SKOPS_MALFORMED").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity"), F.lit(None).cast("string").alias("name"))
    found = named.unionByName(fallback.select("path", "rule_id", "severity", F.col("loader").alias("name"))).unionByName(bad)
    return artifacts.select("target_id", "path").join(found, "path").select("target_id", "path", "rule_id", "severity", "name")


def numpy_heads(arrays: DataFrame) -> DataFrame:
    """``arrays`` with a NumPy head, with ``header_len`` and ``header``: the length stands in bytes 9 and 10, little-endian, and the text behind them."""
    head = arrays.where(_starts(F.col("content"), "934E554D5059")).withColumn("header_len", fn.little_endian(F.col("content"), 9, 2).cast("int"))
    return head.withColumn("header", F.decode(F.expr("substring(content, 11, header_len)"), "ISO-8859-1"))


def numpy_findings(arrays: DataFrame) -> DataFrame:
    """(path, rule_id, severity) of (path, content) .npy bytes: headers that are cut off, and arrays of objects, which hold a pickle."""
    rule = F.when(F.col("header_len").isNull(), "NUMPY_MALFORMED").when(F.col("header").rlike(r"'descr':\s*'?\|?O"), "NUMPY_OBJECT_ARRAY")
    found = numpy_heads(arrays).select("path", rule.alias("rule_id")).where("rule_id IS NOT NULL")
    return found.withColumn("severity", F.when(F.col("rule_id") == "NUMPY_OBJECT_ARRAY", rules.HIGH).otherwise(rules.MEDIUM))


def numpy_payloads(arrays: DataFrame) -> DataFrame:
    """(target_id, path, content): the pickles of arrays of objects."""
    held = numpy_heads(arrays).where(F.col("header").rlike(r"'descr':\s*'?\|?O"))
    return held.select("target_id", "path", F.expr("substring(content, 11 + header_len)").alias("content"))
