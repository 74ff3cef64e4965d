"""Formats, archives, tensors and rules of single formats over derived artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.helpers import bytes as raw
from artifactgate.operators import formats
from artifactgate.plans.fixtures import FIXTURES, _cases, frame
from artifactgate.plans.registry import query, quoted

_HEADS = ["894844460D0A1A0A", "47475546", "67676D6C00", "934E554D5059", "0000000054464C33", "504B0304", "8004", "10000000000000007B", "747265650A76657273696F6E3D", "63", "0000000045543132", "", "227765696768747322"]
_EXTS = [".onnx", ".h5", ".gguf", ".bin", ".pkl", ".tflite", ".pte", ".keras", ".safetensors", ".json", ".npz", ".joblib", ".lgb", ".xml", ".pb", "", ".md", ".tgz", ".mar"]

FIXTURES["artifacts"] = lambda d: f"""
        SELECT concat('m/', CASE WHEN doc_id % 29 = 0 THEN '.git/' ELSE '' END, CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 0 THEN '-config' ELSE '' END, {_cases("doc_id", 19, _EXTS)}) AS path,
               unhex({_cases("doc_id", 13, _HEADS)}) || {d.bytes("concat(CASE doc_id % 3 WHEN 0 THEN '\"weightsManifest\"' WHEN 1 THEN '<?xml ?><net a=\"../x.so\">' ELSE '<PMML>' END, coalesce(text, ''))")} AS content, doc_id
        FROM {d.table("documents")}"""
FIXTURES["marked"] = lambda d: f"""
        SELECT concat('k/', CAST(doc_id AS STRING)) AS path, {_cases("doc_id", 4, ["tf_savedmodel", "coreml", "paddle", "onnx"])} AS format,
               concat(coalesce(text, ''), {_cases("doc_id", 13, ["EagerPyFunc ai.onnx.contrib", "custom_lib customModel custom_layer", "py_func PyFunc", "FlexReadFile FlexAdd FlexSaveV2", "py_layer LMDBReader PyOp com.microsoft.extensions", "layer { type: \"Python\" }", "WholeFileReaderV2 CustomLayerParams", '{"class_name": "Lambda"} {"class_name": "MyLayer"} {"class_name":"Dense"} {"class_name": "MyLayer"}', "tokenizer.chat_template {{ x.__class__ }} eval (y)", '<a href="../up/x" lib="libz.so.1" u="http://h/x">', '<!ENTITY x>', '<Extension name="a">call python now'])}) AS text
        FROM {d.table("documents")}"""

_EXT = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
_BYTES = f"""b AS (SELECT *, {_EXT} AS ext, string_split(path, '/')[-1] AS name, hex(content) AS h FROM artifacts),
s AS (SELECT *, left(h, 4) IN ('8002', '8003', '8004', '8005') AS strong, length(h) >= 18 AND substr(h, 17, 2) IN ('7B', '20') AND substr(h, 9, 8) = '00000000' AND left(h, 8) <> '00000000' AND left(h, 8) = '10000000' AS st,
          contains(h, hex(encode('"weightsManifest"'))) AND contains(left(h, 16384), hex(encode('"weightsManifest"'))) AS tfjs, contains(left(h, 16384), hex(encode('<PMML'))) AS pmml, contains(left(h, 16384), hex(encode('<?xml'))) AND contains(left(h, 16384), hex(encode('<net'))) AS xml FROM b)"""
_BY_EXT = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in rules.BY_EXTENSION)
_MAGIC = "(left(h, 16) = '894844460D0A1A0A' OR left(h, 8) IN ('47475546', '6C6D6767', '666D6767', '746A6767', '616C6767', '67676D6C', '504B0304') OR left(h, 12) = '934E554D5059' OR substr(h, 9, 8) = '54464C33' OR strong)"
_DETECT = f"""CASE WHEN name = 'MLmodel' THEN 'mlflow' WHEN left(h, 26) = '747265650A76657273696F6E3D' OR ext = '.lgb' THEN 'lightgbm' WHEN left(h, 16) = '894844460D0A1A0A' THEN 'keras_h5' WHEN left(h, 8) = '47475546' THEN 'gguf'
  WHEN left(h, 8) IN ('6C6D6767', '666D6767', '746A6767', '616C6767', '67676D6C') OR ext = '.ggml' THEN 'ggml' WHEN left(h, 12) = '934E554D5059' THEN 'numpy' WHEN substr(h, 9, 8) = '54464C33' THEN 'tflite'
  WHEN left(h, 8) = '504B0304' THEN CASE ext WHEN '.pt2' THEN 'pt2' WHEN '.mar' THEN 'mar' WHEN '.skops' THEN 'skops' WHEN '.keras' THEN 'keras_v3' WHEN '.npz' THEN 'numpy' ELSE 'archive' END
  WHEN strong AND ext <> '.safetensors' AND NOT st THEN CASE WHEN ext = '.joblib' THEN 'joblib' ELSE 'pickle' END WHEN ext = '.safetensors' THEN 'safetensors' WHEN ext = '.py' THEN 'python_source'
  WHEN ext IN ('.json', '.xml', '.pmml') THEN CASE WHEN ext = '.json' THEN CASE WHEN tfjs THEN 'tfjs' WHEN contains(lower(name), 'config') THEN 'hf_config' ELSE 'unknown' END WHEN pmml THEN 'pmml' WHEN xml THEN 'openvino' ELSE 'unknown' END
  {_BY_EXT} WHEN st AND ext IN ('', '.bin') THEN 'safetensors' WHEN strong OR left(h, 2) IN ('28', '63', '5D', '7D', '8C', '29') THEN CASE WHEN ext = '.joblib' THEN 'joblib' ELSE 'pickle' END
  WHEN ext IN ('.pkl', '.pickle', '.dill', '.joblib', '.pkls', '.pdparams', '.pdiparams') THEN 'pickle' ELSE 'unknown' END"""


@query(f"WITH {_BYTES} SELECT path, {_DETECT} AS format FROM s")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "artifacts").select("path", formats.detect(F.col("path"), F.col("content")).alias("format"))


#: Files of a structured format by name around each document's words: a pickle without a protocol, text that only begins like one, one with a protocol, another format, and what they claim to be.
FIXTURES["disguises"] = lambda d: f"""
        SELECT target_id, path, doc_id, CASE doc_id % 7 WHEN 0 THEN {d.bytes("concat('cos', chr(10), 'system', chr(10), '(V', own, chr(10), 'tR.')")} WHEN 1 THEN {d.bytes("concat('cos ', own)")} WHEN 2 THEN unhex('80045D2E') || {d.bytes("own")}
               WHEN 3 THEN unhex('47475546') || {d.bytes("own")} WHEN 4 THEN unhex('0000000054464C33') || {d.bytes("own")} WHEN 5 THEN {d.bytes("concat('(V', own, chr(10), 'p0', chr(10), '.')")} ELSE unhex('080A') || {d.bytes("own")} END AS content
        FROM (SELECT source AS target_id, concat('w/', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.onnx' WHEN 1 THEN '.pb' WHEN 2 THEN '.TFLITE' WHEN 3 THEN '.pte' ELSE '.pdmodel' END) AS path, doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}) AS own FROM {d.table("documents")}) x"""


@query("""SELECT target_id, path, ['.onnx', '.pb', '.tflite', '.pte', '.pdmodel'][doc_id % 5 + 1] AS claimed, CASE doc_id % 7 WHEN 3 THEN 'gguf' WHEN 4 THEN 'tflite' ELSE 'pickle' END AS format
FROM disguises WHERE doc_id % 7 IN (0, 2, 3, 5) OR (doc_id % 7 = 4 AND doc_id % 5 <> 2)""")
def disguised_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.disguised_files(frame(spark, sf_dir, "disguises"))


@query(f"WITH {_BYTES} SELECT path FROM s WHERE NOT contains(path, '/.git/') AND (ext NOT IN ({', '.join(repr(e) for e in formats.DOCUMENT_EXTENSIONS)}) OR (ext = '.json' AND contains(lower(name), 'config')) OR {_MAGIC})")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "artifacts").where(formats.scannable(F.col("path"), F.col("content"))).select("path")


@query(f"WITH {_BYTES} SELECT path, CASE WHEN ext = '.tflite' AND substr(h, 9, 8) <> '54464C33' THEN 'TFLITE_BAD_MAGIC' WHEN ext = '.pte' AND substr(h, 9, 4) <> '4554' THEN 'EXECUTORCH_BAD_MAGIC' WHEN ext = '.gguf' AND left(h, 8) <> '47475546' THEN 'GGUF_BAD_MAGIC' WHEN ext = '.keras' AND left(h, 8) <> '504B0304' THEN 'KERAS_NOT_ZIP' END AS rule_id FROM s WHERE rule_id IS NOT NULL")
def spoofed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.spoofed_heads(frame(spark, sf_dir, "artifacts"))


@query("""SELECT archive, CASE WHEN bool_or(member = 'model.ini' OR ends_with(member, '/model.ini')) THEN 'h2o_mojo' WHEN bool_or(member = 'schema.json') THEN 'skops' WHEN bool_or(ends_with(member, 'data.pkl')) THEN 'pytorch'
  WHEN bool_or(ends_with(member, 'config.json')) AND bool_or(ends_with(member, 'metadata.json') OR ends_with(member, 'model.weights.h5')) THEN 'keras_v3' ELSE 'archive' END AS kind FROM members GROUP BY archive""")
def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.archive_kinds(frame(spark, sf_dir, "members"))


@query("""WITH bombs AS (SELECT archive FROM members GROUP BY archive HAVING sum(file_size) > 4294967296 OR (sum(file_size) > 104857600 AND sum(file_size) > 200 * greatest(sum(compress_size), 1)))
SELECT archive, NULL::VARCHAR AS member, 'ARCHIVE_BOMB' AS rule_id, 3 AS severity FROM bombs
UNION ALL SELECT DISTINCT archive, member, 'ARCHIVE_PATH_TRAVERSAL', 4 FROM members WHERE archive NOT IN (SELECT archive FROM bombs) AND (regexp_matches(member, '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(member, '/') OR regexp_matches(member, '^[A-Za-z]:') OR list_contains(string_split(member, '/'), '..'))""")
def archive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.archive_findings(frame(spark, sf_dir, "members"))


_MARKERS = ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in m) + ")" for m in rules.MARKERS)


@query(f"""WITH k(format, rule_id, marker, severity, first_only, ord) AS (VALUES {_MARKERS}),
f AS (SELECT path, k.*, row_number() OVER (PARTITION BY path, rule_id ORDER BY ord) AS n FROM marked JOIN k ON marked.format = k.format AND contains(text, marker))
SELECT path, rule_id, marker, CAST(severity AS INT) AS severity FROM f WHERE NOT first_only OR n = 1""")
def marker_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.marker_findings(frame(spark, sf_dir, "marked"))


_FLEX = " ".join(f"WHEN '{op}' THEN {severity}" for op, severity in rules.FLEX_OPS)


@query(f"""SELECT DISTINCT path, op, CASE substr(op, 5) {_FLEX} ELSE 1 END AS severity FROM (SELECT path, unnest(regexp_extract_all(text, 'Flex[A-Z][A-Za-z0-9]{{1,48}}')) AS op FROM marked)""")
def flex_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.flex_ops(frame(spark, sf_dir, "marked"))


@query(f"""SELECT DISTINCT path, layer, CASE layer WHEN 'Lambda' THEN 'KERAS_LAMBDA_LAYER' ELSE 'KERAS_CUSTOM_LAYER' END AS rule_id, CASE layer WHEN 'Lambda' THEN 4 ELSE 2 END AS severity
FROM (SELECT path, unnest(regexp_extract_all(text, '"class_name":\\s*"([A-Za-z0-9_.]{{1,80}})"', 1)) AS layer FROM marked) WHERE layer NOT IN ({", ".join(map(quoted, rules.KERAS_LAYERS + rules.KERAS_CONTAINERS))})""")
def layer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.layer_findings(frame(spark, sf_dir, "marked"))


@query(f"SELECT path, 'CAFFE_PYTHON_LAYER' AS rule_id, 3 AS severity FROM marked WHERE regexp_matches(text, {quoted(rules.CAFFE_PYTHON)})")
def python_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.python_layers(frame(spark, sf_dir, "marked"))


FIXTURES["checkpoint_members"] = lambda d: f"""
        SELECT concat('ck-', CAST(l_orderkey AS STRING)) AS archive, {_cases("l_orderkey", 3, ["pytorch", "mar"], "'archive'")} AS kind, concat('code/', CAST(l_partkey AS STRING), {_cases("l_suppkey", 5, [".py", ".pkl", ".bin", ".pyc"], "'.json'")}) AS member
        FROM {d.table("lineitem")}"""


@query("""SELECT DISTINCT archive, member, CASE kind WHEN 'mar' THEN 'MAR_HANDLER_CODE' ELSE 'PYTORCH_EMBEDDED_SOURCE' END AS rule_id, 3 AS severity FROM checkpoint_members WHERE kind IN ('mar', 'pytorch') AND ends_with(member, '.py')
UNION ALL SELECT archive, NULL, 'PYTORCH_NO_PICKLE', 0 FROM checkpoint_members WHERE kind = 'pytorch' GROUP BY archive HAVING NOT bool_or(ends_with(member, '.pkl'))""")
def member_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.member_findings(frame(spark, sf_dir, "checkpoint_members"))


FIXTURES["templates"] = lambda d: f"""
        SELECT concat('g/', CAST(doc_id AS STRING)) AS path, concat(CASE WHEN doc_id % 11 = 0 THEN 'no template ' ELSE 'tokenizer.chat_template ' END, coalesce(text, ''),
               {_cases("doc_id", 8, [" {{ x.__class__.__mro__ }} ", " {{ os.popen (y) }} os.environ ", " {{ messages | eval (y) }} ", " open (file) os.path.join(a) exec(b) ", " {% set x = cycler.__globals__ %} {{ import z }} "])}) AS text
        FROM {d.table("documents")}"""
_TEMPLATE = " UNION ALL ".join(f"SELECT path, {s} AS severity, left(regexp_extract(text, {quoted(p)}, 0), 160) AS match FROM templates WHERE contains(text, 'tokenizer.chat_template') AND regexp_matches(text, {quoted(p)})" for p, s in rules.TEMPLATE_PATTERNS)


@query(f"SELECT path, 'GGUF_TEMPLATE_INJECTION' AS rule_id, severity, match FROM ({_TEMPLATE})")
def template_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.template_findings(frame(spark, sf_dir, "templates"))


#: XML graphs around each document's words, W: the text before and behind them.
_GRAPHS = [
    ('<?xml version="1.0"?><net a="../', '.so"/>'),
    ("<net><t> /etc/", " </t><u>plain</u></net>"),
    ("<net b='1' v='C:", "' w=\"&amp;x\">text</net>"),
    ("<net><t>", "</net>"),
    ("<!DOCTYPE x><net><t>../", "</t></net>"),
    ("<net><lib>lib", ".DLL</lib><lib>libz.so.1.2</lib></net>"),
    ("<net href='https://h/../", "'/>"),
    ('<net><t w="..&#47;', '">x</t></net>'),
]


def _cased(n: int, values: list[str]) -> str:
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"


FIXTURES["graphs"] = lambda d: f"""
        SELECT path, doc_id, own, concat({_cased(8, [x for x, _ in _GRAPHS])}, own, {_cased(8, [x for _, x in _GRAPHS])}) AS text
        FROM (SELECT concat('x/', CAST(doc_id AS STRING)) AS path, doc_id, trim(concat('w', regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' '{d.everywhere}))) AS own FROM {d.table("documents")}) x"""


@query("""WITH v AS (SELECT path, unnest(CASE doc_id % 8 WHEN 0 THEN [{'s': 3, 'v': '../' || own || '.so'}] WHEN 1 THEN [{'s': 2, 'v': '/etc/' || own}] WHEN 2 THEN [{'s': 2, 'v': 'C:' || own}] WHEN 5 THEN [{'s': 3, 'v': 'lib' || own || '.DLL'}, {'s': 3, 'v': 'libz.so.1.2'}] WHEN 7 THEN [{'s': 2, 'v': '../' || own}] ELSE [] END, recursive := true) FROM graphs)
SELECT path, 'OPENVINO_EXTERNAL_REF' AS rule_id, s AS severity, v AS value FROM v WHERE length(v) <= 4096
UNION ALL SELECT path, 'OPENVINO_XXE', 3, NULL FROM graphs WHERE doc_id % 8 = 4 UNION ALL SELECT path, 'OPENVINO_MALFORMED', 1, NULL FROM graphs WHERE doc_id % 8 = 3""")
def xml_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.xml_findings(frame(spark, sf_dir, "graphs"))


FIXTURES["pmml"] = lambda d: f"""
        SELECT concat('p/', CAST(doc_id AS STRING)) AS path, concat('<PMML>', coalesce(text, ''),
               {_cases("doc_id", 9, ["<!ENTITY x>", '<Extension name="a">call PYTHON now', '<Extension name="a">plain<Extension name="b">', "<Extensions>python", "<Extension>one", "<Extension/><!ENTITY y> eval"])},
               CASE WHEN doc_id % 2 = 0 THEN repeat('-', 1500) ELSE repeat('-', 2100) END, 'code') AS text
        FROM {d.table("documents")}"""
_WINDOWS = """t AS (SELECT path, text, string_split(text, '<Extension') AS s FROM pmml), w AS (SELECT path, s, unnest(range(1, len(s))) AS k FROM t), r AS (SELECT path, array_to_string(s[k + 1:], '<Extension') AS rest FROM w),
hit AS (SELECT DISTINCT path FROM r WHERE regexp_matches(rest, '^(?:[^A-Za-z0-9_>][^>]*)?>') AND regexp_matches('<extension' || lower(left(rest, 1990)), 'script|python|exec|eval|code'))"""


@query(f"WITH {_WINDOWS} SELECT path, 'PMML_XXE' AS rule_id, 3 AS severity FROM pmml WHERE contains(text, '<!ENTITY') UNION ALL SELECT path, 'PMML_EXTENSION_SCRIPT', 2 FROM hit")
def extension_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.extension_scripts(frame(spark, sf_dir, "pmml"))


#: Descriptors in block and flow style, with quotes, comments, anchors and a merged mapping, lines by ~; the last two have no flavour or are broken.
_STYLES = [
    "flavors:~  sklearn:~    code: other~  python_function:~    env: conda.yaml~    loader_module: LOADER~    code: CODE~  onnx:~    loader_module: not.this~note: TEXT~",
    'note: "TEXT"~flavors: {python_function: {loader_module: LOADER, code: \'CODE\'}, onnx: {loader_module: not.this}} # end~',
    "'flavors':~  \"python_function\": # a comment~    \"loader_module\": 'LOADER'~    data: [a,~      b]~    code: \"CODE\"~note: >-~  TEXT~",
    "base: &b~  loader_module: LOADER~  code: CODE~note: |~  TEXT~flavors:~  python_function: *b~",
    "base: &b {loader_module: LOADER, code: other}~flavors:~  python_function:~    <<: *b~    code: CODE~note: 'TEXT'~",
    "python_function:~  loader_module: LOADER~flavors:~  onnx:~    loader_module: not.this~note: TEXT~",
    "flavors: {python_function: {loader_module: LOADER~note: TEXT~",
]
FIXTURES["descriptors"] = lambda d: f"""
        SELECT path, doc_id, loader, code, replace(replace(replace(replace({_cased(7, _STYLES)}, '~', chr(10)), 'LOADER', loader), 'CODE', code), 'TEXT', own) AS text
        FROM (SELECT path, doc_id, concat('mod_', source, '.', substr(own, 1, 20)) AS loader, concat('code/', CAST(doc_id AS STRING)) AS code, own
              FROM (SELECT concat('d/', CAST(doc_id AS STRING), '/MLmodel') AS path, doc_id, source, lower(concat('n', regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', '_'{d.everywhere}))) AS own FROM {d.table("documents")}) x) y"""


@query("SELECT path, 'MLFLOW_PYFUNC_LOADER' AS rule_id, 2 AS severity, loader AS loader_module, code FROM descriptors WHERE doc_id % 7 < 5")
def loader_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.loader_modules(frame(spark, sf_dir, "descriptors"))


FIXTURES["arrays"] = lambda d: f"""
        SELECT source AS target_id, concat('n/', CAST(doc_id AS STRING), '.npy') AS path, doc_id, {d.bytes("concat('x', coalesce(text, ''))")} AS own,
               unhex({_cases("doc_id", 7, ["934E554D50590100", "934E554D505901003A00", "934E554D50590100", "934E554D505901", "89504E47"], "'934E554D50590100'")}) AS head,
               CASE doc_id % 7 WHEN 0 THEN '|O' WHEN 2 THEN '<f4' WHEN 5 THEN 'O' ELSE '<i8' END AS kind
        FROM {d.table("documents")}"""

FIXTURES["npy"] = lambda d: f"""
        SELECT target_id, path, doc_id, CASE WHEN doc_id % 7 IN (0, 2, 5, 6) THEN head || unhex('2600') || {d.bytes("rpad(concat('{''descr'': ''', kind, ''', ''shape'': (3,)}'), 38, ' ')")} || {d.bytes("concat('cos', chr(10), 'system', chr(10), '(S''', CAST(doc_id AS STRING), '''', chr(10), 'tR.')")} ELSE head END AS content
        FROM arrays"""


@query(r"""WITH a AS (SELECT path, hex(content) AS h FROM npy WHERE left(hex(content), 12) = '934E554D5059'), n AS (SELECT path, h, CASE WHEN length(h) >= 20 THEN CAST('0x' || substr(h, 19, 2) || substr(h, 17, 2) AS INT) END AS n FROM a)
SELECT path, CASE WHEN n IS NULL THEN 'NUMPY_MALFORMED' ELSE 'NUMPY_OBJECT_ARRAY' END AS rule_id, CASE WHEN n IS NULL THEN 2 ELSE 3 END AS severity FROM n WHERE n IS NULL OR regexp_matches(decode(unhex(substr(h, 21, 2 * n))), '''descr'':\s*''?\|?O')""")
def numpy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.numpy_findings(frame(spark, sf_dir, "npy"))


_OBJECTS = " OR ".join(f"contains(hex(content), hex(encode({quoted(head)})))" for head in ("'descr': '|O'", "'descr': 'O'"))


@query(f"SELECT path AS file, 'os' AS module, 'system' AS name, 4 AS severity FROM npy WHERE left(hex(content), 12) = '934E554D5059' AND ({_OBJECTS}) AND contains(hex(content), hex(encode('cos' || chr(10) || 'system' || chr(10))))")
def numpy_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pickles inside arrays of objects import."""
    from artifactgate.helpers import bytes as raw
    from artifactgate.operators import facts

    found = raw.pickle_facts(formats.numpy_payloads(frame(spark, sf_dir, "npy"))).where("error IS NULL").withColumnRenamed("path", "file")
    return facts.import_findings(found).select("file", "module", "name", "severity")


@query("""SELECT file, tensor, unnest(list_filter([CASE WHEN CASE dtype WHEN 'F16' THEN 2 ELSE 4 END * n <> span THEN 'WEIGHTS_SIZE_MISMATCH' END, CASE WHEN vec_id % 13 = 0 THEN 'WEIGHTS_NON_FINITE' END], lambda x: x IS NOT NULL)) AS rule_id FROM tensors""")
def tensor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "tensors")
    values = F.when(F.col("vec_id") % 13 == 0, F.concat(F.array(F.lit(float("nan"))), F.col("embedding").cast("array<double>"))).otherwise(F.col("embedding").cast("array<double>"))
    return formats.tensor_findings(rows.select("file", "tensor", "dtype", F.array("n").alias("shape"), "span", values.alias("values")))


#: Configurations with an arming key at some depth, or none, around each document's words; SRC and ID stand for its source and number.
_CONFIGS = [
    '{"note":"OWN","auto_map":{"A":"mod_SRC.B","C":"x--y.z","D":["deep.mod_ID.E",null,3,["no.Z"]],"F":{"G":"no.H"}}}',
    '{"note":"OWN","a":[1,{"auto_map":{"X":"m_ID.Y"}},{"auto_map":"top.Z"}],"trust_remote_code":true}',
    '{"x":{"custom_pipelines":{"auto_map":["one.P",null,"nodot"]}},"note":"OWN"}',
    '{"note":"OWN","values":["auto_map","trust_remote_code"]}',
    '{"note":"OWN","auto_map":{"A":',
]
FIXTURES["configs"] = lambda d: f"""
        SELECT source AS target_id, concat('c/', CAST(doc_id AS STRING), '/config.json') AS path, doc_id, source,
               replace(replace(replace({_cased(5, _CONFIGS)}, 'SRC', source), 'ID', CAST(doc_id AS STRING)), 'OWN', lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}))) AS body
        FROM {d.table("documents")}"""
FIXTURES["bundled"] = lambda d: """
        SELECT target_id, replace(path, 'config.json', CASE doc_id % 2 WHEN 0 THEN concat('mod_', source, '.py') ELSE concat('m_', CAST(doc_id AS STRING), '.py') END) AS path FROM configs
        UNION ALL SELECT target_id, replace(path, 'config.json', concat('deep/mod_', CAST(doc_id AS STRING), '.py')) AS path FROM configs WHERE doc_id % 3 = 0
        UNION ALL SELECT concat(target_id, 'x') AS target_id, replace(path, 'config.json', 'one.py') AS path FROM configs"""
_TARGETS = """t AS (SELECT target_id, path, doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['mod_' || source || '.B', 'deep.mod_' || doc_id || '.E'] WHEN 1 THEN ['m_' || doc_id || '.Y', 'top.Z'] WHEN 2 THEN ['one.P'] ELSE [] END) AS target FROM configs)"""


def _config_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.json_facts(frame(spark, sf_dir, "configs").select("target_id", "path", F.encode("body", "UTF-8").alias("content")))


@query(f"""WITH {_TARGETS}, k AS (SELECT target_id, path, unnest(CASE doc_id % 5 WHEN 0 THEN ['auto_map'] WHEN 1 THEN ['auto_map', 'trust_remote_code'] WHEN 2 THEN ['auto_map', 'custom_pipelines'] ELSE [] END) AS key FROM configs)
SELECT target_id, path, 'HF_CONFIG_REMOTE_CODE' AS rule_id, key, CASE key WHEN 'auto_map' THEN 3 ELSE 2 END AS severity, CASE key WHEN 'auto_map' THEN (SELECT array_to_string(list_sort(list(target)), ',') FROM t WHERE t.path = k.path) END AS targets FROM k""")
def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.config_findings(_config_facts(spark, sf_dir))


@query(f"""WITH {_TARGETS}, s AS (SELECT t.*, replace(path, 'config.json', replace(regexp_extract(target, '^(.*)\\.[^.]*$', 1), '.', '/') || '.py') AS source_path FROM t)
SELECT s.target_id, s.path, target, b.path AS source_path FROM s LEFT JOIN bundled b ON s.target_id = b.target_id AND s.source_path = b.path""")
def armed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bundled source each configuration brings to execution."""
    return formats.armed_sources(_config_facts(spark, sf_dir), frame(spark, sf_dir, "bundled"))


FIXTURES["manifests"] = lambda d: f"""
        SELECT concat('c/', CAST(doc_id AS STRING)) AS path, source, concat('{{"note":"', regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}), '","weightsManifest":[{{"paths":["a', CAST(doc_id AS STRING), '","../b"]}},{{"paths":["/c/', source, '"]}}]}}') AS body FROM {d.table("documents")}"""


@query("SELECT path, unnest(['../b', '/c/' || source]) AS shard FROM manifests")
def shard_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.shard_escapes(frame(spark, sf_dir, "manifests"))


FIXTURES["headers"] = lambda d: f"""SELECT concat('s/', CAST(doc_id AS STRING)) AS path, CAST(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 100 END AS BIGINT) AS header_len, CAST(CASE WHEN doc_id % 6 = 1 THEN 50 ELSE 500 END AS BIGINT) AS size,
  CASE doc_id % 6 WHEN 2 THEN '[1]' WHEN 3 THEN '{{"a":{{"dtype":"F32","shape":[2]}}}}' ELSE '{{"__metadata__":{{}},"a":{{"dtype":"F32","shape":[2],"data_offsets":[0,8]}}}}' END AS header, doc_id FROM {d.table("documents")}"""


@query("SELECT path, CASE WHEN doc_id % 6 < 2 THEN 'SAFETENSORS_BAD_HEADER' ELSE 'SAFETENSORS_MALFORMED' END AS rule_id FROM headers WHERE doc_id % 6 < 4")
def header_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.header_findings(frame(spark, sf_dir, "headers"))


_LOCATIONS = [
    ["x location", 18, 9, "../up.bin", " and location", 18, 5, "../bb", " end"],
    ["location", 18, 30, "/a location", 18, 4, "../c and what follows here", " location", 18, 5, "plain"],
    ["location", 18, 12, "https://x/y ", "location", 18, 3, "C:/", "location", 18, 120, "../short"],
]


def _located(parts: list) -> str:
    return "concat(" + ", ".join(f"chr({p})" if isinstance(p, int) else f"'{p}'" for p in parts) + ")"


FIXTURES["locations"] = lambda d: f"SELECT concat('o/', CAST(doc_id AS STRING)) AS path, concat(coalesce(text, ''), CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_located(p)}" for k, p in enumerate(_LOCATIONS)) + f" ELSE '' END) AS text FROM {d.table('documents')}"


@query("""WITH p AS (SELECT path, string_split(text, 'location' || chr(18)) AS s FROM locations), k AS (SELECT path, s, unnest(range(1, len(s))) AS k FROM p),
v AS (SELECT path, array_to_string(s[k + 1:], 'location' || chr(18)) AS rest FROM k), l AS (SELECT DISTINCT path, substr(rest, 2, ascii(rest)) AS location FROM v WHERE ascii(rest) BETWEEN 1 AND 127)
SELECT path, location FROM l WHERE regexp_matches(location, '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(location, '/') OR regexp_matches(location, '^[A-Za-z]:') OR list_contains(string_split(replace(location, chr(92), '/'), '/'), '..')""")
def external_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.external_locations(frame(spark, sf_dir, "locations"))
