"""YAML, XML, JSON facts and dates: known answers, and what a mapping of PyYAML would be."""

import json

import pytest
from pyspark.sql import functions as F

from artifactgate.functions import dates
from artifactgate.helpers import bytes as raw
from artifactgate.helpers.yaml import parse_yaml
from artifactgate.operators import formats, observe, signals

DOCUMENTS = [
    ("a: 1\nb:\n  - x\n  - y: 2\n    z: 3\n  -\n    q: r\nc: {d: e, \"f\": [g, 'h', {i: j}]}\n", {"a": "1", "b": ["x", {"y": "2", "z": "3"}, {"q": "r"}], "c": {"d": "e", "f": ["g", "h", {"i": "j"}]}}),
    ("flavors: {python_function: {loader_module: \"a.b\",\n  code: c}} # end\n", {"flavors": {"python_function": {"loader_module": "a.b", "code": "c"}}}),
    ("'k':\n- a # one\n- b\n\"q\": 'it''s # not'\n", {"k": ["a", "b"], "q": "it's # not"}),
    ("- - a\n  - b\n- c: d\n", [["a", "b"], {"c": "d"}]),
    ("k: |\n  one\n  two: 2\nz: >-\n  folded\n  text\n", {"k": "one\ntwo: 2\n", "z": "folded text\n"}),
    ("base: &b\n  m: 1\n  c: 2\nx: *b\ny:\n  <<: *b\n  c: 3\nl: [&s t, *s]\n", {"base": {"m": "1", "c": "2"}, "x": {"m": "1", "c": "2"}, "y": {"m": "1", "c": "3"}, "l": ["t", "t"]}),
    ("---\na: !!str b\nu: http://x.y/z#f\nn: ~\nt: true\np: plain\n  on\n...\n", {"a": "b", "u": "http://x.y/z#f", "n": None, "t": True, "p": "plain on"}),
    ("", None),
    ("just text", "just text"),
]


@pytest.mark.parametrize(("text", "want"), DOCUMENTS)
def test_yaml(text, want):
    assert parse_yaml(text) == want


@pytest.mark.parametrize("text", ["a: {b: c", "a: 'x\n b", "a: b\n   c: d\n e", "[" * 500, "a: b\n- c"])
def test_broken_yaml_is_a_value_error_or_a_value(text):
    try:
        parse_yaml(text)
    except ValueError:
        pass


def test_aliases_do_not_blow_up(spark):
    text = "a0: &a0 [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{k}: &a{k} [{', '.join([f'*a{k - 1}'] * 10)}]\n" for k in range(1, 9))
    rows = raw.yaml_facts(spark.createDataFrame([("t", "p", text.encode())], "target_id string, path string, content binary"))
    assert rows.where("kind = 'error'").count() == 1 and rows.count() <= raw.MOST_FACTS + 1


def documents(spark, *texts):
    return spark.createDataFrame([("t", f"p{k}", t) for k, t in enumerate(texts)], "target_id string, path string, text string")


def facts_of(spark, *texts):
    return raw.json_facts(documents(spark, *texts).select("target_id", "path", F.encode("text", "UTF-8").alias("content")))


def test_configurations_at_any_depth(spark):
    facts = facts_of(spark, '{"a":{"auto_map":{"X":"m.Y"}}}', '{"auto_map":{"X":["m.Y",null]}}', '{"auto_map":{"X":{"Y":"no.Z"}}}', '["auto_map"]', "{", '{"a":' * 5_000)
    got = {(r.path, r.rule_id, r.key, r.targets) for r in formats.config_findings(facts).collect()}
    assert got == {("p0", "HF_CONFIG_REMOTE_CODE", "auto_map", "m.Y"), ("p1", "HF_CONFIG_REMOTE_CODE", "auto_map", "m.Y"), ("p2", "HF_CONFIG_REMOTE_CODE", "auto_map", None)}
    files = spark.createDataFrame([("t", "m.py"), ("u", "m.py"), ("t", "m.txt")], "target_id string, path string")
    assert {(r.path, r.source_path) for r in formats.armed_sources(facts, files).collect()} == {("p0", "m.py"), ("p1", "m.py")}


def test_loader_modules_in_any_style(spark):
    rows = documents(spark, "flavors:\n  python_function: {loader_module: evil.mod}\n", "flavors:\n  python_function:\n    loader_module: \"q.m\"\n    code: c\n", "flavors: [python_function]\n", "flavors:\n  python_function: text\n", "\x00{")
    assert {(r.path, r.loader_module, r.code) for r in formats.loader_modules(rows).collect()} == {("p0", "evil.mod", ""), ("p1", "q.m", "c")}


def test_xml_values(spark):
    many = "<net>" + "".join(f"<a b='/x/{k}'/>" for k in range(150)) + "</net>"
    rows = documents(spark, "<net><t>../../x.so</t></net>", "<net v='/etc/x'/>", "<net v='/etc/x'>", "<!ENTITY x>", many, "<net v='&#47;etc&#x2f;y'><a>  </a></net>", "")
    got = {(r.path, r.rule_id, r.severity, r.value) for r in formats.xml_findings(rows).where("path <> 'p4'").collect()}
    assert got == {("p0", "OPENVINO_EXTERNAL_REF", 3, "../../x.so"), ("p1", "OPENVINO_EXTERNAL_REF", 2, "/etc/x"), ("p2", "OPENVINO_MALFORMED", 1, None), ("p3", "OPENVINO_XXE", 3, None), ("p5", "OPENVINO_EXTERNAL_REF", 2, "/etc/y"), ("p6", "OPENVINO_MALFORMED", 1, None)}
    assert {r.value for r in formats.xml_findings(rows).where("path = 'p4'").collect()} == {f"/x/{k}" for k in range(100)}


def test_statuses_of_any_shape(spark):
    bodies = spark.createDataFrame([("r", "a", '{"av":{"status":" Unsafe"},"status":"bad"}'), ("r", "b", '{"x":[{"deep":{"scanStatus":"safe"}},{"status":"odd"}]}'), ("r", "c", "nonsense"), ("r", "d", json.dumps({"k": {"status": ["unsafe"], "Status": 4}}))], "repo_id string, path string, body string")
    assert {(r.path, r.scanner, r.status) for r in signals.upstream_statuses(bodies).collect()} == {("a", "av", "unsafe"), ("b", "x[0]", "safe"), ("b", "x[1]", "odd")}


TIMES = {
    "2024-03-01": "2024-03-01 00:00:00", "2024-03-01T10:20:30Z": "2024-03-01 10:20:30", "2024-03-01 10:20": "2024-03-01 10:20:00", "2024-03-01T10:20:30.123456+02:00": "2024-03-01 08:20:30.123456", "2024-03-01T10:20:30-0530": "2024-03-01 15:50:30",
    "2024-03-01T10:20:30+01": "2024-03-01 09:20:30", "2024-02-30": None, "2024-03-01T25:00:00Z": None, "yesterday": None, "": None, "2024-03-01x": None,
}


def test_times_given_as_text(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "t string").select("t", dates.iso_time(F.col("t")).cast("string").alias("at"), dates.age_days(F.col("t"), F.lit("2024-03-11").cast("date")).alias("age"))
    got = {r.t: (r["at"], r.age) for r in rows.collect()}
    assert {t: a for t, (a, _) in got.items()} == {**TIMES, None: None} and got["2024-03-01"][1] == 10 and got["yesterday"][1] is None


def test_counters_of_empty_tables(spark):
    empty = lambda kinds: spark.createDataFrame([], kinds)
    out = observe.counter_families(empty("verdict string, status string, origin string"), empty("format string, size bigint, error string"), empty("severity int, category string, rule_id string"), empty("rule_id string"))
    assert out.count() == 0
