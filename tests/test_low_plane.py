from pyspark.sql import functions as F

from artifactgate import catalog
from artifactgate.operators import indicators
from artifactgate.plans.fixtures import frame

SF = "/root/testdata/sf0.001"


def test_the_plane_holds_the_whole_text(spark):
    """The indicators of the plane are those of the printable characters of every text, to its end."""
    text = F.concat(F.lit("https://evil.example.net/x "), F.regexp_replace("text", r"[^\x20-\x7e]", ""))
    rows = lambda df: sorted(map(tuple, df.select("target_id", "path", "rule_id", "key", "severity").collect()), key=repr)
    want = rows(indicators.indicator_findings(frame(spark, SF, "text_artifacts").select("target_id", "path", text.alias("text"))))
    assert rows(catalog.QUERIES["low_plane_indicators"](spark, SF)) == want
    print("ROWS", len(want))
