"""Figure captions and references by their places."""

import pytest
from pyspark.sql import functions as F

from doclattice.functions import figures


def test_references_keep_their_places(spark):
    page = "x" * 150 + " see Figure 4-3 and, as shown in fig. 4-3, " + "y" * 30 + " (see drawing 4-3)\nFIGURE  4-3 shows it. refer to figure 4.3 " + "z" * 150
    rows = [(1, page, "4-3"), (2, page, None), (3, "", "1"), (4, None, "1"), (5, "see figure 12", "1"), (6, "(fig 7) (fig 7)", "7")]
    df = spark.createDataFrame(rows, "id int, text string, number string")
    got = {r.id: r.refs for r in df.select("id", figures.references(F.col("text"), F.col("number")).alias("refs")).collect()}
    clean = lambda t: " ".join(t.split())
    want = []
    for m in ("see Figure 4-3", "shown in fig. 4-3", "FIGURE  4-3 shows", "(see drawing 4-3)"):
        at = page.index(m)
        want.append(clean(page[max(0, at - 100) : at + len(m) + 100]))
    # The third pattern's match is also one of the first pattern's, inside of the brackets.
    inner = page.index("see drawing 4-3")
    want.insert(2, clean(page[inner - 100 : inner + 115]))
    assert got[1] == want and got[2] == got[3] == got[4] == [] and got[5] == ["see figure 12"] and got[6] == ["(fig 7) (fig 7)"]


@pytest.mark.parametrize(
    "above, below, caption",
    [
        ("text\nFigure 3.2: Fuel  system\nmore", "", "Figure 3.2: Fuel system"), ("РИС. 4 Насос", "", "Figure 4: Насос"), ("", "чертеж 2-1 - Клапан\n", "Figure 2-1: Клапан"),
        ("Type : MAXI ALL MODE", "", "MAXI ALL MODE"), ("PRIMARY BLOWER & 1ST", "", "PRIMARY BLOWER & 1ST"), ("<< FIG. S-03 >>", "", "<< FIG. S-03 >>"), ("model: abc", "", "model: abc"), ("type:ab", "", ""),
        ("plain words\nwith colon: yes", "", "with colon: yes"), ("a\nb\nc\nLATE TITLE", "SHORT UP", "SHORT UP"), ("plain", "Figure 9 Below it", "Figure 9: Below it"), (None, None, ""), ("", "", ""),
    ],
)
def test_captions(spark, above, below, caption):
    df = spark.createDataFrame([(above, below)], "above string, below string")
    assert df.select(figures.find_caption(F.col("above"), F.col("below")).alias("c")).first().c == caption


def test_tags_and_codes(spark):
    df = spark.createDataFrame([("The Pump P-101, PU3 and burner; 7M2 P-101 TANK-22 AB12 WIRING",), ("",)], "t string")
    rows = df.select(figures.domain_tags(F.col("t")).alias("tags"), figures.entity_codes(F.col("t")).alias("codes")).collect()
    assert rows[0].tags == ["combustion", "fluid_system", "electrical"] and rows[0].codes == ["P-101", "PU3", "AB12"] and rows[1].tags == rows[1].codes == []


def test_texts_are_searched_once_for_all_matches(spark):
    """Neither the places of matches nor tags search or lower a text again for each match or word."""
    n = 20_000
    df = spark.createDataFrame([(1, "see figure 1 " * n), (2, None), (3, "none")], "id int, text string")
    parts = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    plan = parts(figures.matches_with_places(F.col("text"), F.lit("figure")))
    assert plan.count("regexp_extract_all") == plan.count("split(") == 1
    assert parts(figures.domain_tags(F.col("text"))).count("lower(") == 1
    few = df.select("id", figures.matches_with_places(F.substring("text", 1, 26), F.lit(r"(?i)FIGURE\s")).alias("m")).orderBy("id").collect()
    assert [None if r.m is None else [tuple(x) for x in r.m] for r in few] == [[("figure ", 4), ("figure ", 17)], None, []]


@pytest.mark.parametrize("k", range(3))
def test_what_references_begin_with(k):
    import re

    pattern = figures.REFERENCES[k].replace("{}", "4")
    texts = [f"{a} {n} 4 {z}" for a in ("see", "Refer to", "SHOWN IN", "depicted in", "illustrated in", "as per", "x") for n in ("figure", "FIG", "fig.", "Diagram", "drawing") for z in ("shows", "illustrates", "")]
    texts += [f"({t})" for t in texts] + [f"({n} 4)" for n in ("figure", "Fig.", "Diagram")]
    found = [re.findall("(?i)" + pattern, t) for t in texts]
    assert any(found) and found == [re.findall(f"(?i)(?={figures.BEGIN[k]}){pattern}", t) for t in texts]
