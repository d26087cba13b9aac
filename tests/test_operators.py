"""Sequential operators and expressions against plain models."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.functions import answers as A
from doclattice.functions import ids
from doclattice.functions import text as T
from doclattice.operators import chunking, entities, graph, grid, search, structure
from doclattice.operators.small import sent
from doclattice.plans import registry
from doclattice.plans.answer_queries import VIEWS, read_only
from doclattice.plans.graph_queries import COMPONENTS, component_texts
from doclattice.streaming import rate_limit


def test_chunks_cover_the_text_and_overlap():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(0, 6000)
        text = "".join(rng.choice("abc .!?\n" if rng.random() < 0.3 else "abcdef") for _ in range(n))
        spans = chunking.chunk_spans(text)
        at = 0
        for a, z in spans:
            assert a <= at or not text[at:a].strip()
            assert z > a and z - a <= chunking.CHUNK + chunking.SEARCH
            at = max(at, z)
        assert not text[at:].strip()
        for (a, z), (b, _) in zip(spans, spans[1:]):
            assert b >= z - chunking.OVERLAP
            near = [i for i in range(max(a, a + 1600 - 200), min(a + 1800, n)) if text[i] in ".!?\n"]
            if near and a + 1600 < n:
                assert abs(z - a - 1600) == min(abs(i + 1 - a - 1600) for i in near)
            elif a + 1600 < n:
                assert z == a + 1600


def test_hard_chunks():
    assert chunking.chunk_spans("") == [] and chunking.chunk_spans("  \n ") == []
    assert chunking.chunk_spans("short.") == [(0, 6)]
    assert chunking.chunk_spans("a" * 4000) == [(0, 1600), (1200, 2800), (2400, 4000)]


def plain_packed(rows, most, cost):
    out, used = [], 0
    for r in rows:
        if out and used + cost(r) <= most:
            out[-1], used = out[-1] + "\n" + r, used + cost(r)
        else:
            out, used = [*out, r], cost(r)
    return out


def plain_table_chunks(m):
    rows = [["" if c is None else c for c in r] for r in m if any(c and c.strip() for c in r)]
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
    lines = [" | ".join(" ".join(c.split()) for c in (r + [""] * width)[:width])[:16000] for r in rows]
    return plain_packed(lines, 4000, lambda r: len(r) // 4) or [""]


def plain_record_chunks(csv):
    header, *rows = [[c.strip() for c in x.split(",")] for x in csv.split("\n") if x.strip()] or [None]
    if header is None:
        return ["[Empty table]"]
    if not rows:
        return ["Table columns: " + ", ".join(header)]
    return plain_packed([t for t in (", ".join(f"{h}: {v}" for h, v in zip(header, r) if v) for r in rows) if t], 60, lambda t: len(t) + 1) or ["[Empty table]"]


def test_table_and_record_chunks(spark):
    rng = random.Random(4)
    cell = lambda: rng.choice([None, "", " ", "a b", "x" * rng.randrange(1, 4000), "\tq  r"])
    tables = [[[cell() for _ in range(rng.randrange(0, 6))] for _ in range(rng.randrange(0, 12))] for _ in range(60)] + [[], [["x" * 20000]] + [["y", "z"]] * 3, [["long"] * 9000, ["short"]]]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(tables)], "i int, m array<array<string>>").select("i", chunking.table_chunks(F.col("m")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: plain_table_chunks(m) for i, m in enumerate(tables)}
    texts = ["", "a,b", "a,b\n1,\n,2", " \n \n", "a\n\n,\n"] + ["\n".join(",".join(rng.choice(["", " v ", "word", "12"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 15))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.record_chunks(F.col("t"), 60).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: plain_record_chunks(t) for i, t in enumerate(texts)}


def test_components_against_a_plain_model(spark):
    rng = random.Random(7)
    find = entities.ComponentFinder(COMPONENTS)
    vocabulary = "main aux the HFO hot check Gear gears ring bolt rods and, of to".split()
    for _ in range(200):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        kept, codes, out = [], set(), []
        for a, z, kind, name, code in find.candidates(text):
            if len(name) >= 3 and code not in codes and all(z <= b or y <= a for b, y in kept):
                kept.append((a, z))
                codes.add(code)
                out.append({"name": name, "kind": kind, "code": code, "position": a})
        assert find(text) == out
    names = ["", "pump", "the main HFO pump", "a b c main hot cold sea valve", "Äb ring", "x y"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(A.clean_component(F.col("n"))).collect()
    assert [r[0] for r in got] == [find.clean(n) for n in names]
    found = spark.createDataFrame([(None,), ("Check the main ring and the HFO rings",)], "t string").select(entities.components(COMPONENTS)("t").alias("c")).collect()
    assert found[0].c == [] and [c.name for c in found[1].c] == ["main ring", "HFO rings"]


def test_part_texts_against_the_model(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    find = entities.ComponentFinder(COMPONENTS)
    want = {(r.p_partkey, c["code"], c["position"]) for r in component_texts(parts).collect() for c in find(r.text)}
    assert {(r.p_partkey, r.code, r.position) for r in registry.queries()["e3_components"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("block", [7, 2048])
def test_top_by_blocks(spark, block):
    rng = np.random.RandomState(1)
    rows = [(int(i % 2), int(i // 4), i, rng.randn(6).tolist() if i != 5 else [0.0] * 6) for i in range(60)]
    c = spark.createDataFrame(rows, "doc int, section int, id int, p array<double>")
    s = spark.createDataFrame([(d, i, g, v) for d, g, i, v in rows[::3]], "doc int, source int, section int, q array<double>")
    got = {(r.source, r.k): (r.id, r.of_section, round(r.score, 9)) for r in search.top_by_blocks(s, c, "doc", "source", "section", "id", 4, block).collect()}
    want = {}
    for d, g, i, v in rows[::3]:
        score = lambda w: float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))) if np.any(w) and np.any(v) else 0.0  # noqa: E731, B023
        best = sorted(((-score(w), j, h) for e, h, j, w in rows if e == d and h != g))[:4]
        want |= {(i, k + 1): (j, h, round(-x, 9)) for k, (x, j, h) in enumerate(best)}
    assert got == want


def test_mean_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])]
    got = search.mean_vectors(spark.createDataFrame(rows, "g int, v array<double>"), ["g"], "v").collect()
    assert {r.g: r.v for r in got} == {1: [2.0, 3.0], 2: [5.0, 5.0]}
    assert search.mean_vectors(spark.createDataFrame([], "g int, v array<double>"), ["g"], "v").count() == 0


def test_sent_is_checked(spark):
    assert "broadcast" in sent(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sent(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_keep_first_boxes(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 11.0, 10.0), (1, 2, 2.0, 0.0, 12.0, 10.0), (2, 3, 1.0, 0.0, 11.0, 10.0)]
    got = grid.keep_first(spark.createDataFrame(rows, "page int, k int, x0 double, y0 double, x1 double, y1 double"), ["page"], "k", 0.7)
    assert sorted(r.k for r in got.collect()) == [0, 2, 3]  # 1 falls to 0; 2 overlaps 0 by 0.67 only


def test_trim_matrix(spark):
    m = spark.createDataFrame([([["a", " ", ""], ["", None, " "], ["b", "c"]],), ([["", ""]],), ([],)], "m array<array<string>>")
    assert [r[0] for r in m.select(chunking.trim_matrix(F.col("m"))).collect()] == [[["a", " "], ["b", "c"]], [], []]


def test_titles_and_levels(spark):
    rows = [("Operation on max. 0.50% fuels. Page 4 of 7",), ("word " * 30,), ("CHAPTER 2 Start",), ("1.2.3 Deep",), ("FIG-3 x",), ("Safety first",), ("IV. Rome is here today now yes",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.short_title(F.col("t")).alias("s"), T.toc_level(F.col("t")).alias("l"), T.is_header(F.col("t")).alias("h")).collect()
    assert got[0].s == "Operation on max." and len(got[1].s) <= 80 and got[1].s.endswith("word...")
    assert [r.l for r in got[2:]] == [1, 3, 3, 2, 1]
    assert [r.h for r in got[2:6]] == [True, True, False, True]


def test_uuid5_equals_library(spark):
    names = ["a:b", "doc:Öl:1-2", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def model(requests, most, window):
    logs, out = {}, {}
    for k, at, i in sorted(requests):
        log = [x for x in logs.get(k, []) if x > at - window]
        out[i] = len(log) < most
        logs[k] = [*log, at] if out[i] else log
    return out


def requests():
    rng = random.Random(3)
    return [(rng.choice("ab"), float(rng.randrange(1000)), i) for i in range(300)]


def test_rate_limit_replay(spark):
    df = spark.createDataFrame(requests(), "key string, at double, event_id long")
    got = {r.event_id: r.allowed for r in rate_limit.replay(df, 3, 60.0).collect()}
    assert got == model(requests(), 3, 60.0) and set(got.values()) == {True, False}


def test_rate_limit_stream(spark, tmp_path):
    rows = sorted(requests(), key=lambda r: r[1])
    schema = "key string, at double, event_id long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    out = rate_limit.stream(source, 3, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert len(got) == 300 and set(got.values()) == {True, False}


def test_hierarchy_is_bounded(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "child int, parent int")
    got = graph.longest_path(graph.ancestors(spark.createDataFrame([(0,)], "k int"), edges, "k", 4)).collect()
    assert [(r.top, r.depth) for r in got] == [(4, 4)]


PATH = "parquet.`/root/testdata/sf0.001/labels.parquet`"


@pytest.mark.parametrize("sql", [
    f"SELECT count(*) FROM {PATH}", f"SELECT * FROM nation WHERE n_nationkey IN (SELECT doc_id FROM {PATH})", f"SELECT (SELECT max(doc_id) FROM {PATH}) FROM nation",
    f"SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM {PATH})", f"WITH x AS (SELECT * FROM {PATH}) SELECT * FROM x", f"SELECT n_name FROM nation UNION ALL SELECT doc_id FROM {PATH}",
    "SELECT * FROM range(5)", "SELECT * FROM spark_catalog.default.nation", "SELECT reflect('java.lang.System', 'exit', 1) FROM nation", "SELECT n_name FROM nation ORDER BY (SELECT max(doc_id) FROM labels)",
    f"SELECT * FROM nation JOIN LATERAL (SELECT * FROM {PATH})", "EXPLAIN SELECT 1", "SET x = 1", "SELECT max(n_name) FROM nation HAVING (SELECT count(*) FROM labels) > 1", "TABLE labels",
])
def test_guard_is_not_bypassed(spark, sf_dir, sql):
    with pytest.raises(ValueError):
        read_only(spark, sf_dir, sql, VIEWS)


def test_common_tables_are_allowed(spark, sf_dir):
    sql = "WITH x AS (SELECT n_name, n_regionkey FROM nation), y AS (SELECT * FROM x WHERE n_regionkey IN (SELECT r_regionkey FROM region)) SELECT count(*) AS n FROM y WHERE n_name > (SELECT min(n_name) FROM nation)"
    assert read_only(spark, sf_dir, sql, VIEWS).first().n == 24


@pytest.mark.parametrize("sql", ["DROP TABLE nation", "INSERT INTO nation SELECT * FROM nation", "SELECT * FROM documents", "CREATE TABLE x AS SELECT 1"])
def test_only_queries_over_allowed_tables(spark, sf_dir, sql):
    with pytest.raises(ValueError):
        read_only(spark, sf_dir, sql, VIEWS)


def test_offset_is_no_forbidden_word(spark, sf_dir):
    assert read_only(spark, sf_dir, "SELECT n_name AS created_at FROM nation ORDER BY 1 LIMIT 2 OFFSET 1", VIEWS).count() == 2


def test_toc_entries_of_odd_lines(spark):
    lines = ["\tIntro of it\t\t12 ", "5 Things here  7", "5. Things here  7", "FIG-3 x long  7", "ab  7", "1.2\tDeep start   \t9", "3.1 FIRST START NOW", "3.1 FIRST", "Part one....... 4", None]
    df = spark.createDataFrame([(1, i, 3, x) for i, x in enumerate(lines)], "doc_id int, line_no int, page int, line string")
    got = {r.line_no: (r.title, r.level, r.toc_page) for r in structure.toc_entries(df).collect()}
    assert got == {0: ("Intro of it", 2, 12), 1: ("5 Things here", 1, 7), 2: ("5. Things here", 2, 7), 5: ("1.2 Deep start", 2, 9), 6: ("3.1 FIRST START NOW", 2, 4), 8: ("Part one", 1, 4)}
