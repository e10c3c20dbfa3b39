"""Cases that pin behaviour which the tables do not reach."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.operators import events, graph, ingest, model, retrieve, validate
from lodestone.operators.ordered import last_value_first_place


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("get_user_by_id", {"get", "user", "by", "id"}), ("parseXML2", {"parse", "xm"}), ("a", set()), ("UserService.create", {"user", "service", "create"}), ("", set())])
def test_identifier_tokens(spark, name, want):
    assert set(one(spark, text.identifier_tokens(F.lit(name)))) == want


def test_keywords_keep_case_order_and_repeats(spark):
    assert one(spark, text.keywords(F.lit("  What does the Parser do, Parser of IT?\n"))) == ["Parser", "do,", "Parser", "IT?"]


@pytest.mark.parametrize(("path", "lang"), [("a/b.PY", "python"), ("x.h", "c"), (".gitignore", "unknown"), ("Makefile", "unknown"), ("a.b/c", "unknown"), ("q.tsx", "typescript"), ("s.R", "r")])
def test_language_of(spark, path, lang):
    assert one(spark, text.language_of(F.lit(path))) == lang


@pytest.mark.parametrize(("body", "marks"), [("see [TODO] and [TODO]", ["[TODO]", "[TODO]"]), ("`[TODO]` ```\n[TBD]\n```", []), ("[NOTE X] [MY TODO LIST]", ["[MY TODO LIST]"]), ("[CLASS NAME]", ["[CLASS NAME]"]), ("[todo]", [])])
def test_placeholders(spark, body, marks):
    assert one(spark, text.placeholders(F.lit(body))) == marks


def test_gate(spark):
    p = "A paragraph that is certainly longer than fifty characters in all."
    g = one(spark, scoring.gate(F.lit(f"## Feature areas\n\n{p}\n\n{p}\n\n[TBD]"), 100, ["Feature Areas", "Other"]))
    assert (g["passed"], g["score"], g["missing"], g["repeated"]) == (False, 0.25, ["Other"], 1)
    assert one(spark, scoring.gate(F.lit("x"), 50, []))["checks"] == 3


def test_strip_fence(spark):
    assert one(spark, text.strip_fence(F.lit("```md\n# A\n```"))) == "# A"
    assert one(spark, text.strip_fence(F.lit("a ```x``` b "))) == "a ```x``` b"


@pytest.mark.parametrize(("message", "want"), [("find the features", "search"), ("explain this function", "code_exploration"), ("", "general"), ("feature function", "general"), ("the security overview", "lookup")])
def test_intent(spark, message, want):
    assert one(spark, scoring.intent(F.lit(message))) == want


@pytest.mark.parametrize(("status", "timed", "message", "want"), [(429, False, "", "transient"), (403, True, "", "client"), (503, False, "", "server"), (None, True, "", "timeout"), (None, False, "Rate Limit", "transient"), (None, False, "Connection reset", "transient"), (None, False, "odd", "unknown"), (200, False, "404", "client")])
def test_errors(spark, status, timed, message, want):
    assert one(spark, scoring.error_class(F.lit(status).cast("int"), F.lit(timed), F.lit(message))) == want


def test_citations(spark):
    rows = [(None, 1, 2), (9, 0, 2), (9, 3, 2), (9, 3, 10), (9, 1, 9)]
    df = spark.createDataFrame(rows, "n int, a int, b int")
    assert [r[0] for r in df.select(scoring.citation_problem(F.col("n"), F.col("a"), F.col("b"))).collect()] == ["file not found", "start below 1", "end before start", "end past the file", None]
    c = text.format_citation(F.lit("f.py"), F.lit("run"), F.lit(1), F.lit(2), F.lit(0.9))
    assert one(spark, c) == "f.py:1-2 (run, confidence: 0.90)"


def test_line_count(spark):
    for t, n in (("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), (None, 0)):
        assert one(spark, text.line_count(F.lit(t).cast("string"))) == n


def test_merge_is_a_left_fold(spark):
    rows = [("f", "py", i, a, b, "function", f"s{i}", f"c{i}") for i, (a, b) in enumerate([(1, 3), (4, 6), (7, 20), (21, 22), (23, 25), (26, 40)])]
    df = spark.createDataFrame(rows, "file_path string, language string, seq int, start_line int, end_line int, chunk_type string, symbol_name string, content string")
    got = [(r["start_line"], r["end_line"], r["chunk_type"], r["symbol_name"], r["content"]) for r in ingest.merge_small(df, min_lines=7).orderBy("ordinal").collect()]
    assert got == [(1, 6, "block", "s0", "c0\nc1"), (7, 20, "function", "s2", "c2"), (21, 25, "block", "s3", "c3\nc4"), (26, 40, "function", "s5", "c5")]


def test_frames_end_with_the_file(spark):
    df = spark.createDataFrame([("f", "\n".join(map(str, range(60)))), ("g", ""), ("h", "x\n")], "path string, content string")
    got = [(r["path"], r["start_line"], r["end_line"]) for r in ingest.line_frames(df, max_tokens=1, overlap=20).orderBy("path", "ordinal").collect()]
    assert got == [("f", 1, 50), ("f", 31, 60), ("h", 1, 1)]


def _edges(spark, pairs):
    rows = [(f"calls:{a}:{b}", a, b, "calls", i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, relationship_type string, seq int")


def test_neighbourhood(spark):
    e = _edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("s", "s")])
    s = spark.createDataFrame([("a",), ("s",)], "start string")
    got = {(r["start"], r["node"], r["distance"]) for r in graph.neighbourhood(e, s, 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "a", 2), ("a", "d", 2), ("s", "s", 1)}
    assert graph.neighbourhood(e, s, 0).count() == 0
    assert {r["node"] for r in graph.neighbourhood(e, s, 99).where("start = 'a'").collect()} == set("abcdefg")
    assert {r["node"] for r in graph.neighbourhood(e, spark.createDataFrame([("c",)], "start string"), 1, callers=True).collect()} == {"a", "b"}


def test_self_loop_once(spark):
    e = _edges(spark, [("s", "s"), ("s", "t")])
    assert graph.edges_of(e, spark.createDataFrame([("s",)], "node string")).count() == 2


def test_caller_is_first_in_range_else_first(spark):
    e = spark.createDataFrame([("f", "f::a", 10, None, 0), ("f", "f::b", 12, 14, 1), ("f", "f::z", 1, 3, 2)], "file_path string, id string, start_line int, end_line int, seq int")
    c = spark.createDataFrame([("f", 13), ("f", 2), ("f", 9), ("g", 1)], "caller_file string, caller_line int")
    got = {(r["caller_file"], r["caller_line"]): r["caller_id"] for r in model.resolve_callers(c, e).collect()}
    assert got == {("f", 13): "f::a", ("f", 2): "f::z", ("f", 9): "f::a", ("g", 1): None}


def test_fusion(spark):
    r = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c")], "list_no int, rank int, item string")
    assert [x["item"] for x in retrieve.rrf(r).orderBy("place").collect()] == ["b", "a", "c"]
    tie = spark.createDataFrame([(0, 0, "x"), (1, 0, "y")], "list_no int, rank int, item string")
    assert [x["item"] for x in retrieve.rrf(tie, k=1).orderBy("place").collect()] == ["x", "y"]


def _packed(items, budget):
    """The packing rule as a loop."""
    out, left = "", budget
    for part, title in ((0, "## Semantic Matches\n"), (1, "\n## Code Entities\n"), (2, "\n## Documentation Sections\n")):
        mine = sorted(x[1:] for x in items if x[0] == part)
        if mine:
            out += title
        for _, head, body in mine:
            if part < 2:
                if len(head + body) > left:
                    break
                out, left = out + head + body, left - len(head + body)
                continue
            if len(body) + len(head) > left:
                body = body[: max(0, left - len(head) - 4)] + "\n..."
            out, left = out + head + body + "\n", left - len(head) - len(body) - 1
            if left <= 0:
                break
    return out


@pytest.mark.parametrize("budget", [10, 60, 100, 5000])
def test_packing(spark, budget):
    items = [(p, i, f"h{p}{i}\n", "" if p == 1 else "b" * (7 * i + 3)) for p in range(3) for i in range(6)]
    df = spark.createDataFrame([("g", *x) for x in items], "g string, part int, place int, head string, body string")
    assert retrieve.pack(df, "g", budget=budget).first()["text"] == _packed(items, budget)


def test_cross_validation(spark):
    e = spark.createDataFrame([("f", "createUser", 0), ("f", "get", 1), ("f", "x", 2), ("g", "createUser", 3)], "file_path string, name string, seq int")
    n = spark.createDataFrame([("f", 0, ["drop"]), ("f", 1, ["create_new_user and get it"]), ("f", 2, [])], "file_path string, seq int, mentions array<string>")
    got = {(r["file_path"], r["name"]): (r["matched"], r["confidence"]) for r in validate.cross_validate(e, n).collect()}
    assert got == {("f", "createUser"): (True, 0.95), ("f", "get"): (True, 0.95), ("f", "x"): (False, 0.9), ("g", "createUser"): (False, 0.9)}


def test_validation_counts(spark):
    v = spark.createDataFrame([(False,), (False,)], "matched boolean")
    r = validate.validation_counts(v, v.limit(1), v.limit(1)).first()
    assert (r["ast_only"], r["cross_validated"], r["llm_only"], r["conflict"]) == (2, 0, 1, True)


def test_dictionary_order(spark):
    df = spark.createDataFrame([("k", 0, "a"), ("m", 1, "b"), ("k", 2, "c")], "key string, seq int, v string")
    assert [tuple(r) for r in last_value_first_place(df, ["key"]).orderBy("seq").collect()] == [("k", 0, "c"), ("m", 1, "b")]


def test_percent_is_half_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (1, 0), (1, 3)], "completed int, total int")
    assert [r["percent"] for r in events.with_percent(df).collect()] == [6.2, 18.8, 33.3]


def test_bad_stage_events_are_skipped(spark):
    rows = [("p", 0, "stage", '{"name": "quality", "status": "running"}'), ("p", 1, "stage", "{bad"), ("p", 2, "log", '{"name": "quality", "status": "no"}'), ("p", 3, "stage", '{"status": "x"}'), ("p", 4, "stage", '{"name": "quality", "status": "done"}')]
    df = spark.createDataFrame(rows, "project string, offset long, event string, data string")
    got = events.stage_states(df, ["project"]).collect()
    assert [(r["name"], r["label"], r["status"], r["first"]) for r in got] == [("quality", "Scoring confidence", "done", 0)]


def test_long_texts_as_joined_lines(spark, monkeypatch):
    """Blocks of three lines give the text that one list of all lines gives, with ties and nulls (F2)."""
    from pyspark.sql import functions as F

    from lodestone.operators import ordered

    monkeypatch.setattr(ordered, "LINES_A_BLOCK", 3)
    rows = [(f"k{i % 3}", i // 4 if i % 5 else None, None if i % 7 == 0 or i > 60 else f"l{i % 11}") for i in range(80)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, seq int, line string").repartition(5)
    want, got = (sorted(map(tuple, f(df, ["k"], F.col("line"), ["seq"], ", ").collect())) for f in (ordered.joined_lines, ordered.long_text))
    assert got == want and len(got) == 4


def test_sections_hold_no_list_of_all_lines(spark, sf):
    """Every list of a block's lines is bounded by the block (F2)."""
    from pyspark.sql import functions as F

    from lodestone.operators import report

    df = spark.createDataFrame([("p", 1)], "project_id string, seq int")
    plan = report._block(0, "T", df, F.col("seq").cast("string"), ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("collect_list") == 2
