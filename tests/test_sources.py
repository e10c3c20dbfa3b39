import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.sources import export, files, playbooks
from lodestone.sources.store import Store


def test_read_tree(spark, tmp_path):
    put = {"a.py": "x = 1\n", "pkg/b.js": "y", "node_modules/c.js": "n", ".hidden/d.py": "h", "skip/e.py": "s", "pkg/f.log": "l", "pkg/keep.log": "k", "bin.py": "a\0b", "pkg/__init__.py": "i", "_lib/g.py": "g", ".gitignore": "skip/\n*.log\n!keep.log\n# note\n"}
    for p, t in put.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r["path"]: (r["language"], r["content"]) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "x = 1\n"), "pkg/b.js": ("javascript", "y"), "pkg/keep.log": ("unknown", "k"), "pkg/__init__.py": ("python", "i"), "_lib/g.py": ("python", "g"), ".gitignore": ("unknown", put[".gitignore"])}
    assert files.tree_bytes(spark, str(tmp_path)) == sum(len(t) for p, t in put.items() if "node_modules" not in p and not p.startswith(".hidden"))
    assert files.head_commit(str(tmp_path)) == "unknown"
    assert files.resolve_repo(spark, str(tmp_path))["branch"] == "main"
    with pytest.raises(FileNotFoundError):
        files.resolve_repo(spark, str(tmp_path / "none"))


def _entity(i, project, name="f"):
    return (f"{project}{i}", project, name, "function", "a.py", i, i + 1, None, "python")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, s.read("code_entities").schema)
    assert s.read("code_entities").count() == 0
    s.append("code_entities", make([_entity(1, "p"), _entity(2, "p"), _entity(1, "q")]))
    s.replace({"code_entities": make([_entity(9, "p")])}, ["p"])
    assert {(r["project_id"], r["start_line"]) for r in s.read("code_entities").collect()} == {("p", 9), ("q", 1)}
    assert s.scan("code_entities", "q").count() == 1 and s.get("code_entities", id="q1").count() == 1
    assert s.delete("code_entities", "p") == 1 and s.read("code_entities").count() == 1
    s.append("code_entities", make([_entity(1, "q")]))
    with pytest.raises(Exception, match="several rows"):
        s.get("code_entities", id="q1").collect()


def test_store_replaces_whole_projects(spark, tmp_path):
    """An empty replacement leaves no stale rows; other projects stay, also in the table that is not partitioned."""
    s = Store(spark, str(tmp_path))
    make = lambda t, rows: spark.createDataFrame(rows, s.read(t).schema)
    s.append("code_entities", make("code_entities", [_entity(1, "p/1 %"), _entity(1, "q"), _entity(1, "r")]))
    s.replace({"code_entities": make("code_entities", [_entity(5, "q"), _entity(6, "r")])}, ["p/1 %", "q"])
    assert {(r["project_id"], r["start_line"]) for r in s.read("code_entities").collect()} == {("q", 5), ("r", 1)}
    s.replace({"code_entities": make("code_entities", [])}, ["q"])
    assert {r["project_id"] for r in s.read("code_entities").collect()} == {"r"}
    project = lambda i, name: (i, name, "/", "main", "sha", "done", None, None, None)
    s.replace({"projects": make("projects", [project("a", "one"), project("b", "two")])}, ["a", "b"])
    s.replace({"projects": make("projects", [project("b", "new")])}, ["b"])
    assert {(r["id"], r["name"]) for r in s.read("projects").collect()} == {("a", "one"), ("b", "new")}
    s.replace({"projects": make("projects", [])}, ["a"])
    assert {r["id"] for r in s.read("projects").collect()} == {"b"}


def test_runs_are_whole_at_any_time(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        s.current_run()
    for i in range(3):
        s.replace_run({"t": spark.range(i)}, f"r{i}")
        assert s.current_run() == f"r{i}" and s.read_run("t").count() == i
    # An older pointer never hides a newer one, nor does a half-written file.
    (tmp_path / "_pointers" / ".half").write_text("x")
    assert s.current_run() == "r2" and len(s._pointers()) == 3


def test_store_upserts_and_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    sec = lambda i, p, n, c: (i, p, n, c, 0.5, None, None)
    make = lambda t, rows: spark.createDataFrame(rows, s.read(t).schema)
    s.upsert_sections(make("documents", [sec("1", "p", "features", "old"), sec("2", "q", "features", "q")]))
    s.upsert_sections(make("documents", [sec("3", "p", "features", "new"), sec("4", "p", "personas", "x")]))
    assert {(r["id"], r["content"]) for r in s.read("documents").collect()} == {("1", "new"), ("4", "x"), ("2", "q")}
    ck = lambda i, h, v: (i, "p", "sha", h, "a.py", v, None)
    s.merge_checkpoints(make("analysis_checkpoints", [ck("1", "h", "first")]))
    s.merge_checkpoints(make("analysis_checkpoints", [ck("2", "h", "second"), ck("3", "k", "other")]))
    assert {r["result_json"] for r in s.read("analysis_checkpoints").collect()} == {"first", "other"}
    a = spark.range(3)
    s.replace_run({"t": a}, "r1")
    s.replace_run({"t": a.limit(1)}, "r2")
    assert s.read_run("t").count() == 1


def test_exports(spark, tmp_path):
    body = "# Features\n\n**bold** `code` <tag> [l](http://x)\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n- one\n- two\n\n```py\nx < 1\n```\n"
    df = spark.createDataFrame([("p", "features", "Main Application Features", body, 0.5), ("p", "executive_overview", "Executive Overview", "# E", 0.9)], "project_id string, section_name string, title string, content string, confidence double")
    html = export.export(df, "html", F.lit("now")).first()["text"]
    for part in ("<h1>Features</h1>", "<strong>bold</strong>", "<code>code</code>", "&lt;tag&gt;", '<a href="http://x">l</a>', "<tr><td>A</td><td>B</td></tr>\n<tr><td>1</td><td>2</td></tr>", "<ul>\n<li>one</li>\n<li>two</li>", '<pre><code class="py">x &lt; 1</code></pre>'):
        assert part in html, part
    assert html.index("<h1>E</h1>") < html.index("<h1>Features</h1>")
    with pytest.raises(ValueError, match="unknown export"):
        export.export(df, "docx", F.lit(""))
    export.write_layout(df, "p", str(tmp_path), "markdown", "now")
    assert (tmp_path / "sections" / "02-features.md").read_text() == body and (tmp_path / "metadata.json").exists()
    logged = export.request_log(df.select("project_id", F.repeat(F.lit("q"), 500).alias("query"))).first()["value"]
    assert logged.count("q") < 210


def test_playbooks(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("title: A\nmcp_prompt: fix_bug\nsteps:\n- tool: explain_symbol\n  description: d\n")
    assert [(r["name"], r["step"], r["tool"]) for r in playbooks.playbooks(spark, str(tmp_path)).collect()] == [("a", 1, "explain_symbol")]
    (tmp_path / "b.yaml").write_text("mcp_prompt: nope\n")
    with pytest.raises(ValueError, match="unknown prompt"):
        playbooks.load_playbook(str(tmp_path), "b")
    with pytest.raises(ValueError, match="bad playbook"):
        playbooks.load_playbook(str(tmp_path), "../a")


def test_titles():
    assert list(K.SECTION_TITLES) == list(K.GATES) or set(K.SECTION_TITLES) == set(K.GATES)


def test_steps_tell_what_is_not_allowed(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("title: A\nmcp_prompt: fix_bug\nsteps:\n- tool: explain_symbol\n- tool: dig\n")
    (tmp_path / "b.yaml").write_text("mcp_prompt: nope\nsteps:\n- tool: explain_symbol\n")
    (tmp_path / "c.txt").write_text("no: playbook")
    assert [(r["name"], r["step"], r["problem"]) for r in playbooks.steps(spark, str(tmp_path)).collect()] == [("a", 1, None), ("a", 2, "a: unknown tool dig"), ("b", 1, "b: unknown prompt nope")]
    with pytest.raises(Exception, match="unknown"):
        playbooks.playbooks(spark, str(tmp_path)).collect()
