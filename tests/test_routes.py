"""Sections made anew, exports and histories from the stored tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import report
from lodestone.sources import routes
from lodestone.sources.store import SCHEMAS, Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = [(f"e{i}", p, f"load_{i}", kind, f"app/m{i % 3}.py", i, i + 4, f"load_{i}(x)", "python") for p in ("p", "q") for i, kind in enumerate(["function", "class", "endpoint", "table"] * 3)]
    s.append("code_entities", spark.createDataFrame(rows, SCHEMAS["code_entities"]))
    return s


def test_a_section_is_made_anew_and_kept(spark, store):
    first = routes.regenerate(store, "p", "features").first()
    assert first["id"] == "p:features" and first["content"].startswith("# ")
    again = routes.regenerate(store, "p", "features").first()
    assert (again["content"], again["created_at"]) == (first["content"], first["created_at"])
    assert store.read("documents").count() == 1
    with pytest.raises(ValueError, match="unknown section"):
        routes.regenerate(store, "p", "poetry")
    with pytest.raises(LookupError):
        routes.regenerate(store, "nobody", "features")
    assert store.read("documents").count() == 1


def test_every_section_can_be_made_from_stored_entities(store):
    rows = report.sections(routes.stored_model(store, ["p"])).collect()
    assert {r["section_name"] for r in rows} == set(report.SECTIONS) and {r["project_id"] for r in rows} == {"p"}


def test_exports_and_history(spark, store):
    for name in ("features", "data_models"):
        routes.regenerate(store, "q", name)
    text = routes.export_project(store, "q", "markdown", F.lit("now")).first()["text"]
    assert text.count("# ") >= 2
    t = datetime(2024, 1, 1)
    rows = [(str(i), "c", "user", f"m{i}", None, t.replace(minute=59 - i)) for i in range(4)] + [("9", "d", "user", "other", None, t)]
    store.append("messages", spark.createDataFrame(rows, SCHEMAS["messages"]))
    assert [r["content"] for r in routes.history(store, "c").collect()] == ["m3", "m2", "m1", "m0"]
    assert [r["content"] for r in routes.history(store, "c", 2).collect()] == ["m1", "m0"]
