import hashlib
import re

import pytest
from compare import duck, same
from pyspark.sql import functions as F

from lodestone.llm.infill import checkpoints, fill_in_middle, restore
from lodestone.llm.queries import op13_infill
from lodestone.llm.sql import op13_infill as SQL

TEXTS = [
    "", None, "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\r\n x\n\U0001f600 y\nlast", "has <P> inside\nx", "a<S>\n", "<M>", "ends with <\nS>\n<\n",
    "".join(f"líne {i}\n" for i in range(1000)), "no end " * 20_000, "\n" * 5_000, "<" * 50 + "\nP>S>M>\n",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"a {i}\nb\n\nc {i}\nd") for i in range(60)] + [(None, "a\nb\nc"), (7, TEXTS[7]), (7, "other\ntext\n")]


def _brute(i, text, seed="7", rate=100, spm_rate=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"step": 1}, {"step": 3, "rate": 40, "spm_rate": 90, "seed": "x"}])
def test_against_brute_force_and_back(spark, options):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    out = fill_in_middle(docs, **options).withColumn("back", restore(F.col("_fim_output"), F.col("_fim_form"))).collect()
    brute = {k: v for k, v in options.items() if k != "step"}
    assert len(out) == len(ROWS)
    for r in out:
        got = (r["_fim_units"], r["_fim_form"], r["_fim_prefix_chars"], r["_fim_middle_chars"], r["_fim_output"])
        assert got == _brute(r["doc_id"], r["text"], **brute)
        assert r["back"] == (r["text"] or "")
    if not options:
        assert {r["_fim_form"] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("step", [1, 2, 7, 64])
def test_every_cut_of_the_index(step):
    for t in TEXTS[2:12] + ["".join(f"ß{i}\n" for i in range(150)), "".join(f"ß{i}\n" for i in range(128))]:
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        index = checkpoints(t.encode(), step)
        assert index.units == len(units) and len(index.bytes_at) <= len(units) // step + 2
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(none).count() == 0
    docs = spark.createDataFrame(ROWS, "`my.id` long, `my.text` string").withColumns({"n": F.lit(1), "_fim_output": F.lit(2), "form": F.array(F.lit(1))})
    got = fill_in_middle(docs, id_col="my.id", text_col="my.text")
    assert got.columns == ["my.id", "my.text", "n", "form", "_fim_units", "_fim_form", "_fim_prefix_chars", "_fim_middle_chars", "_fim_output"]
    assert got.count() == len(ROWS)
    with pytest.raises(ValueError):
        fill_in_middle(docs, id_col="my.id", text_col="my.text", step=0)


def test_query(spark, sf):
    same(op13_infill(spark, sf), duck(sf).execute(SQL))
