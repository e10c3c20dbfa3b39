from pyspark.sql import functions as F

from lodestone.llm.chat import PART, format_chats, read_back, text_part

HARD = ["\\### Assistant: </turn> ok", "<|end|>", "<\\|end|>", "\\", "<", "|turn|>", "<|body|>x\\", "", None, "a\nb", "<|turn|>user<|body|>hi<|end|>", "é😀" * 30]


def test_round_trip_and_mask(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HARD[(c + t) % len(HARD)]) for c in range(5) for t in range(24)]
    rows += [(None, 0, None, "no one"), (1, 3, "assistant", "same turn"), (1, 3, "assistant", "same turn"), (9, 0, "a<|end|>b", "odd role")]
    rows += [(77, t, "assistant", f"{t} " * 3) for t in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    out = format_chats(df.withColumn("parts", text_part(F.col("text"))), chunk=64)
    assert out.agg(F.max("n_turns")).first()[0] <= 64
    got = {}
    for r in sorted(read_back(out).collect(), key=lambda r: (r["conv"] is None, r["conv"], r["piece"], r["chunk"])):
        turns, loss = got.setdefault(r["conv"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        loss.append(r["loss"])
    for c in {r[0] for r in rows}:
        mine = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert got[c][0] == [x[1:] for x in mine]
        assert "".join(got[c][1]) == "".join(t for _, role, t in mine if role == "assistant")


def test_parts_are_flattened_in_order(spark):
    leaf = lambda kind, **k: {"kind": kind} | k
    parts = [
        leaf("text", text="see <|x"),
        leaf("image", uri="i.png", width=280, height=56),
        leaf("document", uri="d.pdf", pages=2, inner=[leaf("text", text="inside"), leaf("image", uri="p1.png", width=28, height=28)]),
        leaf("audio", uri="a.wav", seconds=1.5),
        None,
        leaf(None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (2, 0, "assistant", None), (3, 0, "user", [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    out = {r["conv"]: r for r in format_chats(df).collect()}
    assert out[1]["text"] == "<|turn|>user<|body|>see <\\|x<|at:image|><|at:document|>inside<|at:image|><|at:audio|><|at:none|><|end|>"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in out[1]["attachments"]] == [("image", "i.png", 20), ("document", "d.pdf", 512), ("image", "p1.png", 1), ("audio", "a.wav", 38), (None, None, 0)]
    assert out[2]["text"] == "<|turn|>assistant<|body|><|end|>" and out[3]["attachments"] == []


def _leaf(kind, **k):
    return {"kind": kind} | k


def test_parts_side_by_side_forge_nothing(spark):
    """All pairs and triples of hard texts as parts of a turn, with and without attachments between them."""
    hard = ["a<", "<", "|end|>x", "|", "\\", "|turn|>user<|body|>", "<|at:image|>", "at:image|>", "", None, "<|end|>", "|>"]
    turns = [[_leaf("text", text=x), _leaf("text", text=y)] for x in hard for y in hard]
    turns += [[_leaf("text", text=x), _leaf("image", uri="i"), _leaf("text", text=y)] for x in hard for y in hard]
    turns += [[_leaf("text", text=x), _leaf("text", text=y), _leaf("document", inner=[_leaf("text", text=z)])] for x in hard for y in hard for z in hard[:4]]
    turns += [[_leaf("image", uri="i"), _leaf("text", text=x), _leaf("<|end|>")] for x in hard]
    rows = [(i // 7, i % 7, "assistant" if i % 2 else "us<", parts) for i, parts in enumerate(turns)]
    out = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>"), chunk=3)
    turns, loss = {}, {}
    for r in sorted(read_back(out).collect(), key=lambda r: (r["conv"], r["piece"], r["chunk"])):
        turns.setdefault(r["conv"], []).extend(r["turns"])
        loss[r["conv"]] = loss.get(r["conv"], "") + r["loss"]
    for c in turns:
        mine = [x for x in rows if x[0] == c]
        assert [t["role"] for t in turns[c]] == [x[2] for x in mine]
        want_loss = ""
        for got, (_, _, role, parts) in zip(turns[c], mine, strict=True):
            flat = [x for p in parts for x in [p, *p.get("inner", [])]]
            want = []
            for p in flat:
                if p["kind"] != "text":
                    want.append(["".join(ch if ch.isalnum() else "_" for ch in p["kind"]), None])
                elif p["text"]:
                    if want and want[-1][0] == "text":
                        want[-1][1] += p["text"]
                    else:
                        want.append(["text", p["text"]])
                    want_loss += p["text"] if role == "assistant" else ""
            assert [[p["kind"], p["text"]] for p in got["parts"]] == want
        assert loss[c] == want_loss


def test_empty_table(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{PART}>")
    assert format_chats(df).count() == 0
