"""Line deduplication by a log-template tree [native].

Method: a line's tokens that hold a digit, an at sign or a scheme are variable fields, if words
enough are left beside them: DEPTH, and SIMILAR of all tokens; else the line, such as a row of a
table or a list of links, is compared as it is. Lines
fall through a tree of fixed depth: token count first, then the DEPTH leading tokens, then, in
leaves that enough documents reach, the branch token: of the tokens past the path that enough
distinct lines of the leaf have at the same position, the one that the fewest have. So families
of lines that begin alike, and ordinary lines among them, come to different branches, however
many there are. In each branch positions whose tokens vary over its distinct lines are
generalised too: where one token holds at least SHARE of them, it is constant. If enough
positions are constant, at least the path and one more and SIMILAR of all, the constants are
the branch's template and all lines that have them are its instances; other lines are templates
of their own. Templates that occur in enough documents recur: their lines are dropped from all
documents but the one whose text has the smallest MD5. Enough is min_docs, but LONG_DOCS from
LONG_TOKENS tokens on, as a long passage is no chance meeting, and SHORT_DOCS under MIN_TOKENS
tokens, where many documents must share the very line; there a line needs a letter.

Documents with equal texts count as one document and get the same lines dropped; finding
copies is another operator's job.

Leaves, lines, and tokens at their places are told apart by 64-bit hashes. All lines are shuffled as hashes only; texts move for lines in leaves that recur, and once
for the documents that lose lines: a bitmap of fixed size tells all but a few others, which stay
where they are. Leaf tables are broadcast up to BROADCAST_ROWS rows, else joined by a shuffle.

Defined results: null text stays null with 0 lines; an empty text is one empty line; lines
end at line feeds; a document that loses all lines keeps an empty text; repeated rows are
kept; an empty table gives no rows; extra columns pass through, but for those whose name
starts with _line_, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import named, without_reserved
from lodestone.runtime import Scratch

DEPTH = 3
SHARE = 0.6
SIMILAR = 0.7
MIN_DOCS = 5
MIN_TOKENS = 3
LONG_TOKENS, LONG_DOCS = 20, 2
SHORT_DOCS = 100
BROADCAST_ROWS = 100_000
LINES_A_FILE = 100_000
FIELD = "<*>"
#: A whole token that is a variable field; each token is run through once, however long it is.
FIELD_TOKEN = r"(?<![^ ])[^ ]*?(?:[0-9@]|://)[^ ]*"
#: A whole token that has a letter and is no variable field.
WORD_TOKEN = r"(?<![^ ])(?![^ ]*?(?:[0-9@]|://))[^ ]*?\p{L}[^ ]*"
WORDS = 1 << 18  # of 64 bits each, in the bitmap of documents that lose lines


def spaced(line: Column) -> Column:
    """A line's tokens joined by single spaces; most lines are that already, which cheap tests tell."""
    odd = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\r", "\f", "\x0B"):
        odd = odd | line.contains(c)
    return F.when(odd, F.btrim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """A spaced line with variable fields as <*>."""
    return F.when(_field(line), F.regexp_replace(line, FIELD_TOKEN, FIELD)).otherwise(line)


def _field(x: Column) -> Column:
    return x.rlike("[0-9@]") | x.contains("://")


def generalised(line: Column, n: Column) -> Column:
    """A spaced line of n tokens, masked if it has words enough outside its variable fields."""
    words = F.regexp_count(line, F.lit(WORD_TOKEN))
    return F.when(_field(line) & (words >= F.greatest(F.lit(DEPTH), F.ceil(n * SIMILAR))), masked(line)).otherwise(line)


def enough_docs(n: Column, min_docs: int) -> Column:
    """In how many documents a template of n tokens recurs."""
    return F.when(n < MIN_TOKENS, max(min_docs, SHORT_DOCS)).when(n >= LONG_TOKENS, min(min_docs, LONG_DOCS)).otherwise(min_docs)


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, no, line, n, leaf) of every line that may recur; doc is the text's MD5, line is spaced."""
    t = docs.where(named(text_col).isNotNull()).select(F.unhex(F.md5(named(text_col))).alias("doc"), F.split(named(text_col), "\n").alias("l"))
    # A split is never empty, so the outer form gives the same rows, without a filter that splits each text again.
    t = t.select("doc", F.posexplode_outer("l").alias("no", "line")).withColumn("line", spaced(F.col("line")))
    t = t.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).where((F.col("n") >= MIN_TOKENS) | F.col("line").rlike(r"\p{L}"))
    # The path takes the leading tokens alone, so whole lines are masked later, where they matter.
    return t.withColumn("leaf", F.xxhash64("n", masked(F.substring_index("line", " ", DEPTH))))


def recurring_lines(docs: DataFrame, scratch: Scratch, *, text_col: str, min_docs: int) -> DataFrame:
    """(doc, gone): of each distinct text that loses lines their sorted numbers."""
    lines = _lines(docs, text_col)
    enough = enough_docs(F.col("n"), min_docs)
    leaves = lines.select("leaf", "n", "doc").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= enough)
    leaves = scratch.keep(leaves.select("leaf"), "leaves", files=32)
    if leaves.count() <= BROADCAST_ROWS:
        leaves = F.broadcast(leaves)
    some = lines.join(leaves, "leaf").withColumn("line", generalised(F.col("line"), F.col("n")))
    some = scratch.keep(some.withColumn("own", F.xxhash64("line")), "lines")
    files = 8 + some.count() // LINES_A_FILE
    kinds = some.groupBy("leaf", "own").agg(F.split(F.first("line"), " ").alias("toks"), F.first("n").alias("n"))
    kinds = scratch.keep(kinds, "kinds", files)
    # A token at its place in its leaf is known by one hash; a line has one token at a place, so (count, at) tells them apart.
    words = kinds.select("leaf", "own", "n", F.posexplode_outer("toks").alias("at", "tok"))
    words = words.where((F.col("at") >= DEPTH) & (F.col("tok") != FIELD)).select("leaf", "own", "n", "at", F.xxhash64("leaf", "at", "tok").alias("word"))
    # The branch of each distinct line: the rarest of its tokens past the path that enough distinct lines share.
    often = words.groupBy("word", "n").count().where(F.col("count") >= enough).select("word", "count")
    branch = words.join(often, "word").groupBy("leaf", "own").agg(F.min(F.struct("count", "at", "word"))["word"].alias("branch"))
    kinds = scratch.keep(kinds.join(branch, ["leaf", "own"], "left"), "branches", files)
    held = kinds.where("branch IS NOT NULL")
    # A template is of two lines at least, so a constant token has two: what has one goes before the next shuffle.
    votes = held.select("leaf", "branch", "n", F.posexplode_outer("toks").alias("at", "tok")).groupBy("leaf", "branch", "n", "at", "tok").count().where("count > 1")
    top = votes.groupBy("leaf", "branch", "n", "at").agg(F.max(F.struct("count", "tok")).alias("top"))
    tops = top.groupBy("leaf", "branch", "n").agg(F.array_sort(F.collect_list(F.struct("at", "top.tok", "top.count"))).alias("fixed"))
    sizes = held.groupBy("leaf", "branch", "n").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    fixed = tops.join(sizes, ["leaf", "branch", "n"]).withColumn("fixed", F.filter("fixed", lambda x: x["count"] >= SHARE * F.col("kinds")))
    alike = F.size(F.filter("fixed", lambda x: x["tok"] != FIELD)) >= F.greatest(F.lit(DEPTH + 1), F.ceil(F.col("n") * SIMILAR))
    fixed = fixed.where(alike).select("leaf", "branch", "fixed")
    fits = F.forall("fixed", lambda x: F.col("toks")[x["at"]] == x["tok"])
    template = F.when(F.coalesce(fits, F.lit(False)), F.col("branch")).otherwise(F.col("own"))
    templates = kinds.join(fixed, ["leaf", "branch"], "left").select("leaf", "own", "n", template.alias("template"))
    templates = scratch.keep(templates, "templates", files)
    found = some.select("leaf", "own", "doc", "no").join(templates, ["leaf", "own"])
    per_doc = found.groupBy("leaf", "template", "n", "doc").agg(F.collect_set("no").alias("nos"))
    per_doc = scratch.keep(per_doc, "found", files)
    again = per_doc.groupBy("leaf", "template", "n").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"))
    again = scratch.keep(again.where(F.col("docs") >= enough).select("leaf", "template", "first"), "again", files=32)
    if again.count() <= BROADCAST_ROWS:  # else a template with very many documents leaves its rows to skew handling
        again = F.broadcast(again)
    gone = per_doc.join(again, ["leaf", "template"]).where(F.col("doc") != F.col("first"))
    gone = scratch.keep(gone.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("nos"))).alias("gone")), "gone", files)
    scratch.drop("lines", "kinds", "branches", "templates", "found", "again")
    return gone


def _may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _line_may: false only where the key is not among keys. The bitmap has at most WORDS rows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(WORDS)).cast("int")
    bit = lambda c: f"cast(pmod(shiftright(xxhash64({c}), 32), 64) AS int)"
    bits = keys.groupBy(place(key).alias("_line_word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit(key)}))").alias("_line_bits"))
    flagged = rows.withColumn("_line_word", place("_line_doc")).join(F.broadcast(bits), "_line_word", "left")
    return flagged.withColumn("_line_may", F.expr(f"coalesce(getbit(_line_bits, {bit('_line_doc')}) = 1, false)")).drop("_line_word", "_line_bits")


def drop_recurring_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text shortened, _line_count (lines before) and _line_gone (numbers of dropped lines, from 0)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = without_reserved(docs, "_line_")
    gone = recurring_lines(docs, scratch, text_col=text_col, min_docs=min_docs)
    text, lines = named(text_col), F.split(named(text_col), "\n")
    rows = _may_hold(docs.withColumn("_line_doc", F.unhex(F.md5(text))), gone, "doc")
    hits = rows.where("_line_may").join(gone.select(F.col("doc").alias("_line_doc"), F.col("gone").alias("_line_gone")), "_line_doc", "left")
    rest = rows.where("NOT _line_may").withColumn("_line_gone", F.lit(None).cast("array<int>"))
    # Inside a lambda an outer expression is taken anew for each element, so the lines are what it runs over.
    kept = F.filter(lines, lambda _, i: ~F.array_contains("_line_gone", i))
    short = F.when(F.col("_line_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    count = F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("_line_count")
    shown = [short.alias(text_col) if c == text_col else named(c) for c in docs.columns]
    none = F.array().cast("array<int>")
    result = lambda df: df.select(*shown, count, F.coalesce("_line_gone", none).alias("_line_gone"))
    return result(hits).union(result(rest))
