"""Extraction of declarations, calls, imports, tables and endpoints from chunks of source code.

chunks(file_path, language, start_line, content, seq). Python is read by its own parser, all
other languages and SQL by a lexer that knows comments, strings and brackets, so that what is
written over several lines is seen like what stands on one. Declarations are those of the top
level; a class names the functions inside it. What cannot be parsed costs the top-level statement
it stands in; the rest of the chunk gives its rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.text import path_params
from lodestone.operators import lexer
from lodestone.operators.lexer import Token
from lodestone.runtime import ship_package

ENTITY = "name string, entity_type string, file_path string, start_line int, end_line int, language string, signature string, docstring string, parent string, children array<string>, seq bigint, ordinal int"
IMPORT = "source_file string, target string, import_type string, symbols array<string>, seq bigint, ordinal int"
ROUTE = "method string, path string, handler_file string, handler_function string, handler_line int, seq bigint, ordinal int"
CALL = "caller_file string, caller_line int, callee string, receiver string, call_type string, seq bigint, ordinal int"
SCHEMA = (
    "name string, source_type string, file_path string, start_line int, "
    "attributes array<struct<name: string, data_type: string, nullable: boolean, primary_key: boolean, constraints: array<string>>>, "
    "relationships array<struct<target_entity: string, relationship_type: string, foreign_key: string>>, seq bigint, ordinal int"
)

_NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "sizeof", "def", "class", "match", "import", "super"}


def _per_chunk(chunks: DataFrame, one: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows of one(chunk) for every chunk, followed by the chunk's seq and their place in it."""
    ship_package(chunks.sparkSession)
    empty = chunks.sparkSession.createDataFrame([], schema).schema
    names = empty.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(empty)
        for b in batches:
            rows = []
            for c in b.to_pylist():
                try:
                    found = one(c)
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                rows += [(*r, c["seq"], i) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kind)

    return chunks.select("file_path", "language", F.col("start_line").cast("int").alias("start_line"), "content", F.col("seq").cast("long").alias("seq")).mapInArrow(run, schema)


def _signature(node: ast.AST, source: str) -> str | None:
    """name(parameters) -> result, as written; None for a class."""
    if isinstance(node, ast.ClassDef):
        return None
    lines = ast.get_source_segment(source, node) or ""
    head = lines[lines.index(node.name) :]
    depth, end = 0, len(head)
    for i, ch in enumerate(head):
        depth += (ch in "([{") - (ch in ")]}")
        if ch == ")" and depth == 0:
            end = i + 1
            break
    back = f" -> {ast.get_source_segment(source, node.returns)}" if node.returns else ""
    return head[:end] + back


#: A line that begins a statement of the top level, and one that only goes on with or decorates what follows.
_TOP_LINE = re.compile(r"[^\s#)\]}]")
_NO_START = re.compile(r"(?:else|elif|except|finally)\b")
#: Parts of a source that does not parse are tried with so many of the following ones.
_PARTS = 4


def _python_tree(source: str) -> ast.Module:
    """The syntax tree; where the source does not parse, of those top-level statements that do.

    An error costs the statement it stands in. Lines keep their numbers.
    """
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        pass
    lines = source.split("\n")
    starts, decorated = [], False
    for i, line in enumerate(lines):
        if _TOP_LINE.match(line) and not _NO_START.match(line):
            if not decorated:
                starts.append(i)
            decorated = line.startswith("@")
        elif line.strip() and not line[0].isspace():
            decorated = False
    ends = [*starts[1:], len(lines)]
    body, at = [], 0
    while at < len(starts):
        for more in range(at, min(at + _PARTS, len(starts))):
            try:
                part = ast.parse("\n".join(lines[starts[at] : ends[more]]))
            except (SyntaxError, ValueError, RecursionError):
                continue
            ast.increment_lineno(part, starts[at])
            body += part.body
            at = more
            break
        at += 1
    return ast.Module(body, [])


def _python_declarations(source: str) -> list[ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef]:
    return [n for n in _python_tree(source).body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]


def _entities(c: dict) -> list[tuple]:
    path, lang, base, text = c["file_path"], c["language"], c["start_line"], c["content"]
    out = []
    if lang == "python":
        for n in _python_declarations(text):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            inner = [x.name for x in n.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)] if kind == "class" else []
            note = ast.get_docstring(n, clean=False)
            out.append((n.name, kind, path, base + n.lineno - 1, base + n.end_lineno - 1, lang, _signature(n, text), note.strip() if note else None, None, inner))
        return out
    for s in lexer.statements(text, lang):
        if d := lexer.declaration(s, text, lang):
            note = s.comment.text.strip("/*").strip() if s.comment and lang in ("javascript", "typescript", "java") else None
            out.append((d.name, d.kind, path, base + s.start, base + s.stop, lang, d.signature, note, None, d.members))
    return out


def entities(chunks: DataFrame) -> DataFrame:
    """Top-level named declarations, with lines from the file's start."""
    return _per_chunk(chunks.where(F.col("language").isin(K.GRAMMAR_LANGUAGES)), _entities, ENTITY)


def _calls(c: dict) -> list[tuple]:
    path, lang, base = c["file_path"], c["language"], c["start_line"]
    out = []
    if lang == "python":
        for n in ast.walk(_python_tree(c["content"])):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Attribute):
                    out.append((n.lineno, n.col_offset, f.attr, ast.unparse(f.value), "direct"))
                else:
                    text = f.id if isinstance(f, ast.Name) else ast.unparse(f)
                    if len(text) < 100:
                        out.append((n.lineno, n.col_offset, text, None, "direct"))
        return [(path, base + line - 1, name, got, kind) for line, _, name, got, kind in sorted(out, key=lambda x: x[:2])]
    toks = [t for t in lexer.tokens(c["content"], lang) if t.kind != "comment"]
    ends, _ = lexer.brackets(toks)
    heads = _heads(toks, lang, ends)
    for i, t in enumerate(toks[:-1]):
        before = toks[i - 1].text if i else ""
        called = toks[i + 1].text == "(" or (lang == "rust" and toks[i + 1].text == "!" and i + 2 < len(toks) and toks[i + 2].text in "([{")
        if t.kind != "name" or not called or t.text in _NOT_CALLS or before in {"function", "func", "fn", "*"} or (before, lang) == ("@", "java"):
            continue
        k = i
        while k >= 2 and toks[k - 1].text in {".", "->", "::"} and toks[k - 2].kind == "name":
            k -= 2
        if i in heads or _declares(toks, i, k, lang, ends):
            continue
        receiver = c["content"][toks[k].at : toks[i - 1].at] if k < i else None
        made = k > 0 and toks[k - 1].text == "new"
        out.append((path, base + t.line, t.text, receiver, "constructor" if made else "direct"))
    return out


def _heads(toks: list[Token], lang: str, ends: dict[int, int]) -> set[int]:
    """Places of names before brackets that call nothing: Go's methods, Rust's visibility and attributes."""
    out: set[int] = set()
    for i, t in enumerate(toks[:-1]):
        after = toks[i + 1].text
        if lang == "go" and t.text == "func" and after == "(":
            out.add(ends.get(i + 1, i) + 1)
        elif lang == "go" and t.text == "interface" and after == "{":
            out.update(range(i + 2, ends.get(i + 1, i)))
        elif lang == "rust" and t.text == "pub":
            out.add(i)
        elif lang == "rust" and after == "[" and (t.text == "#" or (t.text == "!" and i and toks[i - 1].text == "#")):
            out.update(range(i + 2, ends.get(i + 1, i)))
    return out


def _declares(toks: list[Token], i: int, k: int, lang: str, ends: dict[int, int]) -> bool:
    """True where name(...) is the head of a function with a body, not a call."""
    qualified = lang == "cpp" and k < i and toks[i - 1].text == "::"  # a member's body outside its class
    if (i != k and not qualified) or k == 0:
        return False
    end = ends.get(i + 1, len(toks) - 1)
    after = toks[end + 1].text if end + 1 < len(toks) else ""
    before = toks[k - 1]
    if lang in ("c", "cpp", "java"):
        typed = (before.kind == "name" and before.text not in {"return", "new", "else", "throw"}) or before.text in {">", "&", "]"}
        return typed and after in ({"{", "const"} if qualified else {"{", "throws", "const", ";"})
    return before.text in {"{", "}", ";", "async", "static", "get", "set", "public", "private", "protected"} and after in {"{", ":"}


def calls(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Call sites, with confidence high where the callee is a known(name)."""
    c = _per_chunk(chunks.where(F.col("language").isin(K.GRAMMAR_LANGUAGES)), _calls, CALL)
    k = known.select(F.col("name").alias("callee")).distinct().withColumn("_k", F.lit(1))
    return c.join(k, "callee", "left").select(*c.columns, F.when(F.col("_k") == 1, "high").otherwise("low").alias("confidence"))


def _is(t: Token, *words: str) -> bool:
    return t.kind == "name" and t.text.upper() in words


def _words(toks: list[Token], source: str) -> list[str]:
    """What white space separates in a run of tokens."""
    out: list[str] = []
    for i, t in enumerate(toks):
        if i and toks[i - 1].end == t.at:
            out[-1] += t.text
        else:
            out.append(t.text)
    return [w for x in out for w in x.split()]


def _column(part: list[Token], source: str) -> dict | None:
    """A column: its name, its second word as the type, and what its other words say."""
    words = _words(part, source)
    if len(words) < 2 or words[0].upper() in K.TABLE_CONSTRAINTS:
        return None
    pairs = list(zip(part, part[1:], strict=False))
    limits = ["unique"] if any(_is(t, "UNIQUE") for t in part) else []
    for i, t in enumerate(part[:-1]):
        if _is(t, "DEFAULT"):
            limits.append("default:" + _words(part[i + 1 :], source)[0].lower())
            break
    return {
        "name": words[0],
        "data_type": words[1],
        "nullable": not any(_is(a, "NOT") and _is(b, "NULL") for a, b in pairs),
        "primary_key": any(_is(a, "PRIMARY") and _is(b, "KEY") for a, b in pairs),
        "constraints": limits,
    }


def _foreign_key(part: list[Token]) -> dict | None:
    """FOREIGN KEY (column) REFERENCES table."""
    if len(part) < 7 or not (_is(part[0], "FOREIGN") and _is(part[1], "KEY") and part[2].text == "("):
        return None
    end = lexer.closing(part, 2)
    if end != 4 or end + 2 >= len(part) or not _is(part[end + 1], "REFERENCES"):
        return None
    return {"target_entity": part[end + 2].text, "relationship_type": "one_to_many", "foreign_key": part[3].text}


def _tables(c: dict) -> list[tuple]:
    source = c["content"]
    toks = [t for t in lexer.tokens(source, "sql") if t.kind != "comment"]
    out, i = [], 0
    while i + 3 < len(toks):
        name = i + 2
        if not (toks[i].first and _is(toks[i], "CREATE") and _is(toks[i + 1], "TABLE")):
            i += 1
            continue
        if [t.text.upper() for t in toks[name : name + 3]] == ["IF", "NOT", "EXISTS"]:
            name += 3
        if name + 1 >= len(toks) or toks[name].kind != "name" or toks[name + 1].text != "(":
            i += 1
            continue
        end = lexer.closing(toks, name + 1)
        parts = list(lexer.split_at(toks[name + 2 : end])) if toks[end].text == ")" else []  # else it never ends
        links = [k for k in map(_foreign_key, parts) if k]
        columns = [k for p in parts if not _foreign_key(p) and (k := _column(p, source))]
        out.append((toks[name].text, "sql_definition", c["file_path"], c["start_line"] + toks[i].line, columns, links))
        i = end + 1
    return out


def sql_tables(chunks: DataFrame) -> DataFrame:
    return _per_chunk(chunks.where("language = 'sql'"), _tables, SCHEMA)


def _called(node: ast.AST | None) -> str | None:
    """The name of a plainly named function that an expression calls."""
    return node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None


def _root(node: ast.AST) -> str:
    """The word that an argument begins with."""
    while isinstance(node, ast.Call | ast.Attribute | ast.Subscript):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node.id if isinstance(node, ast.Name) else "unknown"


def _keyword(call: ast.Call, name: str):
    """The constant that a keyword argument has."""
    return next((k.value.value for k in call.keywords if k.arg == name and isinstance(k.value, ast.Constant)), None)


def _mapped_field(node: ast.stmt) -> tuple[str, ast.Call] | None:
    """(name, call) of `name = call(...)` and `name: call(...)`."""
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call):
        return node.targets[0].id, node.value
    if isinstance(node, ast.AnnAssign) and node.value is None and isinstance(node.target, ast.Name) and isinstance(node.annotation, ast.Call):
        return node.target.id, node.annotation
    return None


def _orm(c: dict) -> list[tuple]:
    out = []
    for n in _python_tree(c["content"]).body:
        if not isinstance(n, ast.ClassDef) or not any(w in ast.unparse(b) for b in [*n.bases, *(k.value for k in n.keywords)] for w in K.ORM_BASES):
            continue
        fields = [f for f in map(_mapped_field, n.body) if f]
        columns = [
            {"name": name, "data_type": _root(call.args[0]) if call.args else call.keywords[0].arg, "nullable": _keyword(call, "nullable") is not False,
             "primary_key": _keyword(call, "primary_key") is True, "constraints": []}
            for name, call in fields if _called(call) in K.ORM_COLUMNS and (call.args or call.keywords)
        ]
        links = []
        for _, call in fields:
            if _called(call) == "relationship" and call.args:
                to = call.args[0]
                links.append({"target_entity": to.value if isinstance(to, ast.Constant) else _root(to), "relationship_type": "one_to_many", "foreign_key": None})
        if columns:
            out.append((n.name, "orm_model", c["file_path"], c["start_line"] + n.lineno - 1, columns, links))
    return out


def orm_models(chunks: DataFrame) -> DataFrame:
    return _per_chunk(chunks.where("language = 'python'"), _orm, SCHEMA)


def _python_imports(text: str) -> list[tuple]:
    """(target, kind, symbols) in the order of their lines, wherever they stand."""
    out = []
    for n in ast.walk(_python_tree(text)):
        if isinstance(n, ast.Import):
            out += [(n.lineno, i, a.name, "module", []) for i, a in enumerate(n.names)]
        elif isinstance(n, ast.ImportFrom):
            names = [a.name for a in n.names]
            out.append((n.lineno, 0, "." * n.level + (n.module or ""), "wildcard" if names == ["*"] else "symbol", names))
    return [x[2:] for x in sorted(out, key=lambda x: x[:2])]


def _script_import(toks: list[Token]) -> tuple | None:
    """import ... from 'target', its braces naming symbols."""
    source = next((b for a, b in zip(toks, toks[1:], strict=False) if a.text == "from" and b.kind == "string"), None)
    if source is None:
        return None
    names: list[str] = []
    braces = next((i for i, t in enumerate(toks) if t.text == "{"), None)
    if braces is not None:
        for part in lexer.split_at(toks[braces + 1 : lexer.closing(toks, braces)]):
            named = [t.text for t in part if t.kind == "name" and t.text != "type"]
            names += named[:1]
    return source.value, "symbol" if names else "module", names


def _path(toks: list[Token], joints: set[str]) -> str:
    """The names and joints that a run begins with, as one text."""
    out = ""
    for t in toks:
        if t.kind != "name" and t.text not in joints:
            break
        if t.kind == "name" and out and out[-1] not in ".:":
            break
        out += t.text
    return out


def _imports(c: dict) -> list[tuple]:
    path, lang, text = c["file_path"], c["language"], c["content"]
    if lang == "python":
        return [(path, *x) for x in _python_imports(text)]
    out: list[tuple] = []
    for s in lexer.statements(text, lang):
        t = s.toks
        if lang in ("javascript", "typescript"):
            if t[0].text == "import" and (got := _script_import(t)):
                out.append(got)
            for a, b, d, e in zip(t, t[1:], t[2:], t[3:], strict=False):
                if (a.text, b.text, d.kind, e.text) == ("require", "(", "string", ")"):
                    out.append((d.value, "module", []))
        elif lang == "java" and t[0].text == "import":
            rest = t[2:] if len(t) > 1 and t[1].text == "static" else t[1:]
            if name := _path(rest, {"."}):
                whole = name.endswith(".")
                out.append((name.rstrip("."), "wildcard" if whole else "symbol", []))
        elif lang == "go" and t[0].text == "import":
            out += [(x.value, "module", []) for x in t if x.kind == "string"]
        elif lang == "rust" and "use" in (words := [x.text for x in t[:5]]) and all(w in {"pub", "(", ")", "crate", "super"} for w in words[: words.index("use")]):
            if name := _path(t[words.index("use") + 1 :], {"::"}):
                out.append((name, "module", []))
        elif lang in ("c", "cpp") and t[0].text == "#" and len(t) > 2 and t[1].text == "include":
            if t[2].kind == "string":
                out.append((t[2].value, "module", []))
            elif t[2].text == "<":
                out.append((text[t[2].end : next((x.at for x in t[3:] if x.text == ">"), t[-1].end)], "module", []))
    return [(path, *x) for x in out]


def imports(chunks: DataFrame) -> DataFrame:
    """(source_file, target, import_type, symbols, seq, ordinal) of each language's imports, over any number of lines."""
    return _per_chunk(chunks.where(F.col("language").isin(K.GRAMMAR_LANGUAGES)), _imports, IMPORT)


def _python_routes(text: str) -> list[tuple]:
    """(line, methods, path, handler) of decorators that name a verb or a route."""
    out = []
    for n in ast.walk(_python_tree(text)):
        for d in getattr(n, "decorator_list", []):
            f = d.func if isinstance(d, ast.Call) else None
            if not isinstance(f, ast.Attribute) or not isinstance(f.value, ast.Name) or not d.args or not isinstance(d.args[0], ast.Constant) or not isinstance(d.args[0].value, str):
                continue
            if f.attr.lower() in K.HTTP_VERBS:
                methods = [f.attr.upper()]
            elif f.attr == "route":
                listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                methods = [x.value.upper() for x in getattr(listed, "elts", []) if isinstance(x, ast.Constant)] or ["GET"]
            else:
                continue
            near = not isinstance(n, ast.ClassDef) and n.lineno - d.lineno <= K.HANDLER_LINES
            out.append((d.lineno, methods, d.args[0].value, n.name if near else "unknown"))
    return sorted(out, key=lambda x: x[0])


def _script_routes(text: str, lang: str) -> list[tuple]:
    """Calls like `app.get('/path'`; the first of a line counts."""
    toks = [t for t in lexer.tokens(text, lang) if t.kind != "comment"]
    out: dict[int, tuple] = {}
    for who, dot, verb, opened, path in zip(toks, toks[1:], toks[2:], toks[3:], toks[4:], strict=False):
        quoted = path.kind == "string" and path.text[0] in "'\"" and path.value
        if who.kind == "name" and dot.text == "." and verb.text.lower() in K.HTTP_VERBS and opened.text == "(" and quoted:
            out.setdefault(who.line, (who.line + 1, [verb.text.upper()], path.value, "anonymous"))
    return list(out.values())


def _routes(c: dict) -> list[tuple]:
    found = _python_routes(c["content"]) if c["language"] == "python" else _script_routes(c["content"], c["language"])
    return [(m, path, c["file_path"], handler, c["start_line"] + line - 1) for line, methods, path, handler in found for m in methods]


def endpoints(chunks: DataFrame) -> DataFrame:
    """(method, path, handler_file, handler_function, handler_line, parameters, seq, ordinal): one row per method."""
    rows = _per_chunk(chunks.where(F.col("language").isin("python", "javascript", "typescript")), _routes, ROUTE)
    return rows.select("method", "path", "handler_file", "handler_function", "handler_line", path_params(F.col("path")).alias("parameters"), "seq", "ordinal")


def declaration_chunks(files: DataFrame, *, frame: int = 300) -> DataFrame:
    """files(path, language, content) -> chunks per top-level declaration: (file_path, language, start_line, end_line, chunk_type, symbol_name, content, seq).

    What stands before the first declaration is a block; a declaration over frame lines is
    cut; code after or between declarations belongs to none. Files without one, languages
    without a grammar, and files that do not parse are one block.
    """
    kinds = "file_path string, language string, start_line int, end_line int, chunk_type string, symbol_name string, content string, seq bigint, ordinal int"

    def one(c: dict) -> list[tuple]:
        text, lang, path = c["content"] or "", c["language"], c["file_path"]
        lines = text.split("\n")
        spans: list[tuple[int, int, str, str]] = []
        if lang == "python":
            try:
                for n in _python_declarations(text):
                    first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                    spans.append((first, n.end_lineno, "class" if isinstance(n, ast.ClassDef) else "function", n.name))
            except SyntaxError:
                spans = []
        elif lang in K.GRAMMAR_LANGUAGES:
            spans = [(s.start + 1, s.stop + 1, d.kind, d.name) for s in lexer.statements(text, lang) if (d := lexer.declaration(s, text, lang))]
        out = []
        if not spans:
            return [(path, lang, 1, len(lines), "block", None, text)] if text else []
        if spans[0][0] > 1 and "".join(lines[: spans[0][0] - 1]).strip():
            out.append((path, lang, 1, spans[0][0] - 1, "block", None, "\n".join(lines[: spans[0][0] - 1])))
        for s, e, k, n in spans:
            for a in range(s, e + 1, frame):
                b = min(a + frame - 1, e)
                out.append((path, lang, a, b, k, n, "\n".join(lines[a - 1 : b])))
        return out

    f = files.select(F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), "content", F.xxhash64("path").alias("seq"))
    return _per_chunk(f, one, kinds).withColumn("seq", F.col("ordinal").cast("long")).drop("ordinal")
