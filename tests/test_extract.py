"""Extraction over several lines, in every language, and of hostile sources."""

import time

import pytest

from lodestone.operators import extract as X
from lodestone.operators import lexer


def _c(language, content):
    return {"file_path": "f", "language": language, "start_line": 1, "content": content, "seq": 0}


IMPORTS = [
    ("typescript", "import {\n  a,\n  b as c,\n} from './x'\nimport * as n from \"y\";\nimport './side';\nconst z = require(\n  'z'\n)\n", [("./x", "symbol", ["a", "b"]), ("y", "module", []), ("z", "module", [])]),
    ("javascript", "// import q from 'q'\nimport d, { e } from 'm' // import 'no'\n", [("m", "symbol", ["e"])]),
    ("python", "from .a import (\n    b,\n    c as d,\n)\nimport x.y as z, w\nif True:\n    from q import *\n", [(".a", "symbol", ["b", "c"]), ("x.y", "module", []), ("w", "module", []), ("q", "wildcard", ["*"])]),
    ("go", 'package m\nimport (\n  "fmt"\n  h "net/http"\n)\nimport "os"\nvar s = "no"\n', [("fmt", "module", []), ("net/http", "module", []), ("os", "module", [])]),
    ("rust", "pub use std::{\n  io,\n};\nuse a::b as c;\n", [("std::", "module", []), ("a::b", "module", [])]),
    ("java", "import a.b.C; // import d.E;\nimport static\n  x.Y.*;\n", [("a.b.C", "symbol", []), ("x.Y", "wildcard", [])]),
    ("cpp", '#include <vector>\n  #  include "a/b.h" // c\nint x;\n', [("vector", "module", []), ("a/b.h", "module", [])]),
]


@pytest.mark.parametrize(("language", "text", "want"), IMPORTS)
def test_imports(language, text, want):
    assert [x[1:] for x in X._imports(_c(language, text))] == want


DECLARATIONS = [
    ("javascript", "const a = () => { return 1 }\nexport default async function go(\n  a,\n  b\n) {\n  function inner() {}\n}\nclass A { m() {} static n(x) { o(); } }\n", [("go", "function", 2, 7, []), ("A", "class", 8, 8, ["m", "n"])]),
    ("typescript", "type T = { a: string }\nexport interface I<X>\n  extends J {\n  f(): void\n}\nabstract class C {}\n", [("T", "interface", 1, 1, []), ("I", "interface", 2, 5, []), ("C", "class", 6, 6, [])]),
    ("go", "func (s *Srv) Run(\n a int,\n) error {\n if x { y() }\n}\ntype I interface {\n F()\n}\n", [("Run", "function", 1, 5, []), ("I", "interface", 6, 8, [])]),
    ("rust", "#[derive(Debug)]\npub struct P<'a> {\n  x: &'a str,\n}\nimpl<'a> Draw for P<'a> {\n  fn draw(&self) {}\n}\npub(crate) async fn go() -> u8 { '}' as u8 }\n", [("P", "class", 1, 4, []), ("P", "class", 5, 7, ["draw"]), ("go", "function", 8, 8, [])]),
    ("c", "#define X {\nstatic int\nadd(int a,\n    int b)\n{\n  return a;\n}\nstruct s { int x; };\nint y = 3;\nint proto(int);\n", [("add", "function", 2, 7, []), ("s", "class", 8, 8, [])]),
    ("cpp", "namespace n {\nvoid f() {}\n}\nclass C : public B {\n public:\n  int get() const { return 1; }\n};\nint C::put(int a) {\n}\n", [("n", "class", 1, 3, ["f"]), ("C", "class", 4, 7, ["get"]), ("put", "function", 8, 9, [])]),
    ("java", "@A(b = {1})\npublic class C<T>\n    extends D {\n  void m() { if (x) { n(); } }\n}\n", [("C", "class", 1, 5, ["m"])]),
    ("python", "@dec\ndef f(a,\n      b):\n    pass\nclass K:\n    def g(self): pass\nx = 1\n", [("f", "function", 2, 4, []), ("K", "class", 5, 6, ["g"])]),
]


@pytest.mark.parametrize(("language", "text", "want"), DECLARATIONS)
def test_declarations(language, text, want):
    assert [(r[0], r[1], r[3], r[4], r[9]) for r in X._entities(_c(language, text))] == want


def test_calls_are_not_declarations():
    got = X._calls(_c("java", "class C {\n  public int run(int a) { return go(a) + new T(b.c(1)).d(); }\n}"))
    assert [(r[2], r[3], r[4]) for r in got] == [("go", None, "direct"), ("T", None, "constructor"), ("c", "b", "direct"), ("d", None, "direct")]


def test_sql_that_is_hard_to_read():
    sql = "create table a (x int, y text default ');', primary key (x)); CREATE TABLE same_line (z int);\nCREATE TABLE b (q int"
    got = X._tables(_c("sql", sql))
    assert [(r[0], [k["name"] for k in r[4]]) for r in got] == [("a", ["x", "y"]), ("b", [])]


def test_orm_over_lines_and_plain_classes():
    got = X._orm(_c("python", "class A(db.Model):\n    x = Column(\n        'n',\n        Integer)\n    y: int = 3\n    z = relationship(\n        B)\nclass C(Base):\n    pass\nclass D:\n    x = Column(Integer)\n"))
    assert [(r[0], [k["data_type"] for k in r[4]], [k["target_entity"] for k in r[5]]) for r in got] == [("A", ["unknown"], ["B"])]


def test_routes():
    text = "@app.get('/a')\n@other\nasync def f(): pass\n@bp.route('/b/<x>',\n  methods=['put', 'GET'])\ndef g(): pass\n@app.get(path)\ndef h(): pass\n"
    assert [(r[0], r[1], r[3], r[4]) for r in X._routes(_c("python", text))] == [("GET", "/a", "f", 1), ("PUT", "/b/<x>", "g", 4), ("GET", "/b/<x>", "g", 4)]
    text = "app.get('/a', f); app.post('/no')\n// app.put('/c')\nx.DELETE(\"/d\")\napp.get(`/t`)\n"
    assert [(r[0], r[1], r[4]) for r in X._routes(_c("javascript", text))] == [("GET", "/a", 1), ("DELETE", "/d", 3)]


@pytest.mark.parametrize("language", sorted(lexer.RULES))
def test_hostile_sources_end(language):
    for text in ("", "{" * 5000, "}" * 5000, '"' * 999, "/*" * 999, "'" * 999, "(" * 50 + "class", "import", "#include", "use", "fn", "impl", "@", "export default", "\x00\ud7ff" * 9, "CREATE TABLE", "create table x (" * 30):
        c = _c(language, text)
        if language == "sql":
            X._tables(c)
        else:
            X._entities(c), X._imports(c), X._calls(c)


SCRIPT = """const q = s.replace(/["'{}]/g, '').split(/\\//);
function before(a) { return a / 2 / b; }
if (x) /ab{/.test(y);
const t = `a ${ f({a: `n ${g(1)} {`}) } }`;
export function after(x) { return h(x) }
class K { m() { return /}/.exec(z()) } }
const v = (<div className="x">it's {w(a)} <b>don't</b> <br/> won't</div>);
function last() {}
"""


def test_regular_expressions_templates_and_markup():
    got = X._entities(_c("typescript", SCRIPT))
    assert [(r[0], r[3], r[4], r[9]) for r in got] == [("before", 2, 2, []), ("after", 5, 5, []), ("K", 6, 6, ["m"]), ("last", 8, 8, [])]
    assert [r[2] for r in X._calls(_c("javascript", SCRIPT))] == ["replace", "split", "test", "f", "g", "h", "exec", "z", "w"]


RECOVERED = [
    ("javascript", "function a() {\n  if (x) {\n}\nfunction b() { c() }\nclass D { e() {} }\n", ["a", "b", "D"]),
    ("javascript", "function a() { f(x, { y } }\nfunction b() {}\n", ["a", "b"]),
    ("c", "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return g(a);\n}\nint h(void) { return 1; }\nstruct s { int x; };\n", ["f", "f", "h", "s"]),
    ("rust", "fn a() { let x = r#\"q \" } \"#; b() }\nfn c() {\nfn d() {}\n", ["a", "c", "d"]),
    ("go", "func A() {\n\tif x {\n}\nfunc B() {}\n", ["A", "B"]),
    ("java", "class A {\n  void m() {\n}\nclass B { String s = \"\"\"\n a } \" b\"\"\"; }\n", ["A", "B"]),
    ("cpp", "void a() {\nauto s = R\"x(} \")\" { )x\";\n}\ntemplate <class T> struct S { };\n", ["a", "S"]),
    ("python", "import os\ndef broken(:\n    pass\n@d\ndef ok(x):\n    '''a\nb'''\n    return f(x)\nclass A:\n  def m(self): pass\nx = (\n", ["ok", "A"]),
]


@pytest.mark.parametrize(("language", "text", "names"), RECOVERED)
def test_an_error_costs_one_declaration(language, text, names):
    assert [r[0] for r in X._entities(_c(language, text))] == names


def test_python_that_does_not_parse_keeps_its_lines():
    text = RECOVERED[-1][1]
    assert [(r[3], r[4], r[6]) for r in X._entities(_c("python", text))] == [(5, 8, "ok(x)"), (9, 10, None)]
    assert X._imports(_c("python", text)) == [("f", "os", "module", [])] and [r[1] for r in X._calls(_c("python", text))] == [8]


def test_time_grows_with_the_source():
    """A bundled file of 1 MB takes seconds, on one line or many, and so does one long run of any bracket."""
    unit = "!function(e,t){var n=/['\"]{/g;function r%d(a){return a/2+i(a,[1,{b:2}])}e.x=r%d(`q${t}`)}(a,b);\n"
    many = "".join(unit % (i, i) for i in range(10_000))
    for text in (many, "(function(){" + many.replace("\n", "") + "})();"):
        began = time.process_time()
        assert len(X._calls(_c("javascript", text))) == 20_000
        X._entities(_c("javascript", text))
        assert time.process_time() - began < 30
    for text in ("`" * 20_000, "${" * 20_000, "(" * 20_000, "/[" * 20_000, "/a" * 20_000, "<a>" * 20_000, "{" * 20_000 + "}" * 10_000):
        began = time.process_time()
        for language in ("javascript", "rust"):
            X._entities(_c(language, text)), X._calls(_c(language, text))
        assert time.process_time() - began < 30
