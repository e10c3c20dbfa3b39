"""Source files for the extraction queries: a small tree in eight languages, and files made from the part table.

A generated file is a template in which %K stands for K and a part's key and %S for S and its size, so what is to be
found in it follows from the table without parsing: a part has the template of its key modulo 8.
"""

TEMPLATES = [
    (
        "gen/%K.py",
        """from pkg%S import (
    a%K,  # first
    b%K as other,
)
import os%K.path

@app.get(
    "/p/%K/{item}"
)
async def f%K(x, y=(1, 2)):
    return g%S(x,
              obj.h%K(y))

class M%K(Base):
    id = Column(Integer, primary_key=True)
    ref = Column(
        String(%S),
        nullable=False,
    )
""",
    ),
    (
        "gen/%K.ts",
        """import {
  a%K,
  type b%K as c,
} from './mod%S';
/** Adds %K. */
export async function f%K(
  x: number,
  y = "}"
) {
  return g%S(x) / 2 + `{ ${y.replace(/["'}]/g, `}${x}`)}`; // not h%K(x)
}
export default class C%K extends D {
  run(a) { return new E%K(a); }
  stop() {}
}
router.post('/q/%K/:id', f%K);
""",
    ),
    (
        "gen/%K.sql",
        """-- CREATE TABLE no (id INT);
CREATE TABLE IF NOT EXISTS t%K (
  id BIGINT NOT NULL PRIMARY KEY, /* a, b) */
  note VARCHAR(%S) DEFAULT 'x);y' UNIQUE,
  other INT,
  CHECK (id > 0),
  FOREIGN KEY (other) REFERENCES t%S (id)
);
""",
    ),
    (
        "gen/%K.java",
        """package p;
import java.util.
    Lib%S;
import static org.junit.T%K.*;
/* Part %K. */
@Entity(name = "%K")
public final class C%K
    extends Base%S {
  public int run(int a) {
    return help%S(a);
  }
}
enum L%K { A, B }
""",
    ),
    (
        "gen/%K.go",
        """package p%S
import (
	h "net/%K"
	_ "os"
)
var re = `{"'` + "}"
// Doc.
func (s *Srv%S) Run%K(
	a int,
) error {
	return g%S(a, '{')
}
type T%K struct {
	x int
}
type I%K interface {
	F()
}
""",
    ),
    (
        "gen/%K.rs",
        """use std::{
    io,
    m%S,
};
pub use crate::k%K::*;
#[derive(Debug)]
pub struct P%K<'a> {
    x: &'a str,
}
impl<'a> Draw for P%K<'a> {
    fn draw%K(&self) -> u8 {
        g%S(r#"} " {"#, '}')
    }
}
pub(crate) async fn go%K<T>(x: T) -> T {
    x.h%K()
}
""",
    ),
    (
        "gen/%K.c",
        """#include <a%S.h>
#include "k%K.h"
#define OPEN \\
  {
static int
add%K(int a,
      int b)
{
  return g%S(a, '}') / b; /* } */
}
struct s%K {
  int x;
};
int proto%K(int);
""",
    ),
    (
        "gen/%K.cpp",
        """#include <vector>
#include "k%K.hpp"
namespace n%K {
void f%K() { g%S(R"x(} ")x"); }
}
template <typename T>
class C%K : public B%S {
 public:
  int get%K() const { return h%K(1); }
};
int C%K::put%K(int a) {
  return a;
}
""",
    ),
]

FILES = {
    "app/main.py": '''"""Entry."""
import os
from fastapi import FastAPI as Api, Depends
from app.db import *
import app.service as svc, json

app = Api()


@app.get("/users/{user_id}")
async def get_user(user_id: int, q: str = "x") -> dict:
    """Return a user."""
    return svc.load(user_id)


@app.route("/items/:id", methods=["GET", "POST"])
def items():
    return helper(json.dumps([]))


def helper(text):
    print(text)
    return os.path.join("a", text)
''',
    "app/models.py": '''from sqlalchemy import Column


class User(Base):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    email = mapped_column(String, nullable=False)
    posts = relationship("Post")


class Plain:
    def run(self):
        return User()

    def stop(self):
        self.run()
''',
    "app/service.py": "def load(key):\n    return fetch(key)\n\n\ndef fetch(key):\n    return key\n",
    "app/broken.py": "def broken(:\n    pass\n",
    "db/schema.sql": """-- tables
CREATE TABLE users (
    id INTEGER PRIMARY KEY,
    email VARCHAR(255) NOT NULL UNIQUE,
    age INT DEFAULT 0
);
create table if not exists posts (
    id INTEGER,
    price DECIMAL(10, 2),
    user_id INTEGER,
    PRIMARY KEY (id),
    FOREIGN KEY (user_id) REFERENCES users(id)
);
""",
    "web/server.js": """const express = require('express');
import { a, b as c } from './util';
router.post('/orders/:id', handler);
// Adds numbers
export function add(x, y) { return sum(x, y); }
class Cart {
}
const k = new Cart();
""",
    "web/types.ts": "export interface Shape {\n  area(): number;\n}\nexport abstract class Base {\n}\nimport x from \"lib/x\";\n",
    "src/Main.java": "import java.util.List;\nimport static org.junit.Assert.*;\npublic class Main {\n}\ninterface Runner {\n}\n",
    "src/main.go": 'package main\nimport "fmt"\nimport (\n\t"net/http"\n)\nfunc Run(a int) {\n\tfmt.Println(a)\n}\ntype Srv struct {\n}\n',
    "src/lib.rs": "use std::collections::HashMap;\npub fn make(x: i32) -> i32 {\n    x\n}\npub trait Draw {\n}\nstruct Dot {\n}\n",
    "src/a.c": '#include <stdio.h>\n#include "a.h"\nint main(void) {\n    return run(1);\n}\n',
}
