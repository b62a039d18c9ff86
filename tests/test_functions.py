"""Column functions on case tables."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from codequarry.config import ConfigError, Settings, parse_settings
from codequarry.functions import chunkers, embedding, fulltext, hashing, identifiers, sqltext, structure
from codequarry.operators import search
from codequarry.sources import tree


def one(spark, *values, names=None):
    names = names or [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))


def value(df, column):
    return df.select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("name", "words"),
    [("processReceipt", ["process", "receipt"]), ("HTTPServerError", ["http", "server", "error"]), ("a_b-c.d", ["a", "b", "c", "d"]), ("parse2Go", ["parse2", "go"]), ("", []), ("XMLToJSON", ["xml", "to", "json"]), ("__x__", ["x"])],
)
def test_words(spark, name, words):
    df = one(spark, name)
    assert value(df, identifiers.words(F.col("c0"))) == words
    assert value(df, identifiers.kebab(F.col("c0"))) == "-".join(words)


@pytest.mark.parametrize(
    ("path", "symbol", "tags"),
    [
        ("handlers/receipt/upload.go", None, ["resource:upload", "resource:receipt", "resource:receipt-upload"]),
        ("src/routes/receipts/+page.svelte", None, ["resource:receipts"]),
        ("src/index.ts", None, []),
        ("services/ocr.go", "OcrWorker", ["resource:ocr"]),
        ("lib/util.ts", "ReceiptHandler", ["resource:receipt"]),
        ("node_modules/x/thing.js", "Thing", []),
        ("app/billing_test.go", None, ["resource:billing"]),
        ("", "Thing", []),
        (None, "Thing", []),
    ],
)
def test_resource_tags(spark, path, symbol, tags):
    df = one(spark, path, symbol)
    assert value(df, identifiers.resource_tags(F.col("c0"), F.col("c1"), exclude=["node_modules/**"])) == tags


def test_no_suffix_ends_in_another():
    assert not [(a, b) for a in identifiers.SUFFIXES for b in identifiers.SUFFIXES if a != b and a.endswith(b)]


def test_rules_and_weights(spark):
    df = one(spark, "src/receipt.ts", "throw new Error()")
    assert value(df, identifiers.rule_tags(F.col("c0"), F.col("c1"), [("r", "receipt"), ("t", "throw new"), ("r", "Error"), ("no", "^x$")])) == ["r", "t"]
    with pytest.raises(Exception, match="unterminated|missing|bad"):
        identifiers.rule_tags(F.col("c0"), F.col("c1"), [("bad", "(")])
    assert value(df, identifiers.tag_weight(F.lit("resource:x"))) == 3
    assert value(df, identifiers.tag_weight(F.lit("api"))) == 1


@pytest.mark.parametrize(
    ("rules", "path", "out"),
    [(["*.log"], "a/b.log", True), (["/dist/"], "dist/x.js", True), (["/dist/"], "a/dist/x.js", False), (["build"], "a/build/x", True), (["*.ts", "!keep.ts"], "keep.ts", False), (["docs/**/x.md"], "docs/a/b/x.md", True), ([], "x", False), (["*"], "", False), (["a/b"], "a\\b", True), (["# c", ""], "c", False)],
)
def test_ignored(spark, rules, path, out):
    assert value(one(spark, path), tree.ignored(F.col("c0"), rules)) is out


def test_admission(spark):
    rows = [(b"abc",), (b"a\x00c",), (b"x" * 50,), (None,), (b"\x10\x01",)]
    df = spark.createDataFrame(rows, "b binary").select(tree.admission(F.octet_length("b"), F.col("b"), 40).alias("r"))
    assert [r["r"] for r in df.collect()] == ["ok", "binary", "too-large", "missing", "ok"]


def test_signatures(spark):
    df = one(spark, "func  f( a,b )", "func f(a, b)")
    same = hashing.signature_hash(F.array("c0")) == hashing.signature_hash(F.array("c1"))
    assert value(df, same) is True
    assert value(df, hashing.signature_hash(F.array("c0", F.lit("x"))) == hashing.signature_hash(F.array(F.lit("x"), "c1"))) is True
    blob = spark.createDataFrame([(bytearray(b"hello\n"),)], "b binary").select(hashing.git_blob_sha(F.col("b")).alias("v")).head()["v"]
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a"
    key = lambda scope: hashing.query_key(F.lit("hybrid"), F.lit("q"), scope, F.lit(10))
    assert value(df, key(F.lit(None).cast("string")) == key(F.lit("all"))) is False


@pytest.mark.parametrize(("word", "root"), [("running", "run"), ("universal", "univers"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("conflated", "conflat"), ("électricité", "électricité"), ("ab", "ab")])
def test_stem(word, root):
    assert fulltext.stem(word) == root


def test_query_terms(spark):
    got = value(one(spark, "find foo_bar AND x Größe"), fulltext.query_terms(F.col("c0")))
    assert [(t["term"], t["is_prefix"]) for t in got] == [("find", True), ("foo_bar", True), ("AND", False), ("Größe", True)]


def test_bm25_agrees_with_full_text_search_of_sqlite(spark):
    texts = ["parse the receipt and store it", "receipt_upload stores a receipt", "universal parser of receipts", "nothing here at all", "parser parser parser"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(signature, symbol_name, content, tokenize='porter unicode61')")
    rows = []
    for i, text in enumerate(texts, 1):
        con.execute("INSERT INTO t(rowid, signature, symbol_name, content) VALUES (?, ?, ?, ?)", (i, f"sig {i}", f"name{i}", text))
        rows.append((i, f"sig {i}", f"name{i}", text, None))
    chunks = spark.createDataFrame(rows, "chunk_id long, signature string, symbol_name string, content string, scope string")
    for query, match in (("receipt parser", "receipt* OR parser*"), ("receipt_up", "receipt_up*"), ("universal", "universal*")):
        want = {r: -s for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match.replace("receipt_up*", '"receipt up" *'),))}
        asked = spark.createDataFrame([(1, query)], "query_id long, query string")
        got = search.full_text(asked, search.built_index(chunks, stem=True), chunks, stem=True).collect()
        assert {r["chunk_id"]: pytest.approx(r["score"], abs=1e-6) for r in got} == want


def test_highlight_and_snippet(spark):
    df = one(spark, "one two receipt_upload three", "\n".join(map(str, range(40))))
    assert value(df, fulltext.highlighted(F.col("c0"), F.array(F.lit("receipt")))) == "one two <<receipt_upload>> three"
    assert value(df, fulltext.highlighted(F.col("c0"), F.array(F.lit("zzz")))) is None
    assert value(df, structure.snippet(F.col("c1"))).endswith("29\n// ...(truncated)")


def test_comments(spark):
    df = one(spark, "x\n// one\n// two\nfunc f() {}", "/**\n * Says so.\n */\nfunction f() {}", 'def f(a):\n    """Does it."""\n    return a')
    assert value(df, structure.comment_above(F.col("c0"), F.lit(4), "//")) == "one\ntwo"
    assert value(df, structure.block_comment_above(F.col("c1"), F.lit(4))) == "Says so."
    assert value(df, structure.docstring(F.col("c2"))) == "Does it."
    assert value(df, structure.comment_above(F.col("c0"), F.lit(2), "//")) is None


SQL = """-- first; comment
CREATE TABLE app.users (id SERIAL PRIMARY KEY, data JSONB, note text DEFAULT 'a;b');
/* block; */ CREATE UNIQUE INDEX users_idx ON app.users (id);
CREATE OR REPLACE FUNCTION f() RETURNS int AS $body$ BEGIN; RETURN 1; END $body$ LANGUAGE plpgsql;
SELECT 1;
ALTER TABLE app.users ADD COLUMN x int REFERENCES other(id);
"""


def _statements(text):
    return [text[s:e] for s, e in sqltext.scanned(text)]


def test_sql(spark):
    df = one(spark, "db/x.sql", SQL, names=["file_path", "content"])
    parts = _statements(SQL)
    assert len(parts) == 5 and parts[2].endswith("plpgsql")
    rows = {r["symbol_name"] + r["chunk_type"]: r for r in sqltext.sql_chunks(df).collect()}
    assert set(rows) == {"usersstruct", "users_idxconst", "ffunction", "usersmethod"}
    users = rows["usersstruct"]
    assert users["package_name"] == "app" and users["dialect"] == "postgres" and users["doc_comment"] == "first; comment" and (users["start_line"], users["end_line"]) == (1, 2)
    assert rows["users_idxconst"]["receiver"] == "users" and rows["users_idxconst"]["imports"] == ["users"] and rows["usersmethod"]["receiver"] == "alter"
    assert rows["usersmethod"]["imports"] == ["other"] and "sql-feature:jsonb" in users["features"] and rows["usersmethod"]["start_line"] == 6
    go = one(spark, "CREATE TABLE a (x NVARCHAR(5))\nGO\nCREATE TABLE b (y int IDENTITY(1,1))\nGO\n")
    assert value(go, sqltext.dialect_of_content(F.col("c0"))) == "mssql"
    assert value(one(spark, ""), sqltext.dialect_of_content(F.col("c0"))) is None
    assert value(one(spark, "x/mysql/a.sql"), sqltext.dialect_of_path(F.col("c0"))) == "mysql"
    none = spark.createDataFrame([("a.sql", None), ("b.sql", ""), (None, "-- only a remark\n;;"), (None, "CREATE TABLE t (a int)")], "file_path string, content string")
    assert [(r["file_path"], r["symbol_name"], r["dialect"]) for r in sqltext.sql_chunks(none).collect()] == [(None, "t", "ansi")]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("a; b", ["a", "b"]), ("a;;\n ;b;", ["a", "b"]), ("SELECT ';' ; b", ["SELECT ';'", "b"]), ("SELECT 'it''s;' ; b", ["SELECT 'it''s;'", "b"]), ('x "a;b" ; y', ['x "a;b"', "y"]), ("x `a;b`; y", ["x `a;b`", "y"]),
        ("x [a;b]; y", ["x [a;b]", "y"]), ("-- a;b\nc; d", ["-- a;b\nc", "d"]), ("/* a; /* b; */ c; */ d; e", ["/* a; /* b; */ c; */ d", "e"]), ("/* open ; a", ["/* open ; a"]), ("$$ a; $$; b", ["$$ a; $$", "b"]),
        ("$x$ a; $$ b; $x$; c", ["$x$ a; $$ b; $x$", "c"]), ("$1; b", ["$1", "b"]), ("a\nGO\nb\ngo\r\nc", ["a", "b", "c"]), ("GOTO x; b", ["GOTO x", "b"]), ("DELIMITER //\na; b //\nc //\nDELIMITER ;\nd; e", ["a; b", "c", "d", "e"]),
        ("a\ndelimiter $$\nb; c$$", ["a", "b; c"]), ("'open ; a", ["'open ; a"]), ("", []), (" \n;", []), ("a - b; c / d", ["a - b", "c / d"]),
    ],
)
def test_sql_statements(text, parts):
    assert _statements(text) == parts


@pytest.mark.parametrize(
    ("text", "kind", "receiver", "package", "name", "imports"),
    [
        ("CREATE OR REPLACE TABLE a.t (x int REFERENCES b.u)", "struct", None, "a", "t", ["u"]), ("create temp table if not exists t(x)", "struct", None, None, "t", []), ('CREATE TABLE "s"."T" (x)', "struct", None, "s", "T", []),
        ("CREATE OR REPLACE MATERIALIZED VIEW m AS SELECT * FROM a.t JOIN u", "type", None, None, "m", ["t", "u"]), ("CREATE VIEW v AS SELECT * FROM v, w", "type", None, None, "v", []), ("CREATE FUNCTION f(a int) RETURNS int", "function", None, None, "f", []),
        ("CREATE PROCEDURE p.q() BEGIN SELECT 1; END", "function", None, "p", "q", []), ("CREATE UNIQUE INDEX i ON a.t (x)", "const", "t", None, "i", ["t"]), ("CREATE TRIGGER g BEFORE UPDATE\nON a.t FOR EACH ROW", "method", "t", None, "g", ["t"]),
        ("CREATE TYPE e AS ENUM ('a')", "type", None, None, "e", []), ("CREATE SCHEMA IF NOT EXISTS s", "module", None, None, "s", []), ("CREATE SEQUENCE s.q", "const", None, "s", "q", []), ("ALTER TABLE IF EXISTS a.t ADD x int REFERENCES b(i)", "method", "alter", "a", "t", ["b"]),
        ("DROP TABLE IF EXISTS a.t", "const", "drop", "a", "t", []), ("COMMENT ON COLUMN a.t.x IS 'y'", "const", "comment", "a", "t.x", []), ("GRANT SELECT ON a.t TO r", "const", "grant", "a", "t", []),
        ("/* a /* b */ */ -- c\nCREATE TABLE t (x)", "struct", None, None, "t", []), ("CREATE TABLE [a].[t] (x)", "struct", None, "a", "t", []),
    ],
)
def test_sql_kinds(text, kind, receiver, package, name, imports):
    assert sqltext.classify(text) == {"chunk_type": kind, "receiver": receiver, "symbol_name": name, "package_name": package, "imports": imports}


def test_sql_that_defines_nothing():
    assert [sqltext.classify(x) for x in ("SELECT 1", "INSERT INTO t VALUES (1)", "-- CREATE TABLE t", "DROP DATABASE x", "")] == [None] * 5


def test_sql_dialect_of_file_and_statement(spark):
    text = "CREATE TABLE a (x int AUTO_INCREMENT) ENGINE=InnoDB;\nCREATE TABLE b (x int);\nCREATE TABLE c (x JSONB, y SERIAL);"
    rows = spark.createDataFrame([("x.sql", text), ("mssql/x.sql", text)], "file_path string, content string")
    got = {(r["file_path"], r["symbol_name"]): r["dialect"] for r in sqltext.sql_chunks(rows).collect()}
    assert [got["x.sql", n] for n in "abc"] == ["mysql", "mysql", "postgres"] and [got["mssql/x.sql", n] for n in "abc"] == ["mysql", "mssql", "postgres"]


def test_script_blocks(spark):
    page = "<script context=\"module\">\nlet a\n</script>\n<h1>Hi</h1>\n<script>\nlet b\n</script>\n<style>p{}</style>"
    df = one(spark, page)
    got = value(df, structure.script_blocks(F.col("c0")))
    assert [(b["is_module"], b["code"].strip(), b["first_line"]) for b in got] == [(True, "let a", 1), (False, "let b", 5)]
    assert value(df, structure.template_text(F.col("c0"))) == "<h1>Hi</h1>"


SOURCES = {
    "go": ("package p\n\n// F does.\nfunc F(a int) int {\n\treturn a\n}\n\ntype S struct {\n\tA int\n}\n\ntype I interface {\n\tM()\n}\n\nfunc (s *S) M() {\n}\n", [("function", "F"), ("struct", "S"), ("interface", "I"), ("method", "M")]),
    "typescript": ("import { x } from './x';\n\n/** Doc. */\nexport interface A { a: string }\nexport type B = string;\nexport class C {\n  m() {}\n}\nexport function d() { return '{'; }\nexport const e = (a: number) => {\n  return a;\n};\n", [("interface", "A"), ("type", "B"), ("class", "C"), ("function", "d"), ("const", "e")]),
    "python": ("import os\n\ndef f(a):\n    \"\"\"Doc.\"\"\"\n    return a\n\nclass C:\n    def m(self):\n        pass\n", [("function", "f"), ("class", "C"), ("method", "m")]),
    "rust": ("use a::b;\n\npub fn f() -> i32 { 1 }\npub struct S { a: i32 }\nenum E { A, B }\ntrait T { fn x(&self); }\nimpl S {\n    fn m(&self) {}\n}\n", [("function", "f"), ("struct", "S"), ("enum", "E"), ("interface", "T"), ("class", "S"), ("method", "m")]),
    "java": ("package a.b;\nimport c.D;\npublic class X {\n  void m() {}\n}\ninterface Y {}\nenum Z { A }\nrecord R(int a) {}\n", [("class", "X"), ("interface", "Y"), ("enum", "Z"), ("class", "R")]),
    "cpp": ("#include <a>\nnamespace n {\nclass K {\n};\n}\nstruct S {\n  int a;\n};\nint f(int a) {\n  return a;\n}\n", [("module", "n"), ("class", "K"), ("struct", "S"), ("function", "f")]),
    "csharp": ("using System;\nnamespace N {\npublic class A { }\npublic interface B { }\npublic record C(int X);\n}\n", [("class", "A"), ("interface", "B"), ("class", "C")]),
    "svelte": ("<script>\nexport function s() {}\n</script>\n<p>x</p>\n", [("component", None), ("function", "s")]),
}


def test_chunkers(spark):
    files = spark.createDataFrame([(f"a.{lang}", lang, text) for lang, (text, _) in SOURCES.items()] + [("x", "go", None), ("y", "cobol", "z")], "file_path string, language string, content string")
    got = {}
    for r in chunkers.chunked(files).orderBy("file_path").collect():
        assert r["error"] is None
        got.setdefault(r["language"], []).append((r["chunk_type"], r["symbol_name"]))
        if r["symbol_name"] in ("F", "f") and r["language"] in ("go", "python"):
            assert r["doc_comment"] in ("F does.", "Doc.")
    assert got == {lang: want for lang, (_, want) in SOURCES.items()}


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "chunk_id long, t string")
    got = embedding.embedded(rows, F.col("t"), embedding.hashed(16)).collect()
    assert all(sum(r["embedding"]) == 1 for r in got) and len(got) == 3


def test_settings():
    assert parse_settings({"languages": ["go"], "tag_rules": [["a", "b"]]}).tag_rules == (("a", "b"),)
    for bad in ({"x": 1}, {"languages": ["cobol"]}, {"resource_weight": 11}, {"semantic_threshold": 0.5}, {"tag_rules": [["a", "("]]}, {"dimension": True}):
        with pytest.raises(ConfigError):
            parse_settings(bad)
    assert Settings().dimension == 1024
