import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl
from tessera.sources import code, containers, manifests, readers, sinks


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'


def docx(body):
    return packed(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>")


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
CASES = [
    ("docx_text", docx('<w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p>' + P.format("a") + "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p>"), "ready", None, [("heading", "T", 2), ("paragraph", "a", None), ("list", "i", None)]),
    ("docx_text", docx("<w:p><w:ins/></w:p>"), "denied", "ineligible_source", []),
    ("docx_text", docx(f"<w:tbl><w:tr><w:tc>{P.format('x')}{P.format('y')}</w:tc><w:tc>{P.format('z')}</w:tc></w:tr></w:tbl>"), "ready", None, [("table", "x / y | z", None)]),
    ("docx_text", docx(f"<w:tbl><w:tr><w:tc><w:tbl>{P.format('x')}</w:tbl></w:tc></w:tr></w:tbl>"), "denied", "ineligible_source", []),
    ("docx_text", docx(""), "denied", "unsupported_source_type", []),
    ("docx_text", b"no zip", "unavailable", "dependency_unavailable", []),
    ("odt_text", packed(content_dot_xml='<d xmlns:t="u"><body><text><t:h t:outline-level="9">a</t:h><t:h t:outline-level="3">b</t:h><t:p>c<t:s t:c="2"/>d</t:p><t:list><t:list-item><t:p>e</t:p></t:list-item></t:list></text></body></d>'), "ready", None, [("paragraph", "a", None), ("heading", "b", 3), ("paragraph", "c d", None), ("list", "e", None)]),
    ("odt_text", packed(mimetype="x/y", content_dot_xml="<a/>"), "denied", "ineligible_source", []),
    ("rtf_text", rb"{\rtf1{\fonttbl{\f0 A;}}One \b two\b0\par{\*\generator x;}T\u233?e\'e9\~x\par}", "ready", None, [("paragraph", "One two", None), ("paragraph", "Téeé x", None)]),
    ("rtf_text", rb"{\rtf1 a{\footnote b}}", "denied", "ineligible_source", []),
    ("rtf_text", rb"{\rtf1 a", "unavailable", "dependency_unavailable", []),
    ("pdf_text", b"%PDF", "unavailable", "dependency_unavailable", []),
]


@pytest.mark.parametrize("lane,content,state,reason,blocks", CASES)
def test_containers(lane, content, state, reason, blocks):
    assert containers.read_container(lane, content) == (blocks, state, reason)


def epub(page="<html><body><h1>T</h1><div><p>a<br/>b</p></div><div>bare</div></body></html>", properties="", mimetype="application/epub+zip", idref="a"):
    package = f'<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml" properties="{properties}"/></manifest><spine><itemref idref="{idref}"/></spine></package>'
    return packed(mimetype=mimetype, **{"META-INF__container_dot_xml": '<c><rootfile full-path="o/p.opf"/></c>', "o__p_dot_opf": package, "o__a_dot_xhtml": page})


@pytest.mark.parametrize("content,state", [(epub(), "ready"), (epub(properties="nav"), "denied"), (epub(mimetype="x"), "denied"), (epub(idref="b"), "unavailable"), (epub("<html><body><img/></body></html>"), "denied"), (epub('<html><body><p onclick="x">a</p></body></html>'), "denied"), (epub("<html>"), "unavailable"), (epub("<html><body><ul><li><ul/></li></ul></body></html>"), "denied")])
def test_epub(content, state):
    blocks, got, _ = containers.read_container("epub_text", content)
    assert got == state
    assert not blocks or blocks == [("heading", "T", 1), ("paragraph", "a b", None), ("paragraph", "bare", None)]


def test_container_rows(spark):
    files = spark.createDataFrame([(str(k), lane, bytearray(c)) for k, (lane, c, *_) in enumerate(CASES)] + [("n", "rtf_text", None)], "path string, lane string, content binary")
    rows = {r.path: r for r in containers.container_blocks(files).collect()}
    assert [rows[str(k)].state for k in range(len(CASES))] == [c[2] for c in CASES]
    assert rows["n"].state == "unavailable" and rows["0"].blocks[1].text == "a"


def test_files_and_trees(spark, tmp_path):
    for name, data in {"a.md": b"# x\n", "b/c.txt": b"\xff\x00", "b/.gitignore": b"*.log\n!keep.log\n", "b/x.log": b"", "b/keep.log": b"", "node_modules/m.js": b"", ".hid/z": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path for r in readers.walk_tree(spark, str(tmp_path)).collect()} == {"a.md", "b/c.txt", "b/keep.log"}
    files = readers.read_files(spark, str(tmp_path)).filter("path like '%/a.md' or path like '%/c.txt'")
    got = {r.path[-5:]: (r.text, r.bin) for r in files.select("path", "text", crawl.is_binary(F.col("content")).alias("bin")).collect()}
    assert got == {"/a.md": ("# x\n", False), "c.txt": (None, True)}
    assert readers.directory_hash(files, F.lit("t")).first().bytes == 6


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"repository": "r", "polarity": "odd"}\n{"repository": "s", "polarity": "refutes"}\n')
    (tmp_path / "b.json").write_text('[{"repository": "r", "polarity": "supports"}]')
    assert sorted(r.polarity for r in readers.read_observations(spark, str(tmp_path / "a.jsonl")).collect()) == ["refutes", "unavailable"]
    assert [r.polarity for r in readers.read_observations(spark, str(tmp_path / "b.json")).collect()] == ["supports"]
    df = spark.createDataFrame([(1, "ready")], "id long, state string")
    assert sinks.typed_lines(item=df).first().value == '{"type":"item","record":{"id":1,"state":"ready"}}'
    store = sinks.Store(spark, str(tmp_path / "store"))
    assert store.read("t") is None
    store.upsert("t", df, ["id"])
    assert sorted(map(tuple, store.upsert("t", spark.createDataFrame([(1, "stale"), (2, "x")], df.schema), ["id"]).collect())) == [(1, "stale"), (2, "x")]
    assert sinks.write_json(df, str(tmp_path / "out")) == 0


@pytest.mark.parametrize("text,fine", [("{}", True), ("[1, 2]", True), ("null", True), (' "x" ', True), ("", False), ("{}}", False), ("1 2", False), ("1,2", False), ("1] 2", False), ('1,"b":2', False), ("{", False), ("[1}", False)])
def test_json_validity(spark, text, fine):
    from tessera.functions.text import is_json

    assert spark.createDataFrame([(text,)], "t string").select(is_json(F.col("t")).alias("x")).first().x is fine


def test_manifests_and_code(spark):
    cargo = '[dependencies]\na = "1"\nb = {git = "https://github.com/o/b"}\n[workspace.dependencies]\nc = {git = "git@github.com:o/c"}\n'
    project = '[project]\ndependencies = ["x", "y @ git+https://github.com/o/y"]\n[tool.poetry.dependencies]\nz = {git = "https://github.com/o/z"}\n'
    files = spark.createDataFrame([("r", "Cargo.toml", "cargo", cargo), ("r", "pyproject.toml", "pyproject", project), ("r", "bad", "cargo", "[")], "repo string, path string, kind string, text string")
    got = {(r.edge_id, r.method, r.raw, r.error) for r in manifests.toml_edges(files).collect()}
    assert got == {("cargo-edge-1", "cargo_manifest_parse", "https://github.com/o/b", None), ("cargo-edge-2", "cargo_workspace_manifest_parse", "git@github.com:o/c", None), ("pyproject-edge-1", "pyproject_pep621_parse", "y @ git+https://github.com/o/y", None), ("pyproject-edge-2", "pyproject_poetry_git_parse", "https://github.com/o/z", None), (None, None, None, "invalid_toml")}
    py = "import os\nfrom a import b\nclass C:\n    def m(self):\n        pass\n"
    facts = code.code_facts(spark.createDataFrame([("a.py", "py", py), ("b.py", "py", "def"), ("c.rs", "rust", "pub fn go() {}\nuse a::b;")], "path string, lang string, text string")).collect()
    assert {(r.path, r.kind, r.name) for r in facts if r.kind} == {("a.py", "import", "os"), ("a.py", "import", "a.b"), ("a.py", "class", "C"), ("a.py", "function", "C.m"), ("c.rs", "function", "go"), ("c.rs", "import", "a::b")}
    assert [r.diagnostic for r in facts if r.path == "b.py"] == ["syntax_error"]


RUST = """// fn no() {}
use a::{b,
  c};
/* struct /* nested */ Gone; */
pub struct S<'a, const N: usize> { x: &'a str }
impl<'a> S<'a> {
    pub const fn new(c: char) -> Self { let q = '{'; let s = r#"fn not( { "#; S { x: "}" } }
    fn m(&self, p: *const u8) -> [u8; 3] {
        fn inner() {}
    }
}
mod t { trait T { fn required(&self); } }
static mut COUNT: u32 = 1;
"""
TS = """import { a,
  b } from "./x";
import './side'
export default class C<T> extends D {
  private f = () => { return `a ${ {x: `}`}.x } class no {}`; };
  static async go(x: number = g(1)): Promise<void> { if (x) { run(); } }
  get v() { return /[/}]{/.test("}") }
}
interface I { m(): void }
type U = string | { a: number };
export const { p, q } = require("z");
for (const each of []) { const g = function h() {}; }
"""


def test_lexed_code():
    found, wrong = code.lexed_facts("rust", RUST)
    assert wrong is None and found == [
        ("import", "a::{b, c}", 2, 3), ("struct", "S", 5, 5), ("function", "new", 7, 7), ("function", "m", 8, 10), ("function", "inner", 9, 9),
        ("module", "t", 12, 12), ("trait", "T", 12, 12), ("static", "COUNT", 13, 13),
    ]
    found, wrong = code.lexed_facts("tsx", TS)
    assert wrong is None and found == [
        ("import", "./x", 1, 2), ("import", "./side", 3, 3), ("class", "C", 4, 8), ("method", "go", 6, 6), ("method", "v", 7, 7),
        ("interface", "I", 9, 9), ("type_alias", "U", 10, 10), ("variable", "{ p, q }", 11, 11), ("variable", "g", 12, 12),
    ]
    assert code.lexed_facts("js", "interface I {}\nfunction f( {") == ([], "syntax_error")
    assert code.lexed_facts("js", "") == ([], None)


@pytest.mark.parametrize("path,want", [("a/../b", "b"), ("./a//b", "a/b"), ("../a", None), ("/etc", None), ("a/../../b", None)])
def test_containment(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(crawl.contained(F.col("p")).alias("x")).first().x == want
