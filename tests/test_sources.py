"""Design-tool and catalogue documents (FIXTURES.md, G5, G6), file scans and REST readers over a local server."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow.fs as pafs
import pytest
from pyspark.sql.datasource import EqualTo, StringStartsWith

from tokenloom.model import CodebaseSource, Config, FigmaSource, StorybookSource
from tokenloom.plans import contract as contracts
from tokenloom.sources import codebase, listing, rest


def docs(spark, *bodies):
    return spark.createDataFrame([(f"d{k}", b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "doc string, body string")


def variable(name, kind, value, remote=False, collection="C1"):
    return {"id": name, "name": name, "resolvedType": kind, "remote": remote, "variableCollectionId": collection, "valuesByMode": {"m1": value}}


def variables(*rows):
    return {"meta": {"variables": {str(k): r for k, r in enumerate(rows)}, "variableCollections": {"C1": {"name": "Base", "defaultModeId": "m1"}}}}


def test_variables(spark):
    doc = variables(
        variable("Colors/Primary 500", "COLOR", {"r": 0.2, "g": 0.4, "b": 1, "a": 0.5}),
        variable("opaque", "COLOR", {"r": 0.2, "g": 0.4, "b": 1, "a": 1}),
        variable("plain", "COLOR", {"r": 0.2, "g": 0.4, "b": 1}),
        variable("space/sm", "FLOAT", 4), variable("radius/md", "FLOAT", 0.5), variable("font/size", "FLOAT", 16), variable("label", "STRING", "Inter"),
        variable("empty", "STRING", ""), variable("flag", "BOOLEAN", True), variable("text", "FLOAT", "4"), variable("alias", "COLOR", {"type": "VARIABLE_ALIAS", "id": "x"}),
        variable("far", "FLOAT", 1, remote=True), variable("lost", "FLOAT", 1, collection="C9"), variable("none", "FLOAT", None), variable("A / B", "FLOAT", 1),
        variable("big", "FLOAT", 20000000), variable("space/SM", "FLOAT", 5),
    )
    got = {(r.category, r.name, r.value) for r in rest.figma_tokens(docs(spark, doc)).collect()}
    assert got == {
        ("colors", "colors-primary-500", "#3366ff80"), ("colors", "opaque", "#3366ff"), ("colors", "plain", "#3366ff"), ("spacing", "space-sm", "5px"), ("borderRadius", "radius-md", "0.5px"),
        ("typography", "font-size", "16px"), ("typography", "label", "Inter"), ("spacing", "a---b", "1px"), ("spacing", "big", "20000000px"),
    }


def story(i, kind, title, name, path=None):
    return {"id": i, "type": kind, "title": title, "name": name} | ({"importPath": path} if path else {})


def test_stories(spark):
    rows = [story("a1", "story", "Forms/Button", "Primary"), story("a2", "story", "Forms/Button", "Ghost", "./B.tsx"), story("a3", "docs", "Forms/Button", "Docs", "./B.mdx"), story("b1", "story", "Legacy/ Button", "Old", "./L.tsx"), story("c1", "story", "", "X", "./X.tsx")]
    (r,) = rest.storybook_components(docs(spark, {"entries": {x["id"]: x for x in rows}})).collect()
    assert (r.name, r.source.file, r.source.metadata.storyIds, r.variants) == ("Button", "./L.tsx", ["b1"], ["Old"])
    (r,) = rest.storybook_components(docs(spark, {"stories": {x["id"]: x for x in rows[:3]}})).collect()
    assert (r.source.file, r.source.metadata.storyIds, r.variants) == ("./B.tsx", ["a1", "a2"], ["Primary", "Ghost"])
    (r,) = rest.storybook_components(docs(spark, {"entries": {"x": story("x", "story", "/", "N")}})).collect()
    assert r.name == "/"
    assert rest.storybook_components(docs(spark, {"entries": {}})).count() == 0


def test_tool_components(spark):
    doc = {"meta": {"components": [{"name": "Card", "node_id": "1", "key": "a"}, {"name": "", "node_id": "2", "key": "b"}, {"name": "Card", "node_id": "3", "key": "c"}]}}
    (r,) = rest.figma_components(docs(spark, doc)).collect()
    assert (r.name, r.source.metadata.nodeId, r.props) == ("Card", "3", {})


def test_scan_files(spark, tmp_path):
    for name in ("src/a.css", "src/deep/b.ts", "src/deep/C.tsx", "src/node_modules/x.css", "src/deep/b.test.ts", "src/note.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"/* {name} */\nline two")
    source = CodebaseSource(str(tmp_path / "src"), ["**/*.css", "**/*.ts", "**/*.{ts,tsx}"], ["node_modules", "**/*.test.*"])
    got = sorted((r.pattern, r.file) for r in codebase.scan_files(spark, source).collect())
    assert got == [(0, "a.css"), (1, "deep/b.ts"), (2, "deep/C.tsx"), (2, "deep/b.ts")]
    assert codebase.scan_files(spark, source).filter("file = 'a.css'").first().content == "/* src/a.css */\nline two"


PROJECT = ["a.css", "src/b.css", "src/deep/er/c.ts", "src/deep/.git/x.css", "src/deep/node_modules/p/q/x.css", "node_modules/p/x.css", "lib/one/d.ts", "lib/one/two/d.ts", "docs/guide/e.css", "dist/f.css", ".cache/g.css", "src/h.test.ts", "src/a b+c%20/ü.css"]
CASES = [
    (["**/*.css"], ["node_modules", "**/node_modules", "dist"], {"", "src", "src/deep", "src/deep/er", "lib", "lib/one", "lib/one/two", "docs", "docs/guide", "src/a b+c%20"}),
    (["src/*.css", "lib/*/*.ts"], [], {"", "src", "lib", "lib/one"}),
    (["{src,lib}/**/*.ts", "*.css"], ["**/*.test.*", "src/deep"], {"", "src", "lib", "lib/one", "lib/one/two", "src/a b+c%20"}),
    (["{src/deep,docs}/**"], [], None),
    (["src/**c.ts", "li**d.ts", "**er/*.ts"], [], None),
]


@pytest.mark.parametrize(("patterns", "ignore", "want"), CASES)
def test_folders_that_can_hold_nothing_are_not_listed(spark, tmp_path, monkeypatch, patterns, ignore, want):
    for name in PROJECT:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    fs, listed = pafs.LocalFileSystem(), []
    list_ = lambda f: listed.append(f) or listing.children(fs, str(tmp_path), f)
    rule = listing.Rule(patterns, ignore)
    for enough in (None, 2):
        listed.clear()
        files, waiting = listing.walk(rule, list_, [""], enough)
        files += listing.walk(rule, list_, waiting)[0]
        assert want is None or set(listed) == want
        assert len(listed) == len(set(listed))
        plain = [f for f in PROJECT if not re.search(r"(^|/)\.", f) and any(re.match(listing.glob_regex(p), f) for p in patterns) and not any(re.match(listing.ignore_regex(p), f) for p in ignore)]
        assert sorted(files) == sorted(plain)
    source = CodebaseSource(str(tmp_path), patterns, ignore)
    by_source = lambda df: sorted((r.pattern, r.file, r.content) for r in codebase.select_files(df, patterns, ignore).collect())
    got = sorted((r.pattern, r.file, r.content) for r in codebase.scan_files(spark, source).collect())
    assert got == by_source(codebase._by_spark(spark, source)) and {f for _, f, _ in got} == set(plain)


def test_filters_reach_the_listing(spark, tmp_path):
    for name in PROJECT:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = codebase.scan_files(spark, CodebaseSource(str(tmp_path), ["**/*.css", "**/*.ts"], []))
    every = spark.createDataFrame(found.collect(), found.schema)
    for condition in ("file = 'src/b.css'", "file in ('a.css', 'lib/one/d.ts', 'dist/f.css')", "startswith(file, 'lib/o')", "startswith(file, 'src/') and file = 'a.css'", "file like '%er/c%'"):
        want = every.filter(condition).collect()
        assert sorted(r.file for r in found.filter(condition).collect()) == sorted(r.file for r in want)
    reader = listing.FilesReader({"root": str(tmp_path), "patterns": '["**/*"]', "ignore": "[]"})
    assert list(reader.pushFilters([EqualTo(("file",), "lib/one/d.ts"), EqualTo(("content",), "x"), StringStartsWith(("file",), "lib")])) == [EqualTo(("content",), "x")]
    fs, base, rule = reader._open()
    listed = []
    assert listing.walk(rule, lambda f: listed.append(f) or listing.children(fs, base, f), [""])[0] == ["lib/one/d.ts"] and listed == ["", "lib", "lib/one"]


@pytest.mark.parametrize("body", ['{"meta":', "<html>not json", "null", '{"a": NaN}', ""])
def test_an_answer_that_is_not_json_is_a_failed_source(spark, tmp_path, body):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if self.path == "/index.json" else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    try:
        config = Config(None, FigmaSource("t", "F", url), StorybookSource(url), "codebase", str(tmp_path / "o.json"))
        found, failed = contracts.scan(spark, config)
    finally:
        http.shutdown()
    assert not found and len(failed) == 2 and all("JSON document" in f for f in failed)


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            good = {"/files/F/variables/local": variables(variable("x", "FLOAT", 1)), "/files/F/components": {"meta": {"components": []}}, "/stories.json": {"stories": {}}}
            body = good.get(self.path)
            if self.path.startswith("/files") and self.headers.get("X-Figma-Token") != "secret":
                body = None
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body or "gone").encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_rest(spark, server):
    rest.register(spark)
    got = spark.read.format("figma_rest").options(token="secret", fileId="F", baseUrl=server).load()
    assert sorted(r.name for r in got.collect()) == ["components", "variables"]
    assert spark.read.format("storybook_rest").options(url=server + "/").load().first().body == '{"stories": {}}'
    with pytest.raises(Exception, match="404"):
        spark.read.format("figma_rest").options(token="wrong", fileId="F", baseUrl=server).load().collect()
