"""Small inputs with outputs derived by hand (FIXTURES.md, G1-G4)."""

import pytest

from tokenloom.operators import extract

CSS = ":root{\n  --bg: #fff;\n  --spacing-sm:\n 4px;\n --alias: var(--bg);\n --e: ;\n --z:;\n}\n.card--active:hover { color: red; }\n:root{--last: 1px}\n.b{margin:0;}"
TS = "export const c = {\n  primary: '#0af',\n  'quoted-key': '#fff',\n  muted: rgba(0,0,0,0.5),\n  500: \"#abcdef12\",\n  bad: `#fff`,\n  primary: '#111',\n}"
TSX = "import x\ninterface ButtonProps {\n  variant: string;\n  size?: 'sm' | 'lg'\n  onClick: (e: Event) => void\n}\nexport function Button2(props: ButtonProps) {}"


def files(spark, *rows):
    return spark.createDataFrame([(k, f, c) for k, (f, c) in enumerate(rows)], "pattern int, file string, content string")


def test_css(spark):
    got = {tuple(r) for r in extract.css_tokens(files(spark, ("a.css", CSS))).select("category", "name", "value", "line").collect()}
    assert got == {("colors", "bg", "#fff", 2), ("spacing", "spacing-sm", "4px", 3), ("other", "e", "", 6), ("other", "active", "hover { color: red", 9), ("other", "last", "1px}\n.b{margin:0", 10)}


def test_typescript_colors(spark):
    df = files(spark, ("a.ts", TS))
    assert [(r.name, r.value) for r in extract.ts_color_tokens(df).orderBy("number").collect()] == [("primary", "#0af"), ("muted", "rgba(0,0,0,0.5)"), ("500", "#abcdef12"), ("primary", "#111")]
    kept = {r.name: (r.value, r.source.line) for r in extract.codebase_tokens(df).collect()}
    assert kept == {"primary": ("#0af", 2), "muted": ("rgba(0,0,0,0.5)", 4), "500": ("#abcdef12", 5)}


def test_component_and_props(spark):
    (r,) = extract.codebase_components(files(spark, ("x/b.tsx", TSX))).collect()
    assert (r.name, r.source.line) == ("Button", 7)
    assert {k: (v.type, v.required) for k, v in r.props.items()} == {"variant": ("string", True), "size": ("'sm' | 'lg'", False), "onClick": ("(e: Event) => void", True)}


@pytest.mark.parametrize(("file", "name"), [("a/Card.tsx", "Card"), ("card.tsx", None), ("[slug].tsx", "[slug]"), ("_app.tsx", "_app"), ("404.jsx", "404")])
def test_component_from_file_name(spark, file, name):
    got = [(r.name, r.line) for r in extract.component_names(files(spark, (file, "const a = 1"))).collect()]
    assert got == ([(name, 1)] if name else [])


@pytest.mark.parametrize(
    ("writes", "value"),
    [(["#c1", "#c2"], "#c2"), (["t111", "t222"], "#111"), (["#c1", "t222"], "#c1"), (["t111", "#c2"], "#c2"), (["t111", "#c2", "t333"], "#c2")],
)
def test_css_and_typescript_on_one_name(spark, writes, value):
    rows = [(f"{k}.ts", f"bg: '#{w[1:]}'") if w[0] == "t" else (f"{k}.css", f"--bg: {w};") for k, w in enumerate(writes)]
    (r,) = extract.codebase_tokens(files(spark, *rows)).collect()
    assert (r.category, r.name, r.value, r.ord.c) == ("colors", "bg", value, 1)


def test_empty(spark):
    assert extract.codebase_tokens(files(spark, ("a.css", ""), ("b.ts", ""))).count() == 0


def test_white_space_is_more_than_ascii(spark):
    odd = "  ﻿　"
    got = [(r.name, r.value) for r in extract.css_tokens(files(spark, ("a.css", f"--a:{odd}4px{odd};--b: x;"))).orderBy("number").collect()]
    assert got == [("a", "4px"), ("b", "x")]
