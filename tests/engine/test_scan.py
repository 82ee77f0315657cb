"""Whole source files: one of each language with forms that lines can't show, and real Python against its own parser."""

import ast
import inspect
import json
import shutil
import subprocess
import tokenize
from pathlib import Path

import pytest

import skeinlake.catalog
from skeinlake.operators import scan

SAMPLES = Path(skeinlake.catalog.__file__).parent / "samples"
LANGUAGE = {"ts": "typescript", "py": "python", "java": "java", "cpp": "cpp", "c": "c", "go": "go", "rs": "rust", "js": "javascript"}
HELD = json.loads((SAMPLES / "expected.json").read_text())
PICK = {"function": (3, 4, 5, 6, 7, 13, 14), "class": (3, 8, 9, 13, 14), "call": (3, 12, 13), "comment": (10, 11, 13)}


@pytest.mark.parametrize("file", sorted(HELD))
def test_a_file_of_each_language(file):
    rows = list(scan.scanned("p", LANGUAGE[file.split(".")[1]], (SAMPLES / f"{file}.txt").read_text()))
    for kind, pick in PICK.items():
        assert [[r[k] for k in pick] for r in rows if r[2] == kind] == HELD[file][kind]


def _name(text, language):
    return [(r[3], r[4]) for r in scan.scanned("p", language, text) if r[2] == "function"]


def test_forms_that_lines_miss():
    assert _name("const f = (a) => a", "javascript") == [("f", ["a"])]
    assert _name("class A {\n m(\n a,\n b = [1, 2]\n ) {\n }\n}", "javascript") == [("m", ["a", "b = [1, 2]"])]
    assert _name("class A {\n public Map<String, Integer> f(int a) {\n }\n}", "java") == [("f", ["int a"])]
    assert _name("void A::run(int a) {\n}", "cpp") == [("run", ["int a"])]
    assert _name("def g(a=(1,2), b=3): pass", "python") == [("g", ["a=(1,2)", "b=3"])]
    assert _name("/* fn no() {} */ fn yes(a: u8) {}", "rust") == [("yes", ["a: u8"])]
    assert _name('s = "def no(): pass"\n', "python") == [] and _name("if (a) { b(c) }", "javascript") == []


def test_broken_and_empty_files():
    for language in LANGUAGE.values():
        for text in ("", "\n", "{", "}", '"', "/*", "fn (", "def f(", "class", "((((", "function f(", "class A { m(", "\x00", "é 漢字 \U0001f600"):
            list(scan.scanned("p", language, text))


def test_python_functions_as_its_own_parser_finds_them():
    seen = 0
    for module in (ast, inspect, json.decoder, shutil, subprocess, tokenize, pytest):
        text = Path(module.__file__).read_text()
        want = sorted((x.name, x.lineno, x.end_lineno, isinstance(x, ast.AsyncFunctionDef)) for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)))
        assert sorted((r[3], r[13], r[14], r[7]) for r in scan.scanned("p", "python", text) if r[2] == "function") == want
        classes = sorted((x.name, x.lineno, x.end_lineno) for x in ast.walk(ast.parse(text)) if isinstance(x, ast.ClassDef))
        assert sorted((r[3], r[13], r[14]) for r in scan.scanned("p", "python", text) if r[2] == "class") == classes
        seen += len(want)
    assert seen > 300


def test_structure_of_odd_tables(spark):
    rows = [("a.py", "def f(): pass"), ("a.py", "def f(): pass"), ("b.rs", None), (None, "fn f() {}"), ("c.txt", "fn f() {}"), ("d.go", "")]
    got = scan.structure(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r["path"], r["name"]) for r in scan.functions(got).collect()) == [("a.py", "f"), ("a.py", "f")]
    assert scan.structure(spark.createDataFrame([], "path string, content string")).count() == 0


@pytest.mark.parametrize("file", sorted(HELD))
def test_a_kind_alone_gives_its_rows(file, monkeypatch):
    language, text = LANGUAGE[file.split(".")[1]], (SAMPLES / f"{file}.txt").read_text()
    rows = list(scan.scanned("p", language, text))
    for kind in scan.KINDS:
        assert list(scan.scanned("p", language, text, frozenset([kind]))) == [r for r in rows if r[2] == kind]
    # Comments need no brackets, heads or calls.
    monkeypatch.setattr(scan, "_code", None)
    assert list(scan.scanned("p", language, text, frozenset(["comment"]))) == [r for r in rows if r[2] == "comment"]


def test_rows_of_many_files_come_in_one_batch():
    import pyarrow as pa

    files = pa.RecordBatch.from_arrays([pa.array(["a.py"] * 50), pa.array(["python"] * 50), pa.array(["def f(): pass"] * 50)], ["path", "language", "content"])
    assert [b.num_rows for b in scan._run([files])] == [50]


def test_what_stands_before_a_call():
    calls = lambda text, language="javascript": [(r[3], r[12]) for r in scan.scanned("p", language, text) if r[2] == "call"]
    assert calls("a . b(c)\n.d(e); new\nF(g); new a.F(); h(newf(i)); x\n::y(); p->q(); é_z(1); 1w()") == [("b", True), ("d", True), ("h", False), ("newf", False), ("y", True), ("q", True), ("_z", False), ("w", False)]
