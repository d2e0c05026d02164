"""Call graphs of source files: extraction, restriction to defined functions, adjacency, DOT and JSON."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of source files.
LANGUAGES = {".py": "python", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp"}
C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "case", "new", "delete", "throw", "alignof", "decltype", "static_assert", "typeof", "defined"}


def language(path: Column) -> Column:
    """python, c or cpp by a file's suffix; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


class _Calls(ast.NodeVisitor):
    """Calls belong to the innermost function around them; async functions aren't functions of their own here."""

    def __init__(self) -> None:
        self.within: list[str] = []
        self.edges: list[tuple[str, str]] = []
        self.names: list[str] = []

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.names.append(node.name)
        self.within.append(node.name)
        self.generic_visit(node)  # decorators and defaults with it
        self.within.pop()

    def visit_Call(self, node: ast.Call) -> None:
        called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if self.within and called:
            self.edges.append((self.within[-1], called))
            second = node.args[1] if len(node.args) > 1 else None
            if called.endswith(("add_node", "add_conditional_edges")) and isinstance(second, ast.Name):
                self.edges.append((self.within[-1], second.id))
            elif called.endswith("add_node") and isinstance(second, ast.Lambda) and isinstance(second.body, ast.Call):
                f = second.body.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    self.edges.append((self.within[-1], name))
        self.generic_visit(node)


def python_calls(source: str) -> tuple[list[str], list[tuple[str, str]]]:
    v = _Calls()
    v.visit(ast.parse(source))
    return v.names, v.edges


def c_calls(source: str) -> tuple[list[str], list[tuple[str, str]]]:
    """An approximation by matching braces: a name, parentheses and a brace define a function; a name and a parenthesis call one."""
    s = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", lambda m: " " * len(m.group()), source, flags=re.S | re.M)
    names, edges, at = [], [], 0
    head = re.compile(r"([A-Za-z_~][\w:~]*)\s*\(([^(){};]|\([^(){};]*\))*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>&* ]+|:[^{};]*|\s)*\{")
    while m := head.search(s, at):
        name = m.group(1).rsplit("::", 1)[-1]
        if name in C_WORDS:
            at = m.end()
            continue
        depth, end = 1, m.end()
        while depth and end < len(s):
            depth += {"{": 1, "}": -1}.get(s[end], 0)
            end += 1
        names.append(name)
        edges += [(name, c.group(1).rsplit("::", 1)[-1]) for c in re.finditer(r"([A-Za-z_][\w:]*)\s*\(", s[m.end() : end]) if c.group(1).rsplit("::", 1)[-1] not in C_WORDS]
        at = end
    return names, edges


def extract(files: DataFrame, path: str = "path", source: str = "text") -> DataFrame:
    """file, kind ('node', 'edge' or 'error'), caller, callee, ord: definitions and calls of each file; a file that can't be parsed gives one error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, s in b.itertuples(index=False, name=None):
                try:
                    names, edges = (python_calls if lang == "python" else c_calls)(s or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((p, "error", str(e), None, 0))
                    continue
                rows += [(p, "node", n, None, k) for k, n in enumerate(dict.fromkeys(names))]
                rows += [(p, "edge", a, c, k) for k, (a, c) in enumerate(edges)]
            yield pd.DataFrame(rows, columns=["file", "kind", "caller", "callee", "ord"])

    return files.select(path, language(F.col(path)).alias("_l"), source).where("_l is not null").mapInPandas(run, "file string, kind string, caller string, callee string, ord long")


def defined_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are defined in the file. edges: file, caller, callee, ord; nodes: file, name."""
    n = nodes.select("file", "name").distinct()
    e = edges.join(n.withColumnRenamed("name", "caller"), ["file", "caller"], "left_semi")
    return e.join(n.withColumnRenamed("name", "callee"), ["file", "callee"], "left_semi").select("file", "caller", "callee", "ord")


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, name, callees: in order, with repeats; functions without calls keep an empty list."""
    called = defined_calls(edges, nodes).groupBy("file", F.col("caller").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "callee"))), lambda x: x["callee"]).alias("callees"))
    return nodes.select("file", "name").distinct().join(called, ["file", "name"], "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))


def first_seen(edges: DataFrame) -> DataFrame:
    """Each (caller, callee) of a file once, where it first occurs."""
    return edges.groupBy("file", "caller", "callee").agg(F.min("ord").alias("ord"))


def graph_json(graph: DataFrame) -> DataFrame:
    """file, json: names to callees, by name."""
    return graph.groupBy("file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "callees"))))).alias("json"))


def dot(graph: DataFrame) -> DataFrame:
    """file, dot: DOT text, nodes by name, each edge once in the order of callers and first calls."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ends = graph.select("file", F.explode(F.concat(F.array("name"), "callees")).alias("n")).distinct().groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: F.concat(F.lit("  "), quoted(x), F.lit(";"))), "\n").alias("nodes"))
    e = graph.select("file", "name", F.array_distinct("callees").alias("c")).groupBy("file").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "c"))), lambda x: F.transform(x["c"], lambda c: F.concat(F.lit("  "), quoted(x["name"]), F.lit(" -> "), quoted(c), F.lit(";"))))).alias("edges"))
    # fixed values: the header
    head = F.concat(F.lit('digraph G {\n  label="'), "file", F.lit('";\n  labelloc=t;\n  rankdir=LR;\n  node [shape=box, style=rounded, fontname="Helvetica"];\n  edge [fontname="Helvetica"];\n  ordering=out;\n'))
    body = F.concat_ws("\n", "nodes", F.array_join("edges", "\n"))
    return ends.join(e, "file").select("file", F.concat(head, F.regexp_replace(body, r"\n$", ""), F.lit("\n}")).alias("dot"))
