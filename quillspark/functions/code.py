"""Source code: whether it parses, and what it defines."""

from __future__ import annotations

import ast

import pandas as pd

from quillspark.functions.arrow import arrow_udf

#: Names that stand for a language; others are taken as they are.
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "rb": "ruby", "golang": "go", "sh": "bash", "shell": "bash", "yml": "yaml", "c++": "cpp", "rs": "rust"}
ORDER = ("python", "javascript", "typescript", "java", "go", "ruby")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def language_of(name: str | None) -> str | None:
    return ALIASES.get(name.strip().lower(), name.strip().lower()) if name and name.strip() else None


def _tree(code: str):
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def balanced(code: str) -> bool:
    """Brackets pair up outside quotes, and quotes close on their line."""
    stack, quote, escaped = [], "", False
    for c in code:
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
            elif c == "\n" and quote != "`":
                return False
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() != _PAIRS[c]):
            return False
    return not stack and not quote


def valid_language(code: str | None, hint: str | None = None) -> str | None:
    """The first language, the hint before all, in which the code parses; without grammars the
    languages other than Python are tested by balance and a mark of code."""
    if not code or not code.strip():
        return None
    for language in dict.fromkeys(x for x in (language_of(hint), *ORDER) if x):
        if language == "python":
            if _tree(code) is not None:
                return language
        elif balanced(code) and any(m in code for m in ("{", "(", "=", ";", "def ", "end")):
            return language
    return None


def code_metadata(code: str | None, language: str | None = "python") -> dict:
    """Functions with parameters, classes, assigned names, counts of try and list comprehensions."""
    out = {"success": False, "functions": [], "parameters": [], "docstrings": [], "classes": [], "assigned": [], "tries": 0, "comprehensions": 0}
    tree = _tree(code or "") if language_of(language) in (None, "python") else None
    if tree is None:
        return out
    for x in ast.walk(tree):
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            out["functions"].append(x.name)
            out["parameters"].append(", ".join(a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs)))
            out["docstrings"].append(ast.get_docstring(x) or "")
        elif isinstance(x, ast.ClassDef):
            out["classes"].append(x.name)
        elif isinstance(x, ast.Assign):
            out["assigned"] += [t.id for t in x.targets if isinstance(t, ast.Name)]
        out["tries"] += isinstance(x, ast.Try)
        out["comprehensions"] += isinstance(x, ast.ListComp)
    return out | {"success": True}


@arrow_udf("string")
def valid_language_udf(code: pd.Series, hint: pd.Series) -> pd.Series:
    return pd.Series([valid_language(c, h) for c, h in zip(code, hint, strict=True)])


@arrow_udf("struct<success:boolean,functions:array<string>,parameters:array<string>,docstrings:array<string>,classes:array<string>,assigned:array<string>,tries:int,comprehensions:int>")
def code_metadata_udf(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([code_metadata(c, x) for c, x in zip(code, language, strict=True)], columns=["success", "functions", "parameters", "docstrings", "classes", "assigned", "tries", "comprehensions"])
