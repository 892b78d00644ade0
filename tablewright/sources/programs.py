"""Rule programs kept in files: JSON Lines of statements, which may import other files."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.rules import Program, Rule


def statements(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(line from 1, statement) of a program file. A program is configuration, of a few hundred lines, and read whole."""
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    return [(n, json.loads(line)) for n, line in enumerate(lines, 1) if line.strip()]


def pattern(told: dict, kind: str = "") -> Rule:
    """A pattern: {"regex": s}, {"equals": s}, {"prefix": s}, {"suffix": s}, {"all": [...]}, {"any": [...]} or {"not": p}."""
    if len(told) != 1:
        raise ValueError(f"a pattern has one kind: {told}")
    ((how, what),) = told.items()
    if how in ("all", "any"):
        return Rule(kind, "", how, tuple(pattern(p) for p in what))
    if how == "not":
        return Rule(kind, "", how, (pattern(what),))
    if how not in ("regex", "equals", "prefix", "suffix"):
        raise ValueError(f"unknown pattern {how}")
    return Rule(kind, what, how)


def beside(path: str, other: str) -> str:
    """Where a file named in another one lies."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    return other if other.startswith("/") or "://" in other else posixpath.normpath(f"{folder}/{other}") if "://" not in path else f"{folder}/{other}"


def load_program(spark: SparkSession, path: str) -> Program:
    """The program of a file. Statements, one JSON object a line:

    {"import": file}, relative to the file it stands in; {"type": name}; {"type": name, "is": [names]}, an alias;
    {"subtype": [sub, super]}; {"rule": pattern, "type": name}; {"guideline": description, "type": name};
    {"option": name}.

    Imported statements come before a file's own, wherever the import stands, and a file counts once, in the place
    where it is first met; a circle of imports ends there. A type declared twice, as a type or an alias, is an error that
    names the file and the line. A rule's or guideline's alias stands for the types that it is made of, the first of
    which it decides; types need not be declared.
    """
    seen: set[str] = set()

    def expand(at: str) -> list[tuple[str, dict]]:
        seen.add(at)
        own, before = [], []
        for line, told in statements(spark, at):
            if "import" not in told:
                own.append((f"{posixpath.basename(at)}:{line}", told))
            elif (other := beside(at, told["import"])) not in seen:
                before += expand(other)
        return before + own

    declared: dict[str, list[str]] = {}
    rules, sources, edges, guidelines, options = [], [], [], [], []
    every = expand(path)
    for origin, told in every:
        if "type" in told and "rule" not in told and "guideline" not in told:
            if told["type"] in declared:
                raise ValueError(f"{origin}: type {told['type']} is declared twice")
            declared[told["type"]] = told.get("is", [])

    def decided(name: str, met: tuple = ()) -> str:
        made = declared.get(name)
        return name if not made or name in met else decided(made[0], (*met, name))

    for origin, told in every:
        if "rule" in told:
            rules.append(pattern(told["rule"], decided(told["type"])))
            sources.append(origin)
        elif "guideline" in told:
            guidelines.append((told["guideline"], decided(told["type"])))
        elif "subtype" in told:
            edges.append((decided(told["subtype"][0]), decided(told["subtype"][1])))
        elif "option" in told:
            options.append(told["option"])
        elif "type" not in told:
            raise ValueError(f"{origin}: unknown statement {told}")
    return Program(tuple(rules), tuple(edges), tuple(guidelines), posixpath.basename(path), sources=tuple(sources), options=tuple(options))


def program_lines(program: Program) -> list[str]:
    """A program's statements as load_program reads them: types, subtypes, rules, guidelines, options."""

    def told(rule: Rule) -> dict:
        if rule.kind in ("all", "any"):
            return {rule.kind: [told(p) for p in rule.parts]}
        return {rule.kind: told(rule.parts[0]) if rule.kind == "not" else rule.pattern}

    out: list[dict] = [{"type": t} for t in program.types()] + [{"subtype": list(e)} for e in program.edges]
    out += [{"rule": told(r), "type": r.type} for r in program.rules] + [{"guideline": d, "type": t} for d, t in program.guidelines] + [{"option": o} for o in program.options]
    return [json.dumps(x, ensure_ascii=False) for x in out]


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """Lines as a text file of one part; `path` is its folder, which load_program reads as well as a file."""
    one: DataFrame = spark.range(1).select(F.lit("\n".join(lines)).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
