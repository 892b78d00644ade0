"""Cell types by an ordered program of rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import normalized

EMPTY, UNTYPED = "empty", "untyped"
IGNORED = ("empty", "untyped", "Missing")


@dataclass(frozen=True)
class Rule:
    """kind: regex (full match), equals, prefix, suffix, or all, any, not over `parts`."""

    type: str
    pattern: str = ""
    kind: str = "regex"
    parts: tuple = ()


def matches(rule: Rule, text: Column) -> Column:
    if rule.kind == "regex":
        return text.rlike(f"\\A(?:{rule.pattern})\\z")
    if rule.kind == "equals":
        return text == rule.pattern
    if rule.kind == "prefix":
        return text.startswith(rule.pattern)
    if rule.kind == "suffix":
        return text.endswith(rule.pattern)
    parts = [matches(p, text) for p in rule.parts]
    if rule.kind == "not":
        return ~parts[0]
    found = parts[0]
    for p in parts[1:]:
        found = found & p if rule.kind == "all" else found | p
    return found


@dataclass(frozen=True)
class Program:
    """Ordered rules; subtype edges in declared order; descriptions of types that only a model's answers give."""

    rules: tuple[Rule, ...]
    edges: tuple[tuple[str, str], ...]
    guidelines: tuple[tuple[str, str], ...] = ()
    name: str = ""
    lines: tuple[int, ...] = field(default=())
    sources: tuple[str, ...] = field(default=())
    options: tuple[str, ...] = field(default=())

    def source(self, rule: int) -> str:
        """Where a rule stands: its file and line, else the program's name and the rule's line or number."""
        return self.sources[rule] if self.sources else f"{self.name}:{self.lines[rule] if self.lines else rule + 1}"

    def parents(self, kind: str) -> list[str]:
        return [b for a, b in self.edges if a == kind]

    def above(self, kind: str) -> set[str]:
        seen: set[str] = set()
        todo = self.parents(kind)
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.add(one)
                todo += self.parents(one)
        return seen

    def chain(self, kind: str) -> list[str]:
        """The type and its first declared supertypes up to the root."""
        out = [kind]
        while (up := self.parents(out[-1])) and up[0] not in out:
            out.append(up[0])
        return out

    def family(self, kind: str) -> str:
        return self.chain(kind)[-1]

    def group(self, kind: str) -> str:
        """The type just below the family, if it has subtypes; else the family."""
        chain = self.chain(kind)
        if len(chain) > 1 and any(b == chain[-2] for _, b in self.edges):
            return chain[-2]
        return chain[-1]

    def types(self) -> list[str]:
        return sorted({r.type for r in self.rules} | {t for e in self.edges for t in e} | {t for _, t in self.guidelines})


def all_matches(program: Program, text: Column) -> Column:
    """Numbers of all matching rules, in order."""
    return F.array_compact(F.array(*[F.when(matches(r, text), F.lit(i)) for i, r in enumerate(program.rules)]))


def cell_rule(program: Program, text: Column) -> Column:
    """The number of the deciding rule: of those matching, whose type is no strict supertype of another match, the
    earliest; the earliest of all if a cycle leaves none; null for no match. Where no type of a rule is above
    another's, that is the first that matches, and the rules after it are not tried."""
    below = [[j for j, s in enumerate(program.rules) if r.type in program.above(s.type) and s.type != r.type] for r in program.rules]
    if not any(below):
        first = F
        for i, r in enumerate(program.rules):
            first = first.when(matches(r, text), F.lit(i))
        return first if program.rules else F.lit(None).cast("int")
    found = all_matches(program, text)
    table = F.array(*[F.array(*[F.lit(j) for j in b]).cast("array<int>") for b in below])
    kept = F.filter(found, lambda i: ~F.arrays_overlap(F.element_at(table, i + 1), found))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.try_element_at(found, F.lit(1)))


def lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def named(values: list[str], number: Column) -> Column:
    """The value at a place from 0; null for none."""
    return F.when(number.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), number + 1))


def family_of(program: Program, kind: Column) -> Column:
    return F.coalesce(lookup({t: program.family(t) for t in program.types()}, kind), kind)


def group_of(program: Program, kind: Column) -> Column:
    return F.coalesce(lookup({t: program.group(t) for t in program.types()}, kind), kind)


def with_types(program: Program, df: DataFrame, text: Column, gap: Column) -> DataFrame:
    """df with type, family, group and source. The text is normalised once, and the rules run once."""
    typed = df.withColumn("_text", F.when(gap, "").otherwise(normalized(text)))
    typed = typed.withColumn("_rule", F.when(F.col("_text") != "", cell_rule(program, F.col("_text"))))
    rule = F.col("_rule")
    typed = typed.withColumn("type", F.when(rule.isNotNull(), named([r.type for r in program.rules], rule)).otherwise(F.when(F.col("_text") == "", EMPTY).otherwise(UNTYPED)))
    sources = [program.source(k) for k in range(len(program.rules))]
    source = F.when(gap, "synthetic").when(rule.isNotNull(), named(sources, rule)).otherwise(F.col("type"))
    of_type = lambda values, more: F.when(rule.isNotNull(), named(values, rule)).otherwise(more)
    return (
        typed.withColumn("family", of_type([program.family(r.type) for r in program.rules], F.col("type")))
        .withColumn("group", of_type([program.group(r.type) for r in program.rules], F.col("type"))).withColumn("source", source).drop("_text", "_rule")
    )


def type_texts(program: Program, texts: DataFrame) -> DataFrame:
    """text, type, family and group of each distinct normalised text: rules run once for a repeated text."""
    known = texts.select(normalized(F.col("text")).alias("text")).distinct()
    return with_types(program, known, F.col("text"), F.lit(False)).drop("source")


def type_cells(program: Program, cells: DataFrame) -> DataFrame:
    """cells (table_uid, cell_id, text, kind optional) with type, family, group and source. Gap cells are empty, their source synthetic.

    Types are computed in place: a join back on text would put all rows of the commonest texts into one task.
    """
    gap = F.coalesce(F.col("kind") == "synthetic_gap", F.lit(False)) if "kind" in cells.columns else F.lit(False)
    return with_types(program, cells, F.col("text"), gap)


def type_records(cell_types: DataFrame) -> DataFrame:
    """Counts of cells, typed, untyped and empty ones by table, with the untyped ones listed."""
    family = F.col("family")
    return cell_types.groupBy("table_uid").agg(
        F.count("*").alias("n_cells"), F.count_if(~family.isin(EMPTY, UNTYPED)).alias("typed"), F.count_if(family == UNTYPED).alias("untyped"), F.count_if(family == EMPTY).alias("empty"),
        F.sort_array(F.collect_list(F.when(family == UNTYPED, F.struct("cell_id", "text")))).alias("untyped_cells"),
    )


def type_rasters(slots: DataFrame, cell_types: DataFrame) -> DataFrame:
    """(table_uid, type_raster array<array<string>>): the type of the cell on every place. One row holds one table, which
    geometry.table_budget bounds."""
    placed = slots.join(cell_types.select("table_uid", "cell_id", "type"), ["table_uid", "cell_id"])
    in_order = lambda what, by: F.transform(F.sort_array(F.collect_list(F.struct(by, what))), lambda s: s[what])
    rows = placed.groupBy("table_uid", "row_idx").agg(in_order("type", "col_idx").alias("types"))
    return rows.groupBy("table_uid").agg(in_order("types", "row_idx").alias("type_raster"))


def coverage(records: DataFrame) -> DataFrame:
    """The share of non-empty cells that no rule typed."""
    return records.agg(F.try_divide(F.sum("untyped").cast("double"), F.sum(F.col("n_cells") - F.col("empty"))).alias("untyped_share"))


def distribution(cell_types: DataFrame) -> DataFrame:
    per = cell_types.groupBy("family", "type").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))  # as many rows as types


def ambiguity(program: Program, texts: DataFrame) -> DataFrame:
    """How many rows match no rule, one rule, several rules of one family, and rules of several families."""
    families = F.array(*[F.lit(program.family(r.type)) for r in program.rules])
    found = all_matches(program, normalized(F.col("text")))
    kinds = F.array_distinct(F.transform(found, lambda i: F.element_at(families, i + 1)))
    level = F.when(F.size(found) == 0, "none").when(F.size(found) == 1, "one_rule").when(F.size(kinds) == 1, "one_family").otherwise("several_families")
    return texts.select(level.alias("matches")).groupBy("matches").agg(F.count("*").alias("n"))


# The patterns and types of the published rule program for scientific tables, in its order.
_PATTERNS = (
    ("Integer", r"[-−–]?[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+"),
    ("Decimal", r"[-−–]?(?:[0-9]+\.[0-9]+|\.[0-9]+)"),
    ("Percent", r"[-−–]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+) ?%"),
    ("Scientific", r"[-−–]?[0-9]+(?:\.[0-9]+)? ?[×x] ?10 ?[-−–+]?[0-9]+(?: [0-9]+)?"),
    ("Scientific", r"[-−–]?[0-9]+(?:\.[0-9]+)?[eE][-−–+]?[0-9]+"),
    ("Inequality", r"[<>≤≥⩽⩾] ?[-−–]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"),
    ("AnnotatedNumber", r"[-−–]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?: ?%)? ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}|[†‡§¶#]+)"),
    ("MeanSD", r"[-−–]?[0-9]+(?:\.[0-9]+)?(?: ?%)? ?± ?[0-9]+(?:\.[0-9]+)?(?: ?%)?(?: ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}|[†‡§¶#]+))?"),
    ("MeanSD", r"[-−–]?[0-9]+(?:\.[0-9]+)?(?: ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}))? ?\( ?± ?[0-9]+(?:\.[0-9]+)? ?\)(?: ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}|[†‡§¶#]+))?"),
    ("MeanSD", r"[-−–]?[0-9]+(?:\.[0-9]+)? ?\( ?[-−–]?[0-9]+(?:\.[0-9]+)? ?± ?[0-9]+(?:\.[0-9]+)? ?\)"),
    ("ValueParen", r"[-−–]?[0-9]+(?:\.[0-9]+)? ?\( ?[-−–]?[0-9]+(?:\.[0-9]+)? ?%? ?\)(?: ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}|[†‡§¶#]+))?"),
    ("ValueInterval", r"[-−–]?[0-9]+(?:\.[0-9]+)?,? ?[\[(] ?[-−–]?[0-9]+(?:\.[0-9]+)? ?(?:,|;|–|−|-|to) ?[-−–]?[0-9]+(?:\.[0-9]+)? ?[\])](?: ?(?:\*{1,3}|[a-h]{1,4}|[A-H]{1,2}|[†‡§¶#]+))?"),
    ("NumberRange", r"[-−–]?[0-9]+(?:\.[0-9]+)? ?(?:–|—|-|to|~) ?[-−–]?[0-9]+(?:\.[0-9]+)?(?: ?%)?"),
    ("NumberRange", r"[0-9]+\+"),
    ("Ratio", r"[0-9]+(?:\.[0-9]+)?(?::[0-9]+(?:\.[0-9]+)?)+"),
    ("NumberList", r"[-−–]?[0-9]+(?:\.[0-9]+)?(?:(?:, ?| |/)[-−–]?[0-9]+(?:\.[0-9]+)?)+"),
    ("TestStatistic", r"(?:[A-Za-zχΧ²]{1,3}2? ?(?:\( ?[0-9]+ ?, ?[0-9]+ ?\))? ?[=<>≤≥] ?(?:\( ?[0-9]+ ?, ?[0-9]+ ?\) )?[-−–]?[0-9]*\.?[0-9]+(?:, ?)?)+"),
    ("Measurement", r"[-−–]?[0-9]+(?:\.[0-9]+)? ?(?:°[CF]?|[µμ]?[a-zA-Z]{1,3}(?: ?[-−–]?[0-9])?(?:[/·][a-zA-Z]{1,3}(?: ?[-−–]?[0-9])?)*)"),
    ("Dash", r"[-–—−]{1,3}|\.{2,3}|…"),
    ("NotAvailable", r"(?i)n\.? ?/? ?[ad]\.?|nr|ns|nd|none|not (?:available|reported|applicable)"),
    ("Arrow", r"[↑↓→←⇑⇓]+"),
    ("Mark", r"[✓✔✗✘×+*•○●]+"),
    ("Citation", r"(?!(?:Year|Years|Season|Week|Weeks|Month|Months|Day|Days|Phase|Stage|Trial|Study|Model|Wave|Cohort|Visit|Round|Period|Total|Average|Mean|Spring|Summer|Autumn|Fall|Winter|Baseline|Follow)\b)(?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]en|[Dd]er|[Dd]el|[Dd]a|[Dd]i|[Ll]e|[Ll]a) )*\p{Lu}[\p{L}’'\-‐]+(?:(?: and | & | )(?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]en|[Dd]er|[Dd]el|[Dd]a|[Dd]i|[Ll]e|[Ll]a) )*\p{Lu}[\p{L}’'\-‐]+)?(?:,? et al\.?)?(?:,? ?\(?(?:19|20)[0-9]{2}[a-z]?\)?(?: \(\p{Lu}+\))?(?: ?\[ ?[0-9]+(?: ?[,–-] ?[0-9]+)* ?\]| [0-9]{1,3})?| ?\[ ?[0-9]+(?: ?[,–-] ?[0-9]+)* ?\](?: ?\((?:19|20)[0-9]{2}[a-z]?\))?)(?: \p{Lu}{3}(?: (?:AND|and|&) \p{Lu}{3})*)?(?: \(\p{Lu}+\))?"),
    ("TrialID", r"NCT[0-9]{8}|ISRCTN[0-9]{6,8}|ChiCTR[A-Za-z0-9-]+"),
    ("VariantID", r"rs[0-9]{3,}(?: \(.*\))?"),
    ("Word", r"\p{L}[\p{L}'’\-]*"),
    ("LabelWithUnit", r"\p{L}[\p{L}\p{N} '’.\-–/&]*(?: ?\([^()]{1,25}\)|, ?(?:%|[\p{L}%/ ]{1,15}))"),
    ("LabeledStatistic", r"\p{L}[\p{L}\p{N} '’.\-–/&]*, (?:[A-Za-zχΧ²]{1,3}2? ?[=<>≤≥] ?[-−–]?[0-9]*\.?[0-9]+(?:, ?)?)+"),
    ("Unit", r"%|\( ?(?:%|[µμ°]?[\p{L}]{1,4}(?: ?[-−–]?[0-9])?(?:[ /·][µμ]?[\p{L}]{1,4}(?: ?[-−–]?[0-9])?)*) ?\)"),
    ("Phrase", r"[0-9]+(?:\.[0-9]+)?%? ?\p{L}{1,}[\p{L}\p{N} '’.,;:\-–/&+()\[\]%@]*"),
    ("Phrase", r"(?:\p{L}|% ?\p{L})[\p{L}\p{N} '’.,;:\-–/&+()\[\]%]*"),
)
# Its families with their types, and the types that a model's answers refine.
_FAMILIES = (
    ("Numeric", "Integer Decimal Percent Scientific Inequality AnnotatedNumber MeanSD ValueParen ValueInterval NumberRange Ratio NumberList TestStatistic Measurement"),
    ("Text", "Word Phrase LabelWithUnit LabeledStatistic Unit"),
    ("Missing", "Dash NotAvailable"),
    ("Symbol", "Arrow Mark"),
    ("Identifier", "Citation TrialID VariantID"),
)
_REFINED = (
    ("VariableLabel", "Text Word Phrase LabelWithUnit"),
    ("CategoryLevel", "Text Word Phrase LabelWithUnit"),
    ("EntityName", "Text Word Phrase LabelWithUnit"),
    ("StatisticLabel", "Text Word Phrase LabelWithUnit"),
    ("Description", "Text Phrase"),
)
_GUIDELINES = (
    ("a measured variable, possibly with its unit", "VariableLabel"),
    ("a level, group, arm or condition", "CategoryLevel"),
    ("an individual entity that a row or column describes", "EntityName"),
    ("a statistic or measure, as used in a heading", "StatisticLabel"),
    ("free text that states a finding, method or comment", "Description"),
)
SCIENCE = Program(
    tuple(Rule(t, p) for t, p in _PATTERNS),
    tuple((t, f) for f, ts in _FAMILIES for t in ts.split()) + tuple((t, s) for t, ss in _REFINED for s in ss.split()),
    _GUIDELINES,
    "science",
)
