"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: a disjunction of conjunctions of trigrams that any match must
hold (over A-Z-lowered text, so it is weaker than the rule, never stronger). The index holds a posting for each
document and each trigram that some rule asks for; a rule's candidates are the documents whose postings fill one of its
conjunctions. Rules without mandatory trigrams have every document as candidate. Candidates are verified by the regex;
spans come from the gaps between matches, in code points. The candidates are a stored table of ids, and are broadcast
while they are few (counted), so that no text moves; beyond that texts and candidates are joined by a shuffle.

Defined results: a null text counts as empty; a document without spans has zero counts, the digest of the empty string
and an empty span list; texts of any length are scanned
whole; rows repeated with the same id and text get equal results; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, materialize, small


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # whose length counts
    least: int = 0
    base: bool = False


# The base rules, then rules for well-known token shapes.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

MOST_STRINGS = 64


def _walk(tree) -> tuple[set[str] | None, list[set[str]]]:
    """(the strings the expression is exactly, or None; else the sets of which a match holds one string each)."""
    held: list[set[str]] = []
    exact = {""}

    def close():
        nonlocal exact
        held.append(exact)
        exact = {""}

    whole = True
    for op, arg in tree:
        part, inner = None, []
        if op is kinds.LITERAL:
            part = {chr(arg).lower()}
        elif op is kinds.IN:
            chars = [chr(v) for k, v in arg if k is kinds.LITERAL]
            part = {c.lower() for c in chars} if len(chars) == len(arg) and len(chars) <= 8 else None
        elif op is kinds.SUBPATTERN:
            part, inner = _walk(arg[3])
        elif op is kinds.BRANCH:
            found = [_walk(branch) for branch in arg[1]]
            if all(p is not None for p, _ in found):
                part = set().union(*(p for p, _ in found))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, of = arg
            once, _ = _walk(of)
            if once is not None and high == 1:
                part = once | ({""} if not low else set())
            elif low and once is None:
                inner = _walk(of)[1]
        if part is not None and len(part) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a, b in itertools.product(exact, part)}
            continue
        whole = False
        close()
        if part is not None:
            exact = part
        held += inner
    if whole:
        return exact, []
    close()
    return None, held


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The conjunctions of which every match fills one; empty where no trigram is mandatory."""
    exact, held = _walk(parser.parse(regex))
    clauses: list[frozenset[str]] = [frozenset()]
    for strings in [exact] if exact is not None else held:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in options and len(options) * len(clauses) <= MOST_STRINGS:
            clauses = [a | b for a in clauses for b in options]
    return [] if clauses == [frozenset()] else sorted(set(clauses), key=sorted)


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """_id, _text_key and the kinds of the indexed rules whose trigram query the document fills. docs: _id, _text_key, _text."""
    spark = docs.sparkSession
    clauses = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(trigram_query(r.regex)) for t in sorted(c)]
    wanted = sorted({t for _, _, t, _ in clauses})
    asked = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, trigram string, needs int"))
    low = ascii_lower(F.col("_text"))
    postings = docs.select("_id", "_text_key", low.alias("_low")).select("_id", "_text_key", F.explode(F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted]))).alias("trigram"))
    filled = postings.join(asked, "trigram").groupBy("_id", "_text_key", "kind", "clause", "needs").agg(F.size(F.collect_set("trigram")).alias("n")).filter("n = needs")
    return filled.groupBy("_id", "_text_key").agg(F.collect_set("kind").alias("_kinds"))


SPAN = "array<struct<start: int, nth: int, stop: int, kind: string>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, nth, stop, kind>> of a rule's matches, code points, end exclusive.

    Positions are a running sum of the lengths of matches and of what lies between. An aggregate copies what it has so far
    with every step, so it runs over pieces of a cube root's length, then once over the pieces, whose spans are shifted:
    n matches cost some n to the power of 4/3."""
    pattern = F.lit(rule.regex)
    gaps, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    columns = [gaps.alias("g"), found.alias("m"), *([F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("v")] if rule.group else [])]
    counted = "v" if rule.group else "m"
    lengths = F.transform(F.arrays_zip(*columns), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x[counted]).alias("v")))
    none = F.array().cast(SPAN)
    one = lambda start, stop: F.struct(start.alias("start"), F.lit(order).alias("nth"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))

    def step(state, x):
        start = state["at"] + x["g"]
        stop = start + x["m"]
        return F.struct(F.coalesce(stop, start).alias("at"), F.concat(state["out"], F.when(x["v"] >= rule.least, F.array(one(start, stop))).otherwise(none)).alias("out"))

    def shifted(state, piece):
        moved = F.transform(piece["out"], lambda s: one(s["start"] + state["at"], s["stop"] + state["at"]))
        return F.struct((state["at"] + piece["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def placed(steps):
        size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(steps).cast("double"))).cast("int"))
        begins = F.filter(F.sequence(F.lit(0), F.size(steps), size), lambda i: i < F.size(steps))
        pieces = F.transform(begins, lambda i: F.aggregate(F.slice(steps, i + 1, size), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return F.flatten(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), shifted)["out"])

    # Bound as a lambda's variable: a column used inside one would be computed anew for every piece.
    return F.transform(F.array(lengths), placed)[0]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """id and `spans`, the sorted array of all matches."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_text_key", F.xxhash64("_text"))
    told = small(materialize(candidates(rows, rules).withColumnsRenamed({"_id": "_cid", "_text_key": "_ckey"}), "candidates", few=True))
    rows = rows.join(told, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_text_key") == F.col("_ckey")), "left")
    none = F.array().cast("array<struct<start: int, nth: int, stop: int, kind: string>>")
    parts = []
    for n, rule in enumerate(rules):
        meant = F.array_contains("_kinds", rule.kind) if trigram_query(rule.regex) else F.lit(True)
        meant = F.coalesce(meant, F.lit(False)) & F.rlike("_text", F.lit(rule.regex))
        parts.append(F.when(meant, rule_spans(F.col("_text"), rule, n)).otherwise(none))
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: a count per base rule, base_sha256 and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = [r.kind for r in rules if r.base]
    found = find(docs, id_col, text_col, rules)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    only = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(id_col, *counts, F.sha2(said(only), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
