"""Hint cards: the texts made of them, their issues, validation and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.functions.text import filled, labelled, strip

# Card types, what leaks a verdict, triggers that say nothing, literal examples.
TYPES = ("success", "failure", "contrast", "trap", "edge_fix", "wrong_approach")
LEAK = r"(?i)\b(?:wa|tle|re|ce|wrong answer|runtime error|compile error|expected|got|stderr|judge|pass(?:ed)?\b|fail(?:ed)?\b)\b"
GENERIC = r"(?i)^(?:edge ?cases?|boundary cases?|wrong answer|hidden tests?|fails? (?:some|all) tests?|implementation bug|logic bug|buggy implementation|be careful|check constraints|watch out)$"
LITERAL = r"(?i)\b\d{3,}\b\s*(?:to|->|=>|→)\s*\b\d{3,}\b|\b(?:sample|example)\b|[\"'`][^\"'`\n]{1,24}[\"'`]"
SCALARS = ("type", "edge_pattern", "fix_hint", "wrong_approach", "correct_direction", "risk", "complexity")
LISTS = ("trigger", "tags", "do", "avoid", "check", "detours")
KEYS = ("edge_pattern", "fix_hint", "wrong_approach", "correct_direction")


def clean_list(items: Column) -> Column:
    """The items, stripped, without blank and null ones; empty for null."""
    return F.coalesce(F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False))), F.array().cast("array<string>"))


def text_list(text: Column) -> Column:
    """A text split at semicolons and line ends, each piece without blanks and dashes around it."""
    return F.coalesce(F.filter(F.transform(F.split(text, r"[;\n]+"), lambda x: F.regexp_replace(x, r"^[ \t-]+|[ \t-]+$", "")), lambda x: x != ""), F.array().cast("array<string>"))


def index_text(card: dict[str, Column]) -> Column:
    labels = {"TRIGGER": card["trigger"], "TAGS": card["tags"], "DO": card["do"], "AVOID": card["avoid"], "CHECK": card["check"]}
    return labelled(labels, {"TRIGGER": " | ", "TAGS": " "}, default=" ; ")


def inject_text(card: dict[str, Column]) -> Column:
    """The short text for prompts: two triggers, three things to do, two to avoid, two to check."""
    pieces = [("trigger", 2, " | ", "If ", ": "), ("do", 3, "; ", "Do: ", ". "), ("avoid", 2, "; ", "Avoid: ", ". "), ("check", 2, "; ", "Check: ", ".")]
    made = [F.when(F.size(card[k]) > 0, F.concat(F.lit(before), F.array_join(F.slice(card[k], 1, n), sep), F.lit(after))) for k, n, sep, before, after in pieces]
    return strip(F.concat_ws("", *made))


def retrieval_text(*parts: Column) -> Column:
    """The parts that aren't blank, stripped, a line each."""
    return F.array_join(F.filter(F.array(*[strip(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), "\n")


def card_text(card: dict[str, Column]) -> Column:
    scalars = F.filter(F.array(*[strip(F.coalesce(card[k], F.lit(""))) for k in SCALARS]), lambda x: x != "")
    return F.array_join(F.concat(scalars, *[clean_list(card[k]) for k in LISTS]), "\n")


def one_line(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def low_signal(trigger: Column) -> Column:
    t = one_line(trigger)
    return (t == "") | t.rlike(LEAK) | t.rlike(GENERIC)


def literal_example(trigger: Column) -> Column:
    t = one_line(trigger)
    assigns = t.rlike(r"\b[A-Za-z_]\w*\s*=\s*\d+\b") & t.rlike(r"(?i)\b(?:to|->|=>|→)\b")
    return (t != "") & (t.rlike(LITERAL) | (F.regexp_count(t, F.lit(r"\b\d{3,}\b")) >= 2) | assigns)


def issues(card: dict[str, Column]) -> Column:
    """The array of a card's issues, in a fixed order; missing fields are columns of null."""
    kind = F.lower(strip(F.coalesce(card["type"], F.lit(""))))
    triggers, do, check = (clean_list(card[k]) for k in ("trigger", "do", "check"))
    has = {k: filled(card[k]).isNotNull() for k in KEYS}
    whole = card_text(card)
    complete = F.when(kind == "edge_fix", has["edge_pattern"] & has["fix_hint"]).when(kind == "wrong_approach", has["wrong_approach"] & has["correct_direction"]).otherwise((F.size(do) > 0) | (F.size(check) > 0))
    longest = F.greatest(*[F.length(strip(F.coalesce(card[k], F.lit("")))) for k in KEYS])
    tests = [
        ("unexpected_type", ~kind.isin(*TYPES)), ("trigger_empty", F.size(triggers) == 0), ("trigger_low_signal", (F.size(triggers) > 0) & F.forall(triggers, low_signal)),
        ("trigger_literal_example", F.exists(triggers, literal_example)), ("trigger_too_long", F.exists(triggers, lambda t: F.length(t) > 120)), ("judge_leak", whole.rlike(LEAK)),
        ("action_gap", (F.size(do) == 0) & (F.size(check) == 0)), ("type_specific_gap", ~complete), ("long_form", (F.length(whole) > 900) | (longest > 280)),
    ]
    return F.filter(F.array(*[F.when(test, name) for name, test in tests]), lambda x: x.isNotNull())


def quality_report(df: DataFrame, issues_col: str, trigger_col: str) -> DataFrame:
    """One row: cards, those without issue, the share of them and of different first triggers, six places."""
    n = F.count("*")
    first = F.lower(F.try_element_at(F.col(trigger_col), F.lit(1)))
    return df.agg(
        n.alias("total"), F.count_if(F.size(issues_col) == 0).alias("ready"), F.round(F.try_divide(F.count_if(F.size(issues_col) == 0) * 100.0, n), 6).alias("ready_pct"),
        F.round(F.try_divide(F.count_distinct(first), n), 6).alias("unique_trigger_ratio"),
    )


def issue_histogram(df: DataFrame, issues_col: str) -> DataFrame:
    return df.select(F.explode(issues_col).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def drop_reason(card: dict[str, Column], text: Column, least: int = 20) -> Column:
    """The first rule that keeps a card out of an index, null if none does: its type, an empty trigger, too short a text."""
    kind = F.lower(strip(F.coalesce(card["type"], F.lit(""))))
    return F.when(~kind.isin(*TYPES), "type").when(F.size(clean_list(card["trigger"])) == 0, "trigger_empty").when(F.length(F.coalesce(text, F.lit(""))) < least, "text_too_short")


def failure_drop_reason(card: dict[str, Column], text: Column, least: int = 5, longest: int = 250) -> Column:
    """The rule that keeps a failure card out of an index, null if none does or it is of another type: fields too short, text for prompts too long."""
    size = lambda k: F.length(F.coalesce(card[k], F.lit("")))
    thin = ((card["type"] == "edge_fix") & ((size("edge_pattern") < least) | (size("fix_hint") < least))) | ((card["type"] == "wrong_approach") & (size("wrong_approach") < least))
    return F.when(thin, "field_too_short").when(card["type"].isin(*TYPED) & (F.length(F.coalesce(text, F.lit(""))) > longest), "text_too_long")


# Per type of a failure card, the label of its triggers in prompts, and per field its label in indexes and its form in prompts.
TYPED = {
    "edge_fix": ("EDGE CASE", (("edge_pattern", "EDGE", "{}."), ("fix_hint", "FIX", "Fix: {}."))),
    "wrong_approach": ("AVOID", (("wrong_approach", "WRONG", "{} fails."), ("correct_direction", "CORRECT", "Try: {}."))),
}


def _formed(form: str, value: Column) -> Column:
    before, after = form.split("{}")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after)))


def typed_index_text(card: dict[str, Column]) -> Column:
    """``index_text`` with the two fields of a failure card's type after its tags."""
    head = labelled({"TRIGGER": card["trigger"], "TAGS": card["tags"]}, {"TRIGGER": " | ", "TAGS": " "})
    own = [F.when(card["type"] == kind, _formed(f"{label}: {{}}", card[field])) for kind, (_, fields) in TYPED.items() for field, label, _ in fields]
    tail = labelled({"DO": card["do"], "AVOID": card["avoid"], "CHECK": card["check"]}, default=" ; ")
    return F.concat_ws("\n", F.nullif(head, F.lit("")), *own, F.nullif(tail, F.lit("")))


def typed_inject_text(card: dict[str, Column]) -> Column:
    """The short text for prompts in the form of the card's type; other types name what to do, avoid and check."""
    kind = F.lower(card["type"])
    triggers = F.array_join(F.slice(card["trigger"], 1, 2), " | ")
    out = None
    for name, (label, fields) in TYPED.items():
        text = F.concat_ws(" ", _formed(f"{label} if {{}}:", triggers), *[_formed(form, card[field]) for field, _, form in fields])
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    plain = [_formed(form, F.array_join(F.slice(card[field], 1, n), "; ")) for field, n, form in (("do", 3, "Do: {}."), ("avoid", 2, "Avoid: {}."), ("check", 2, "Check: {}."))]
    return strip(out.otherwise(F.concat_ws(" ", _formed("If {}:", triggers), *plain)))


def experience_block(texts: Column, meta: Column | None = None) -> Column:
    """The filled texts as a list, a line each, after a line of general advice if one is given."""
    lines = F.transform(clean_list(texts), lambda t: F.concat(F.lit("- "), t))
    return F.array_join(lines if meta is None else F.concat(F.array(F.concat(F.lit("- "), meta)), lines), "\n")
