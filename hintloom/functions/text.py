"""Scalar functions on texts as column expressions: tokens, budgets, tags, answers, keys, code blocks, comparison of outputs.

All of them run inside Catalyst. Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns, tag families, answer patterns, language names.
WORD_TOKEN = r"([A-Za-z0-9_]+)"
CODE_TOKEN = r"([a-zA-Z_][a-zA-Z0-9_+\-]*|\d+(?:\^\d+)?|[+\-*/<>=!]+)"
SIMILARITY_TOKEN = r"([a-z0-9_+\-]+|\d+|\^|\*)"
END_TAGS = {
    "pipeline": r"<\s*/\s*(?:thought|think|analysis|reasoning)\s*>|<\s*(?:thought|think)\s*/\s*>|<\s*end_?(?:thought|think)s?\s*>|<\s*(?:thought|think)_?ends?\s*>|<\s*(?:thought|think)_process_end\s*>",
    "wide": r"<\s*/\s*(?:thought|think|analysis|reasoning|redacted_reasoning)\s*>|<\s*(?:thought|think)\s*/\s*>|<\s*end_?(?:thought|think)s?\s*>|<\s*(?:thought|think)_?ends?\s*>|<\s*(?:thought|think)_process_end\s*>",
    "short": r"<\s*/\s*(?:thought|think|analysis|reasoning)\s*>",
}
ANSWER_LINES = (r"(?imU)^\s*final\s+answer\s*[:：][^\S\n]*(\S.*?)\s*$", r"(?imU)^\s*answer\s*[:：][^\S\n]*(\S.*?)\s*$", r"(?iU)\bthe\s+final\s+answer\s+is\s+([^\n]+)", r"(?iU)\bthe\s+answer\s+is\s+([^\n]+)")
DROPPED_IN_ANSWERS = ("$", "\\(", "\\)", "\\[", "\\]", "\\left", "\\right", "`", "*")
LANGUAGES = {"py": "python", "python": "python", "python3": "python", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "cplusplus": "cpp"}
UNSUPPORTED = ("rust", "rs", "java", "javascript", "js", "go", "php", "ruby", "scala", "kotlin", "swift")
CODE_BLOCK = r"(?is)<code_block>(.*?)</code_block>"
FOREIGN_SIGN = r"(?i)\buse\s+std::|\bfn\s+\w+\s*\(|for\s+_\s+in\s+\d+\.\."
CPP_SIGN = r"#include|using namespace std|\bint\s+main\s*\("
PYTHON_SIGN = r"\A#!/usr/bin/env python|(?m:^\s*def\s+\w+\()"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """The text, or null if it is blank: what a falsy-or chain skips."""
    return F.when(strip(text) != "", text)


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[filled(t) for t in texts])


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(1))


def code_tokens(text: Column) -> Column:
    """Identifiers with their plus and minus tails, numbers with powers, and runs of operators."""
    return F.regexp_extract_all(F.lower(text), F.lit(CODE_TOKEN), F.lit(1))


def similarity_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(SIMILARITY_TOKEN), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct values of two arrays that both hold; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for null or empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("int")


def trim_to_budget(text: Column, tokens: int) -> Column:
    """The first four characters per token, without trailing white space; '' for a budget of none."""
    return F.lit("") if tokens <= 0 else F.regexp_replace(F.substring(text, 1, max(1, tokens * 4)), r"(?U)\s+$", "")


def reasoning_trace(think: Column, response: Column) -> Column:
    """Thinking in tags before the response; the one that is there, if only one is."""
    t, r = strip(F.coalesce(think, F.lit(""))), strip(F.coalesce(response, F.lit("")))
    return F.when((t != "") & (r != ""), F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n\n"), r)).when(t != "", t).otherwise(r)


def tagged(text: Column, tag: str) -> Column:
    """The content of the first ``<tag>…</tag>``, stripped; '' if there is none."""
    return strip(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1))


def last_boxed(text: Column) -> Column:
    r"""The content of the last ``\boxed{…}`` with balanced braces, stripped; '' if there is none or it isn't closed."""
    tail = F.substring_index(text, "\\boxed", -1)
    tail = F.substring(tail, F.locate("{", tail), F.length(tail))
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closes = (c == "}") & (depth == 0)
        opens = (c == "{") & (depth == 1)
        out = F.when(closes | opens, s["out"]).otherwise(F.concat(s["out"], c))
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), out.alias("out"), closes.alias("done")))

    walked = F.aggregate(F.split(tail, ""), zero, step, lambda s: F.when(s["done"], s["out"]).otherwise(F.lit("")))
    return strip(F.when(F.contains(text, F.lit("\\boxed")) & F.contains(tail, F.lit("{")), walked).otherwise(F.lit("")))


def last_line(text: Column) -> Column:
    """The last line that isn't blank, stripped; '' if there is none."""
    return strip(F.regexp_extract(strip(text), r"([^\n\r]*)$", 1))


def final_answer(text: Column) -> Column:
    """The last boxed value, else the last match of the first answer pattern that matches, else the last line."""
    lines = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in ANSWER_LINES]
    return F.coalesce(filled(last_boxed(text)), *[strip(x) for x in lines], last_line(text))


def normalize_answer(text: Column) -> Column:
    t = F.lower(strip(text))
    t = F.regexp_replace(t, r"\\boxed\s*\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\text\s*\{([^{}]*)\}", "$1")
    t = reduce(lambda x, token: F.replace(x, F.lit(token), F.lit("")), (*DROPPED_IN_ANSWERS, " "), t)
    return F.regexp_replace(t, r"[.;,]+$", "")


def answers_match(candidate: Column, gold: Column) -> Column:
    """Whether both are filled and equal after normalising; false if either is null."""
    c, g = normalize_answer(candidate), normalize_answer(gold)
    return F.coalesce((c != "") & (c == g), F.lit(False))


def split_thinking(text: Column, dialect: str = "pipeline") -> Column:
    """struct(think, answer, tag) at the last closing tag of the dialect; null if there is none or no answer follows."""
    tags = END_TAGS[dialect]
    parts = [strip(F.regexp_extract(text, rf"(?is)^(.*)({tags})(.*)$", i)) for i in (1, 3, 2)]
    return F.when(text.rlike(f"(?i){tags}") & (parts[1] != ""), F.struct(parts[0].alias("think"), parts[1].alias("answer"), parts[2].alias("tag")))


def slug(text: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", "run").otherwise(s)


def stated_budget(text: Column, default: int = 512) -> Column:
    """The number in double brackets, else the first number, else the default."""
    found = [F.regexp_extract(text, p, 1).try_cast("bigint") for p in (r"\[\[(\d+)\]\]", r"(\d+)")]
    return F.coalesce(*found, F.lit(default).cast("bigint"))


def status(text: Column) -> Column:
    return F.upper(strip(F.coalesce(text, F.lit(""))))


def category(a: Column, b: Column) -> Column:
    """The category of two verdicts, null unless both are there."""
    x, y = status(a), status(b)
    both = (x != "") & (y != "")
    return F.when(both, F.when((x == "AC") & (y == "AC"), "both_ac").when(x == "AC", "flash_ac_doubao_wrong").when(y == "AC", "flash_wrong_doubao_ac").otherwise("both_wrong"))


def shorten(text: Column, limit: int = 1200, marker: str = "\n...\n") -> Column:
    """Head and tail with a marker between, ``limit`` characters without it; the text itself if it is no longer."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(limit - half))))


def clip(text: Column, limit: int, marker: str = "...") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit(marker)))


def fences(text: Column) -> Column:
    """array<struct(lang, code)> of the fenced blocks in order; the language lower-cased and by its usual name, null if none is given."""
    pattern = r"(?s)```([a-zA-Z0-9_+\-]*)\n(.*?)\n```"
    names, codes = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    aliases = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])

    def block(name: Column, code: Column) -> Column:
        low = F.lower(name)
        return F.struct(F.when(low != "", F.coalesce(F.try_element_at(aliases, low), low)).alias("lang"), F.regexp_replace(code, r"^\n+|\n+$", "").alias("code"))

    return F.zip_with(names, codes, block)


def code_blocks(text: Column) -> Column:
    """array<struct(lang, code)> of what ``<code_block>`` tags hold, with the language that its signs tell; foreign code is left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1)), strip)
    own = F.filter(found, lambda c: (c != "") & ~c.rlike(FOREIGN_SIGN))
    return F.transform(own, lambda c: F.struct(F.when(c.rlike(CPP_SIGN), "cpp").when(c.rlike(PYTHON_SIGN), "python").alias("lang"), c.alias("code")))


def best_code(text: Column) -> Column:
    """struct(lang, code): the longest block in a supported language, else of no supported one, fenced blocks before tagged ones on ties.

    Without blocks it is the whole text, stripped, without the tags of code blocks.
    """
    kept = F.filter(F.concat(fences(text), code_blocks(text)), lambda b: ~F.coalesce(b["lang"].isin(*UNSUPPORTED), F.lit(False)) & (strip(b["code"]) != ""))
    known = lambda b: F.coalesce(b["lang"].isin("python", "cpp"), F.lit(False))
    ranked = F.transform(kept, lambda b, i: F.struct((F.length(b["code"]) + F.when(known(b), 10_000_000).otherwise(0)).alias("score"), (-i).alias("place"), F.when(known(b), b["lang"]).alias("lang"), b["code"].alias("code")))
    best = F.array_max(ranked)
    whole = F.regexp_replace(strip(text), CODE_BLOCK, "$1")
    return F.when(F.size(kept) > 0, F.struct(best["lang"].alias("lang"), best["code"].alias("code"))).otherwise(F.struct(F.lit(None).cast("string").alias("lang"), whole.alias("code")))


def code_block_error(verdict: Column, detail: Column) -> Column:
    """Whether a program failed to compile or run and its detail names the tags of a code block; false for nulls."""
    return F.coalesce(status(verdict).isin("CE", "RE") & F.contains(F.lower(detail), F.lit("code_block")), F.lit(False))


def verdict(text: Column) -> Column:
    """What a verifier's first line says: INCORRECT before CORRECT, UNKNOWN for neither and for null."""
    line = F.upper(F.substring_index(strip(F.coalesce(text, F.lit(""))), "\n", 1))
    return F.when(F.contains(line, F.lit("INCORRECT")), "INCORRECT").when(F.contains(line, F.lit("CORRECT")), "CORRECT").otherwise("UNKNOWN")


def output_text(text: Column) -> Column:
    """Line ends as \\n, no trailing blank lines, no white space at line ends."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+$", ""), r"[^\S\n]+(?=\n)", "")


def outputs_equal(got: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    """Equal texts, or equal numbers of tokens that are equal or both numbers within the absolute or the relative tolerance."""
    g, e = output_text(got), output_text(expected)
    gt, et = (F.filter(F.split(strip(x), r"\s+"), lambda t: t != "") for x in (g, e))

    def near(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        off = F.abs(x - y)
        numbers = a.rlike(NUMBER) & b.rlike(NUMBER)
        return (a == b) | (numbers & F.coalesce(F.when(y == 0, F.abs(x) <= tolerance).otherwise((off <= tolerance) | (off / F.greatest(F.abs(y), F.lit(1e-15)) <= tolerance)), F.lit(False)))

    return (g == e) | ((F.size(gt) == F.size(et)) & F.forall(F.zip_with(gt, et, near), lambda ok: F.coalesce(ok, F.lit(False))))


def labelled(parts: dict[str, Column], separators: dict[str, str] | None = None, between: str = "\n", default: str = "; ") -> Column:
    """``label: a; b`` for each array that isn't empty, joined; labels may have their own separators."""
    separators = separators or {}
    made = [F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, separators.get(label, default)))) for label, c in parts.items()]
    return F.concat_ws(between, *made)


def render(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacement of ``{{name}}`` in the order given; text put in is open to the later ones. A null value counts as ''."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def repair_escapes(text: Column) -> Column:
    """Doubles the backslashes that JSON doesn't allow."""
    return F.regexp_replace(text, r'(?<!\\)\\(?!["\\/bfnrtu])', r"\\\\\\\\")


def task_hash(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of the MD5 of the parts joined by bars; null counts as ``None``."""
    return F.left(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), F.lit(12))


def secret_lines(text: Column, pattern: str = r"fk\d+\.[A-Za-z0-9_\-]+") -> Column:
    """array<struct(line, text)> of the lines, counted from 1, that hold a key-like string."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.filter(lines, lambda x: x["text"].rlike(pattern))
