"""Text quality statistics and text types by noisy labelling functions whose accuracies are learned from their agreement."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut

#: Kinds as the model knows them; the last three are reported as junk: encoded data and symbols, menus and repetition, unconnected words.
KINDS = ("prose", "list", "table", "noise", "menu", "salad")
JUNK = ("noise", "menu", "salad")

LINE = re.compile(r"\r\n|\r|\n")
WORD = re.compile(r"[^\W_]+")
STOPS, CLOSERS = ".!?…。！？:;", "\"'”’»›)]}*_"
STOP = re.compile(r"[.!?。！？]+")
PARAGRAPH = re.compile(r"\n\s*\n|\r\s*\r|\r\n\s*\r\n")
TOKEN = re.compile(r"[^\s,;|]{24,}")
QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
BULLET = re.compile(r"(?:[-*+•·‣▪◦–—]|\[[ xX✓-]?\]|\(?\d{1,3}[.)\]:]|\(?[a-zA-Z][.)])\s+")
PAIR = re.compile(r"[^:]{1,32}:\s")
SEPARATORS = (("|", re.compile(r"\s*\|\s*")), ("\t", re.compile(r"\t")), ("  ", re.compile(r" {2,}")), (";", re.compile(r"\s*;\s*")), (",", re.compile(r",\s*")))
RULE_LINE = re.compile(r"[\s|+:=_-]+")
VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûœæ\u2e80-\uffff]")

#: Different words whose traits a task keeps at once; then it begins anew.
WORDS_KEPT = 200_000

STATISTICS = (
    "n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "n_lines", "median_line_words", "punctuated_lines", "short_lines", "entry_lines",
    "cell_lines", "common_words", "richness", "top_word", "vowel_words", "mixed_words", "long_tokens", "sentence_lines", "sentence_words",
)


class Traits(dict):
    """What a word is, as bits: 1 letters only, 2 letters and digits mixed, 4 letters with a vowel, 8 common."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        alpha = word.isalpha()
        bits = self[word] = alpha | (not alpha and not word.isdigit()) << 1 | (alpha and VOWEL.search(word) is not None) << 2 | (word in self.common) << 3
        return bits


class Letters(dict):
    """The kind of a character: 0 blank, 1 letter, 2 capital, 3 digit, 4 other number, 5 symbol, 6 a sign that draws tables."""

    def __missing__(self, c: str) -> int:
        kind = self[c] = 0 if c.isspace() else (2 if c.isupper() else 1) if c.isalpha() else 3 if c.isdigit() else 4 if c.isalnum() else 6 if c in "|+-" else 5
        return kind


LETTERS = Letters()


def spoken(line: str) -> int:
    """The blank-separated pieces of a line that don't begin with a sign that draws tables."""
    pieces = line.split()
    return len(pieces) - (sum(x[0] in "|+-" for x in pieces) if "|" in line or "-" in line or "+" in line else 0)


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Where the runs that stop signs end begin and end, signs included; what follows the last sign is none."""
    last = 0
    for m in STOP.finditer(text):
        if m.start() > last:
            yield last, m.end()
        last = m.end()


def cell_lines(lines: list[str], n_words: int) -> float:
    """Share of the lines that are rows of several cells: of the best separator, the rows that have the usual number of cells, two at least."""
    best = 0.0
    for name, pattern in SEPARATORS:
        marks = sum(x.count(name) for x in lines)
        soft = name in ";,"
        if marks < 2 or soft and n_words > 3 * (marks + len(lines)):
            continue
        counts = [len(pattern.split(x.strip(" |"))) for x in lines]
        several = [c for c in counts if c >= (3 if soft else 2)]
        if len(several) >= 2:
            usual = max(set(several), key=several.count)
            best = max(best, sum(abs(c - usual) <= (name == "  ") for c in several) / len(lines))
    return best


def readable(span: str, common: frozenset[str]) -> int:
    """The words of a readable sentence, 0 for any other span: four words, one in eight of them common, in lines that hold running text.

    Lines are running text if most of them are full, so that the first word of the next one wouldn't have fitted the width, or if the
    sentence is as short as sentences are. A heading or the end of a list before a sentence is left out if a blank line or a bullet
    shows it.
    """
    lines = [x for x in map(str.strip, LINE.split(PARAGRAPH.split(span.strip())[-1])) if x]
    if any(BULLET.match(x) for x in lines[1:]):
        lines = lines[-1:] if len(lines) == 2 else []
    if len(lines) > 8 or len(lines) > 2 and sum(x.count(" ") + 1 for x in lines) > 24:
        width = max(map(len, lines))
        if sum(len(x) + 1 + len(y.split(None, 1)[0]) >= width for x, y in zip(lines, lines[1:])) < 0.7 * (len(lines) - 1):
            return 0
    words = WORD.findall(" ".join(lines).lower())
    if len(words) < 4 or 8 * sum(map(common.__contains__, words)) < len(words):
        return 0
    return len(words)


def statistics(text: str | None, traits: Traits) -> dict[str, float]:
    """The statistics of one document, over its whole text; all zero for a null or blank one.

    Marks of quotation before lines don't count, nor do lines of rules only. ``richness`` is the number of different words by the root
    of the number of words, 9 for fewer than twelve words. Shares of lines are over lines that aren't blank.
    """
    text = QUOTE.sub("", text or "") if ">" in (text or "") else text or ""
    out = dict.fromkeys(STATISTICS, 0.0)
    out["n_chars"], out["richness"] = float(len(text)), 9.0
    kinds = [0] * 7
    upper = 0
    for c, k in Counter(text).items():
        kinds[LETTERS[c]] += k
        if c.isupper():
            upper += k
    solid = len(text) - kinds[0]
    if not solid:
        return out
    lines = [x for x in map(str.strip, LINE.split(text)) if x and not RULE_LINE.fullmatch(x)]
    rows = max(len(lines), 1)
    words = WORD.findall(text.lower())
    n = len(words)
    in_line = [spoken(x) for x in lines] or [0]
    out |= {
        "n_words": float(n), "symbol_ratio": kinds[5] / solid, "digit_ratio": kinds[3] / solid, "upper_ratio": upper / max(kinds[1] + kinds[2], 1), "n_lines": float(len(lines)),
        "median_line_words": float(median(in_line)), "punctuated_lines": sum(x.rstrip(CLOSERS)[-1:] in STOPS and x.rstrip(CLOSERS) != "" for x in lines) / rows,
        "short_lines": sum(k <= 8 and x[-1] not in ".!?。" for x, k in zip(lines, in_line)) / rows, "entry_lines": sum(k <= 10 and bool(BULLET.match(x) or PAIR.match(x)) for x, k in zip(lines, in_line)) / rows,
        "cell_lines": cell_lines(lines, n), "long_tokens": sum(map(len, TOKEN.findall(text))) / solid,
    }
    if n:
        counts = Counter(words)
        of_kind = Counter(map(traits.__getitem__, words))
        having = lambda bit: sum(k for bits, k in of_kind.items() if bits & bit)
        covered, good, row, at = set(), 0, 0, 0
        for start, end in sentences(text):
            span = text[start:end]
            start += len(span) - len(span.lstrip())
            row += text.count("\n", at, start)
            at = start
            if k := readable(span, traits.common):
                good += k
                covered.update(range(row, row + text.count("\n", start, end) + 1))
        filled = [i for i, x in enumerate(text.split("\n")) if x.strip()]
        out |= {
            "mean_word_length": sum(map(len, words)) / n, "common_words": having(8) / n, "richness": len(counts) / n**0.5 if n >= 12 else 9.0, "top_word": max(counts.values()) / n,
            "mixed_words": having(2) / n, "vowel_words": having(4) / max(having(1), 1), "sentence_words": good / n, "sentence_lines": sum(i in covered for i in filled) / max(len(filled), 1),
        }
    return out


# The labelling functions: a statistic, the threshold it must reach, the kinds voted for if it does, and if it doesn't; none: it abstains.
FUNCTIONS = (
    ("sentence_lines", 0.5, "prose", "list table noise menu salad"),
    ("sentence_words", 0.3, "prose", "table noise menu salad"),
    ("sentence_words", 0.78, "prose", "list table noise menu salad"),
    ("common_words", 0.2, "prose", "list table noise menu salad"),
    ("common_words", 0.04, "prose list", "table noise menu salad"),
    ("median_line_words", 5.5, "prose salad", "list table noise menu"),
    ("punctuated_lines", 0.7, "prose", "list table menu salad"),
    ("short_lines", 0.6, "list table menu noise", "prose salad"),
    ("entry_lines", 0.55, "list", "prose table noise menu salad"),
    ("cell_lines", 0.6, "table", "prose list noise menu salad"),
    ("cell_lines", 0.85, "table", "prose list noise menu salad"),
    ("mixed_words", 0.25, "noise", "prose list table menu salad"),
    ("digit_ratio", 0.15, "table noise", "prose list menu salad"),
    ("symbol_ratio", 0.3, "noise", "prose list menu salad"),
    ("vowel_words", 0.7, "prose list table menu", "noise"),
    ("long_tokens", 0.3, "noise", "prose list table menu salad"),
    ("top_word", 0.3, "menu", "prose list table noise salad"),
    ("richness", 2.8, "prose list table salad", "menu"),
    ("n_words", 1, "prose list table menu salad", "noise"),
    ("mean_word_length", 8, "noise", "prose list table salad"),
)


def votes(values: dict[str, float]) -> int:
    """Which tests a document passes, as bits."""
    return sum(1 << i for i, (name, least, _, _) in enumerate(FUNCTIONS) if values[name] >= least)


def _masks() -> np.ndarray:
    """(function, failed or passed, kind): the kinds each outcome votes for; all zero where it abstains."""
    return np.array([[[k in said.split() for k in KINDS] for said in (no, yes)] for _, _, yes, no in FUNCTIONS], float)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 40, hold: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior by pattern and kind, accuracy by function and kind) by expectation-maximization on the functions' agreements.

    A function is taken for a noisy observer: per kind it has a rate of passing, which starts at 0.9 for the kinds it votes for, 0.1 for
    those it votes against and 0.5 where it abstains, and is learned from the posteriors that all functions give together. ``hold`` is
    the weight of the start in documents, so that a kind keeps its meaning when few documents are of it and is learned when many are. The
    accuracy is the rate of the outcome that votes for the kind.
    """
    masks = _masks()
    against = masks[:, 0] - masks[:, 1]
    start = 0.5 - 0.4 * against
    passed = ((patterns[:, None] >> np.arange(len(FUNCTIONS))) & 1).astype(float)
    rate, prior = start, np.full(len(KINDS), 1 / len(KINDS))
    for _ in range(rounds):
        log = passed @ np.log(rate) + (1 - passed) @ np.log1p(-rate) + np.log(prior)
        posterior = np.exp(log - log.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        weighted = posterior * counts[:, None]
        mass = weighted.sum(0)
        prior = (mass + 0.01 * mass.sum() + 1e-9) / (mass + 0.01 * mass.sum() + 1e-9).sum()
        rate = np.clip((passed.T @ weighted + start * hold) / (mass + hold), 0.003, 0.997)
    return posterior, np.where(against > 0, 1 - rate, rate)


def kind_of(posterior: np.ndarray) -> tuple[str, float]:
    """The reported kind of greatest posterior, and that posterior rounded to six places."""
    sums: dict[str, float] = {}
    for kind, p in zip(KINDS, posterior):
        name = "junk" if kind in JUNK else kind
        sums[name] = sums.get(name, 0.0) + float(p)
    best = max(sums, key=sums.get)
    return best, round(sums[best], 6)


def document_statistics(df: DataFrame, id_col: str, text_col: str, common: frozenset[str]) -> DataFrame:
    """(id, statistics…, votes): one row per document, over whole texts, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traits = Traits(common)
        for batch in batches:
            rows = [statistics(t, traits) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in STATISTICS]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, pa.array([votes(r) for r in rows], pa.int64())], ["id", *STATISTICS, "votes"])

    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, {', '.join(f'{k} double' for k in STATISTICS)}, votes bigint")


def text_kinds(df: DataFrame, id_col: str, text_col: str, common: frozenset[str]) -> DataFrame:
    """``document_statistics`` with ``kind`` (prose, list, table, junk) and ``certainty``, the posterior of that kind rounded to six places.

    The vote patterns are counted over all documents; there are at most 2 ** len(FUNCTIONS) of them, whatever the corpus, so the model is
    fitted on the driver and its posteriors are sent back as a bounded table. Null and blank texts are junk. Repeated documents and ids
    each have their row; an empty table gives an empty result; other columns are ignored.
    """
    stats = cut(document_statistics(df, id_col, text_col, common))
    counted = stats.groupBy("votes").count().collect()
    patterns, counts = np.array([r["votes"] for r in counted], np.int64), np.array([r["count"] for r in counted], float)
    posterior = fit(patterns, counts)[0] if len(counted) else np.zeros((0, len(KINDS)))
    table = [(int(p), *kind_of(q)) for p, q in zip(patterns, posterior)]
    kinds = df.sparkSession.createDataFrame(table, "votes bigint, kind string, certainty double")
    return stats.join(F.broadcast(kinds), "votes")
