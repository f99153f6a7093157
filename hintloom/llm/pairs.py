"""Defective pairs of a question and a response."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut
from hintloom.llm.endings import MEASURED, at_limit, ending, is_shell, length_limits, measures, result_value, source_name, stripped

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

# Phrases of refusals, function words by language.
VERB = r"(?:help(?!\s+(?:but|noticing))|assist|answer|provid|giv|offer|solv|work(?:ing)?\s+(?:on|through|out|with)|comply|fulfil|continu|engag|discuss|shar|support|respond|do\s+(?:this|that|so)|complet|produc|generat|writ|process|handl)"
REFUSAL = re.compile(
    r"\b(?:i|we)(?:\s*['’]m|\s+am|\s+are)?\s+(?:(?:sorry|afraid)[\s,]+(?:but\s+)?(?:that\s+)?(?:i|we)\s+)?(?:simply\s+|really\s+|just\s+)?"
    r"(?:can\s*no?t|can['’]t|could\s+not|couldn['’]t|will\s+not|won['’]t|would\s+not|(?:am\s+)?unable\s+to|(?:am\s+)?not\s+(?:able|allowed|permitted|authorized)\s+to|prefer\s+not\s+to|would\s+rather\s+not)\s+(?:be\s+|really\s+)?" + VERB
    + r"|\b(?:i|we)\s+(?:must|have\s+to|need\s+to|will|would)?\s*(?:respectfully|politely)?\s*(?:decline|refuse|reject)\b|\bhave\s+to\s+(?:decline|refuse)\b"
    r"|\b(?:not|isn['’]t)\s+possible\s+for\s+(?:me|us)\s+to\s+" + VERB
    + r"|\b(?:not|isn['’]t|aren['’]t)\s+(?:permitted|allowed)\s+for\s+(?:me|us)\b|\b(?:beyond|outside(?:\s+of)?)\s+what\s+(?:i|we)\s+(?:may|can|am|are)\b"
    r"|\bleave\s+(?:this|that|your)\s+(?:\w+\s+)?unanswered\b|\bno\s+(?:solution|answer|help)\s+(?:will|can|may)\s+be\s+(?:given|provided|offered)\b|\bagainst\s+(?:my|our)\s+(?:guidelines|policy|policies|rules)\b"
    r"|\b(?:kann|darf|möchte|werde)\s+ich\s+(?:\w+\s+){0,4}?(?:nicht|keine?n?)\b(?:\s+\w+){0,4}?\s+(?:helfen|beantworten|lösen|angeben|geben|unterstützen|bearbeiten)\b|\bich\s+(?:kann|darf|möchte|werde)\s+(?:\w+\s+){0,5}?(?:nicht|keine?n?)\b(?:\s+\w+){0,4}?\s+(?:helfen|beantworten|lösen|angeben|geben|unterstützen|bearbeiten)\b"
    r"|\bmuss\s+ich\s+(?:\w+\s+){0,4}?(?:ablehnen|verweigern)\b|\bich\s+(?:muss|lehne)\s+(?:\w+\s+){0,5}?(?:ablehnen|ab\b|verweigern)"
    r"|\bje\s+ne\s+(?:peux|puis|suis|pourrai)\s+pas\s+(?:(?:vous|t['’])\s*)?(?:en\s+mesure|autorisé|aider|répondre|donner|fournir|résoudre|traiter)|\bje\s+(?:dois|préfère)\s+(?:décliner|refuser)|\bne\s+m['’]est\s+pas\s+(?:permis|possible)"
    r"|\bno\s+(?:puedo|podré|podemos)\s+(?:ayudar|responder|dar|ofrecer|resolver|proporcionar|contestar)|\b(?:debo|tengo\s+que|prefiero)\s+(?:rechazar|declinar)|\bno\s+me\s+(?:está|es)\s+(?:permitido|posible)|\bno\s+estoy\s+(?:autorizad|en\s+condiciones)"
    r"|(?:无法|不能|不便|不可以)(?:为您|为你|给出|给您)?(?:回答|提供|协助|帮助|解答|给出)|拒绝(?:回答|提供)",
    re.I,
)
FUNCTION_WORDS = {
    "en": "the of and a to in is that it for as with on be this by are or from at which so if we you has have was but they when only how what many does each after then",
    "de": "der die das und ist in zu den mit von für auf nicht ein eine es sich dass wir man auch noch als an bei aus nach nur wie oder wird sind hat im am um also jede",
    "fr": "le la les de des et un une est que dans pour pas on il ce qui sur avec par plus se au du en nous ne ou donc comme sont son sa mais à combien toutes chaque",
    "es": "el la los las de y un una es que en para no se por con lo su al del como más o pero si este entre son cada solo ya muy sin ha cuántos después quedan",
}
LANGUAGES = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
SPOKEN = {w: tuple(lang for lang, known in LANGUAGES.items() if w in known) for w in frozenset().union(*LANGUAGES.values())}
SCRIPTS = {"zh": "㐀-鿿", "ja": "぀-ヿ", "ko": "가-힯", "ru": "Ѐ-ӿ", "ar": "؀-ۿ", "el": "Ͱ-Ͽ", "th": "฀-๿", "hi": "ऀ-ॿ"}
SCRIPT = re.compile("|".join(f"(?P<{lang}>[{span}])" for lang, span in SCRIPTS.items()))
WORKS = re.compile(r"\d|[=+*/^\\$]")
WORD = re.compile(r"[^\W_]+")
CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
SENTENCE = re.compile(r"[^.!?。！？\n]+")


def language(text: str | None) -> str | None:
    """The language that most of a text's letters are in, sentence by sentence; null if no sentence tells one. Code blocks don't count."""
    text = text or ""
    weight: Counter[str] = Counter()
    plain = text.isascii()
    for sentence in SENTENCE.findall(CODE.sub(" ", text) if "```" in text else text):
        foreign = Counter() if plain or sentence.isascii() else Counter(m.lastgroup for m in SCRIPT.finditer(sentence))
        if foreign and max(foreign.values()) >= 3:
            weight["ja" if foreign["ja"] else max(SCRIPTS, key=foreign.__getitem__)] += 3 * foreign.total()
            continue
        words = WORD.findall(sentence.lower())
        hits = Counter(lang for w in words if w in SPOKEN for lang in SPOKEN[w])
        top = hits.most_common(2)
        if top and (len(top) == 1 or top[0][1] > top[1][1]):
            weight[top[0][0]] += sum(map(len, words))
    return weight.most_common(1)[0][0] if weight else None


asked_language = lru_cache(maxsize=4096)(language)


def is_refusal(response: str) -> bool:
    """Whether a response declines to answer, holding neither code nor a line that is a result, and works on hardly anything else.

    However long it is, what counts is that at most three sentences for each that declines work on something, with numbers or formulas.
    """
    if "```" in response or "\\boxed" in response:
        return False
    sentences = SENTENCE.findall(response)
    if all(map(WORKS.search, sentences)):
        return False
    declined = sum(REFUSAL.search(x) is not None for x in sentences)
    if not declined and not (declined := int(REFUSAL.search(response) is not None)):
        return False
    worked = sum(WORKS.search(x) is not None and REFUSAL.search(x) is None for x in sentences)
    return worked <= 3 * declined and result_value(response[response.rfind("\n") + 1 :].strip()) is None


def is_copy(question: str | None, response: str) -> bool:
    """Whether a response is only the question again: nearly all its word pairs are the question's, most of the question is there, and no result follows."""
    q, r = WORD.findall((question or "").lower()), WORD.findall(response.lower())
    if len(q) < 3 or not r:
        return False
    if q == r:
        return True
    asked, said = set(zip(q, q[1:])), set(zip(r, r[1:]))
    shared = len(asked & said)
    if not said or len(said) - shared > max(4, 0.15 * len(said)) or shared < 0.5 * len(asked):
        return False
    last = response[response.rstrip().rfind("\n") + 1 :].strip()
    return not (result_value(last) is not None and last not in (question or ""))


def pair_defect(question: str | None, think: str | None, response: str | None, answer: str | None) -> str | None:
    """The first defect, in the order of ``DEFECTS``, that a pair shows by itself; null if it shows none."""
    if is_shell(response):
        return "empty"
    if ending(response, answer) or ending(think):
        return "truncated"
    said = stripped(response)
    if is_refusal(said):
        return "refusal"
    if is_copy(question, said):
        return "copy"
    asked = asked_language(question)
    if asked and len(WORD.findall(said)) + 2 * sum("㐀" <= c <= "鿿" for c in said if c > "⿿") >= 5:
        answered = language(said)
        if answered and answered != asked:
            return "language"
    return None


def goes_on(short: str, following: str) -> bool:
    """Whether a text that continues with ``following`` stops inside a word or line there."""
    return "\n" not in (short[-1], following) and (short[-1].isalnum() and following.isalnum() or ending(short) is not None)


def neighbours(batches: Iterator[pa.RecordBatch], part: int, min_words: int) -> Iterator[tuple[list, list]]:
    """(shortened, edges) of the sorted (digest, text) of one partition, read once.

    The texts that the current one begins with are kept on a stack: all texts that begin with a text follow it at once, so each text is
    compared with every one that goes on from it, not only with the next. ``edges`` comes last: what is needed to compare across the
    borders of partitions, see ``Edge``.
    """
    open_: list[tuple[bytes, str]] = []
    first = last = None
    turns: dict[int, set[str]] = {}
    shared = 0
    for batch in batches:
        found = []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
            if first is None:
                first, shared = text, len(text)
            else:
                while not text.startswith(first[:shared]):
                    shared = len(commonprefix((text, first[:shared])))
                if len(text) > shared:
                    turns.setdefault(shared, set()).add(_kind(text[shared]))
            while open_ and not text.startswith(open_[-1][1]):
                open_.pop()
            done = {d for d, x in open_ if goes_on(x, text[len(x)])}
            if done:
                found += done
                open_ = [o for o in open_ if o[0] not in done]
            if len(text.split(None, min_words)) >= min_words:
                open_.append((digest, text))
            last = text
        yield found, []
    edges = [Edge(part, "part", None, first, last, sorted(f"{at} {kind}" for at, kinds in turns.items() for kind in kinds))]
    yield [], edges + [Edge(part, "open", digest, text, None, None) for digest, text in open_]


class Edge(NamedTuple):
    """What lies at the borders of a partition: its first and last text with the places and kinds of letters at which its texts part from the first; or a text that its last one begins with."""

    part: int
    what: str
    digest: bytes | None
    text: str | None
    last: str | None
    turns: list[str] | None


def _kind(letter: str) -> str:
    return "line" if letter == "\n" else "letter" if letter.isalnum() else "sign"


def _crosses(short: str, first: str | None, last: str | None, turns: list[str]) -> str:
    """``found`` if a text of the partition goes on from ``short``, ``on`` if only later ones can, else ``closed``."""
    if first is None:
        return "on"
    if not first.startswith(short):
        return "closed"
    kinds = {k for at, k in (t.split(" ") for t in turns) if int(at) == len(short)} | ({_kind(first[len(short)])} if len(first) > len(short) else set())
    if any(goes_on(short, {"line": "\n", "letter": "x", "sign": "."}[k]) for k in kinds):
        return "found"
    return "on" if last.startswith(short) else "closed"


def shortened(texts: DataFrame, min_words: int = 8) -> DataFrame:
    """Digests of the texts of (digest, text), both unique, that stop inside a word or line in which a longer text goes on.

    The texts are range-partitioned and sorted, and each partition is read once in order, see ``neighbours``. Texts still open at the end
    of a partition are joined with the next one by its number, as often as partitions begin with nothing but them. Texts of fewer than
    ``min_words`` words begin too many others by chance and are no evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for found, edges in neighbours(batches, part, min_words):
            rows = [Edge(part, "found", d, None, None, None) for d in found] + edges
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.string())))], list(Edge._fields))

    order = texts.select("digest", "text").repartitionByRange("text").sortWithinPartitions("text")
    seen = cut(order.mapInArrow(run, "part int, what string, digest binary, text string, last string, turns array<string>"))
    parts = seen.where("what = 'part'").select("part", F.col("text").alias("first"), "last", "turns")
    crosses = F.udf(_crosses, "string")
    found = seen.where("what = 'found'").select("digest")
    waiting = seen.where("what = 'open'").select((F.col("part") + 1).alias("part"), "digest", "text")
    while not waiting.isEmpty():
        told = cut(waiting.join(parts, "part").withColumn("told", crosses("text", "first", "last", "turns")).select("part", "digest", "text", "told"))
        found = found.union(told.where("told = 'found'").select("digest"))
        waiting = told.where("told = 'on'").select((F.col("part") + 1).alias("part"), "digest", "text")
    return found


def defective_pairs(df: DataFrame, id_col: str, question: str, think: str, response: str, answer: str, source: str) -> DataFrame:
    """(id, defect, reason) of the defective rows, one each, with the first of ``DEFECTS`` that fits.

    Sorted neighbours find the shortened versions of longer responses (reason ``prefix``), and lengths grouped by source the responses
    and the thinking that a limit has cut (``limit``), however they end. Where no longer version and no limit is there, the ending
    tells a truncated text (``ending``). The rules of refusal, copy and language follow; their reason is the defect.

    Equal responses are sorted once, so one response may fill a third of the rows; every row's texts are inspected once and only lengths
    and verdicts are kept of them. Rows with a null id can't be named and are left out; null or blank questions and thinking make no
    defect by themselves; other columns of ``df`` are ignored.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("id"), source_name(F.col(source)).alias("source"), *[F.col(c).alias(f"_{i}") for i, c in enumerate((question, think, response, answer))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(f"_{i}").to_pylist() for i in range(4)]))
            made = [pa.array([pair_defect(*r) for r in rows], pa.string()), pa.array([r[2] and md5(r[2].encode()).digest() for r in rows], pa.binary())]
            for field in (2, 1):
                sizes = [measures(r[field]) for r in rows]
                made += [pa.array([x[0] for x in sizes], pa.list_(pa.int32())), pa.array([x[1] for x in sizes], pa.int64()), pa.array([ending(r[field], r[3] if field == 2 else None) is not None for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), *made], ["id", "source", "own", "digest", "lengths", "h", "unfinished", "think_lengths", "think_h", "think_unfinished"])

    rows = cut(base.where("id is not null").mapInArrow(run, f"id bigint, source string, own string, digest binary, {MEASURED}, unfinished boolean, think_lengths array<int>, think_h bigint, think_unfinished boolean"))
    texts = df.select(F.col(response).alias("text")).where(F.col(response) != "").select(F.unhex(F.md5("text")).alias("digest"), "text")
    short = shortened(texts.groupBy("digest").agg(F.first("text").alias("text"))).distinct().withColumn("short", F.lit(True))
    named = lambda field, prefix: rows.select(F.lit(field).alias("field"), "source", *[F.col(prefix + c).alias(c) for c in ("h", "lengths", "unfinished")])
    limits = cut(length_limits(named("response", "").union(named("think", "think_"))))
    seen = rows.withColumn("field", F.lit("response")).join(short, "digest", "left")
    if not limits.isEmpty():
        seen = at_limit(seen, limits).withColumnRenamed("limit", "said")
        seen = at_limit(seen.drop("lengths").withColumnsRenamed({"think_lengths": "lengths"}).withColumn("field", F.lit("think")), limits)
        seen = seen.withColumn("limit", F.coalesce("said", "limit"))
    else:
        seen = seen.withColumn("limit", F.lit(None).cast("string"))
    reason = F.when(F.col("own") == "empty", "empty").when(F.col("short"), "prefix").when(F.col("limit").isNotNull(), "limit").when(F.col("own") == "truncated", "ending").otherwise(F.col("own"))
    defect = F.when(F.col("reason").isin("prefix", "limit", "ending"), "truncated").otherwise(F.col("reason"))
    return seen.withColumn("reason", reason).where("reason is not null").select("id", defect.alias("defect"), "reason")
