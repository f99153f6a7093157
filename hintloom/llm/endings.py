"""How texts end: what tells a complete text from one that was cut, and hidden limits of their lengths."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hintloom.lineage import cut

#: Fields and sources with limits up to which their table (some 200 bytes a row) is sent to every task; beyond, the values are joined with it by shuffle.
FEW_SOURCES = 20_000

# What counts as blank, as a mark put after a cut, as a shell without content, as a closing sign, as a result.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
NOTE = (
    r"(?:…|\.{2,}|\+?\d+\s+(?:more\s+)?(?:chars?|characters|bytes|tokens|words|lines)(?:\s+\w+)?"
    r"|(?:\w+\s+){0,3}(?:truncated|clipped|omitted|snip|snipped|cut|cut\s+off|cut\s+short|continued|more)(?:\s+\w+){0,2})"
)
MARK = re.compile(r"(?:…+|\.{3,}|\ufffd+|\[\s*" + NOTE + r"\s*\]|\(\s*" + NOTE + r"\s*\)|<\s*" + NOTE + r"\s*>)", re.I)
SHELL = re.compile(
    r"(?:none|null|nil|nan|n\s*/\s*a|undefined|empty|tbd|todo|[-–—_.?*~/]+|[(\[<]?\s*(?:no|empty|missing|blank)\s+(?:output|answer|response|result|content|text)\s*[)\]>]?"
    r"|\[\s*\]|\{\s*\}|\(\s*\)|\"\s*\"|'\s*'|\$\s*\$|\*\*\s*\*\*|\\boxed\s*\{\s*\}|<(\w+)>\s*</\1>|<\w+\s*/>|```\w*\s*```)",
    re.I,
)
CLOSING_SIGN = re.compile(r"(?:[∎□■◻◼▪]|\bq\.?\s?e\.?\s?d\.?|\[\s*(?:end|done|fin|eof)\s*\]|--\s?(?:end|fin|done)|\A(?:end|fin|done|eof)\.?)\Z", re.I)
RULE, STOPS, CLOSERS = "-=*_~#", ".!?。！？｡؟", "\"'”’»›)]}*_"
BRACKETED = re.compile(r"[(\[][^()\[\]]{1,40}[)\]]")
CLOSING_TAG = re.compile(r"</\w+>")
OPENING = {"]": "[", ")": "(", ">": "<"}
LABEL = r"(?:[*_#>\s]*[^\W\d_][^\W\d_ ]*(?: [^\W\d_]+){0,3}[*_]*\s?[:=：]\s?)?"
VALUE = r"(?=.*[\w√π])(?:\d|[-+±*/^().,{}\[\]\\√π%°:<>=|]|\b[A-Za-z]{1,2}\b|sqrt|frac|\bpi\b|\bmod\b| ){0,60}[\w)\]}%°π]"
RESULT_LINE = re.compile(LABEL + r"(?:\\boxed\{(.{1,80})\}|\*\*([^*\n]{1,80})\*\*|\$([^$\n]{1,80})\$|(" + VALUE + r"))\.?")


def stripped(text: str | None) -> str:
    """``text`` without blanks of any kind, zero-width ones included, at either end; '' for null."""
    text = text or ""
    while text and (text[0].isspace() or text[0] in INVISIBLE or text[-1].isspace() or text[-1] in INVISIBLE):
        text = text.strip().strip(INVISIBLE)
    return text


def is_shell(text: str | None) -> bool:
    """Whether a text is null, blank or only a placeholder or an empty wrapper."""
    bare = stripped(text)
    return not bare or SHELL.fullmatch(bare) is not None


def before_mark(text: str | None) -> str:
    """``text`` without blanks at its ends and without the mark that was put where it had been cut."""
    base = stripped(text)
    while base:
        last = base[-1]
        at = base.rfind(OPENING[last]) if last in OPENING else len(base.rstrip(last)) if last in "….\ufffd" else -1
        if at < 0 or not MARK.fullmatch(base, at):
            break
        base = stripped(base[:at])
    return base


def ends_sentence(text: str) -> bool:
    """Whether a text ends with a sentence, perhaps in quotes, brackets or emphasis, or before a bracketed note of up to forty characters."""
    bare = text.rstrip(CLOSERS)
    if bare[-1:] in STOPS:
        return bare != ""
    noted = text.rstrip(CLOSERS.replace(")", "").replace("]", ""))
    at = max(noted.rfind("("), noted.rfind("["))
    return at > 0 and BRACKETED.fullmatch(noted, at) is not None and noted[:at].rstrip()[-1:] in STOPS


def ends_closed(line: str) -> bool:
    """Whether a line ends with a sign that closes a text: a rule, a square, ``QED``, ``end`` and the like."""
    return len(line) - len(line.rstrip(RULE)) >= 3 or CLOSING_SIGN.search(line) is not None


def result_value(line: str) -> str | None:
    """The value of a line that holds a result only, perhaps after a label; null for any other line."""
    m = RESULT_LINE.fullmatch(line)
    if m is None or ("**" in line[:2] and line.count("**") % 2) or any(line.count(x) != line.count(y) for x, y in ("()", "[]", "{}")):
        return None
    return next(g for g in m.groups() if g is not None).strip()


def ending(text: str | None, answer: str | None = None) -> str | None:
    """How a text that is no shell ends: null if it is complete, else what it stops in.

    ``mark``: a mark of a cut follows; ``code``: a code block isn't closed; ``answer``: a result line holds a proper beginning of
    ``answer``; ``sentence``: neither a sentence, a block, a closing sign nor a result ends there. Shells give null.
    """
    if is_shell(text):
        return None
    bare = stripped(text)
    base = before_mark(bare)
    if base != bare:
        return "mark"
    if base.count("```") % 2:
        return "code"
    line = base[base.rfind("\n") + 1 :].strip()
    if base.endswith("```") or ends_closed(line) or base.endswith(">") and CLOSING_TAG.fullmatch(base, max(0, base.rfind("<"))):
        return None
    value = result_value(line)
    if value is not None:
        return "answer" if answer and value != answer.strip() and answer.strip().startswith(value) else None
    return None if ends_sentence(base) or is_shell(line) else "sentence"


#: How stores count a text: in characters, bytes or code units, escaped for HTML or JSON, with CR LF for new lines.
ENCODINGS = ("characters", "utf8 bytes", "utf16 units", "html", "html with quotes", "json", "json bytes", "crlf", "crlf bytes")
MEASURED = "lengths array<int>, h bigint"


def text_lengths(text: str) -> list[int]:
    """The lengths of a text in the order of ``ENCODINGS``."""
    n, wide, lines = len(text), len(text.encode("utf-8", "surrogatepass")), text.count("\n")
    html = 3 * (text.count("<") + text.count(">")) + 4 * text.count("&")
    quotes, returns = text.count('"'), text.count("\r")
    escapes = lines + returns + quotes + text.count("\\") + text.count("\t")
    bare_lines = lines - (text.count("\r\n") if returns else 0)
    units = n if wide == n else len(text.encode("utf-16-le", "surrogatepass")) // 2
    return [n, wide, units, n + html, n + html + 5 * (quotes + text.count("'")), n + escapes, wide + escapes, n + bare_lines, wide + bare_lines]


def measures(text: str | None) -> tuple[list[int] | None, int | None]:
    """(lengths, digest) of a text; nulls for a shell, which no limit has cut."""
    if is_shell(text):
        return None, None
    return text_lengths(text), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def source_name(source: Column) -> Column:
    """A source's name without letter case, outer blanks and the choice between ``_``, ``-`` and blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s-]+", "-")


def _hits(values: DataFrame, spikes: DataFrame) -> DataFrame:
    """``values`` (field, source, lengths, …) with ``hits``, the spikes (e, length, n, base) of their field and source that they lie on; null without any."""
    known = cut(spikes.groupBy(F.col("field").alias("_f"), F.col("source").alias("_s")).agg(F.collect_list(F.struct("n", (-F.col("e")).alias("first"), "e", "length", "base")).alias("known")))
    known = F.broadcast(known) if known.count() <= FEW_SOURCES else known
    joined = values.join(known, (F.col("_f") == F.col("field")) & F.col("_s").eqNullSafe(F.col("source")), "left")
    on = F.filter("known", lambda x: F.get(F.col("lengths"), x["e"]) == x["length"])
    return joined.withColumn("hits", F.when(F.size(on) > 0, on)).drop("_f", "_s", "known")


def length_limits(measured: DataFrame, least: int = 8, window: int = 32, spike: float = 8.0) -> DataFrame:
    """Hidden limits of (field, source, h, lengths, unfinished): (field, source, encoding, limit, n), n different texts exactly that long.

    Every length in every encoding is tested. It is a limit if at least ``least`` different texts have it, at least ``spike`` times as
    many as a length has on average among the ``window`` below and among those above, and if nothing is longer or most of these texts
    end unfinished. Texts cut at one limit also make spikes in other encodings: a text counts for the spike of most texts, ties to the
    first encoding, and a spike must pass with the texts that are left to it. Equal texts count once, so a text that was loaded many
    times makes no spike; shells (null lengths) are left out; a null source is a source of its own.
    """
    once = measured.where("lengths is not null").groupBy("field", "source", "h").agg(F.first("lengths").alias("lengths"), F.max("unfinished").alias("unfinished"))
    each = once.select("field", "source", "unfinished", F.posexplode("lengths").alias("e", "length")).groupBy("field", "source", "e", "length").agg(F.count("*").alias("n"), F.count_if("unfinished").alias("bad"))
    w = Window.partitionBy("field", "source", "e").orderBy("length")
    near = lambda a, b: F.coalesce(F.sum("n").over(w.rangeBetween(a, b)), F.lit(0))
    each = each.withColumns({"base": F.greatest(near(-window, -1), near(1, window)) / window, "longest": F.lead("length").over(w).isNull()})
    stands_out = (F.col("n") >= least) & (F.col("n") >= spike * F.col("base"))
    spikes = cut(each.where(stands_out & (F.col("longest") | (2 * F.col("bad") >= F.col("n")))).select("field", "source", "e", "length", "n", "base"))
    own = _hits(once, spikes).where("hits is not null").groupBy("field", "source", F.array_max("hits").alias("m")).agg(F.count("*").alias("n"))
    own = own.select("field", "source", F.col("m.e").alias("e"), F.col("m.length").alias("limit"), "n", F.col("m.base").alias("base"))
    return own.where(stands_out).select("field", "source", F.get(F.array(*[F.lit(x) for x in ENCODINGS]), F.col("e")).alias("encoding"), "limit", "n")


def at_limit(values: DataFrame, limits: DataFrame) -> DataFrame:
    """``values`` (field, source, lengths, …) with ``limit``: the encoding in which the text is exactly as long as its source allows, or null."""
    places = F.array(*[F.lit(x) for x in ENCODINGS])
    known = limits.select("field", "source", (F.array_position(places, F.col("encoding")) - 1).cast("int").alias("e"), F.col("limit").alias("length"), "n", F.lit(0.0).alias("base"))
    return _hits(values, known).withColumn("limit", F.get(places, F.array_max("hits")["e"])).drop("hits")
