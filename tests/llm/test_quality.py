import numpy as np
import pytest

from hintloom.llm import quality

COMMON = frozenset("the of and a to in is that it for as with on be this by are or from at an not which so if can we only all one when".split())
PROSE = "The trick in this task is to see that the trie of the red rods never changes. If you sort the rods, each barn is visited at most 6 times. We can prove it by looking at the first barn where the trie drops."
ITEMS = ["union find", "bit trick", "edge of the red jars", "seals the coins", "queue vs heap", "flat stride", "line sweep", "pivot of the first gears", "parity check", "wide hash"]
ROWS = ["key,ms,lang,status", *[f"game_{i},{37 * i % 400},cpp,{'AC' if i % 3 else 'WA'}" for i in range(14)]]
DOCS = {
    "prose": [PROSE, PROSE.replace(" when", "\nwhen"), "# Notes\n\n" + PROSE + "\n\n- edge of the jars\n- heap", PROSE + "\n```python\nprint(1)\n```\n" + PROSE, "\n".join(PROSE[i : i + 60].strip() for i in range(0, len(PROSE), 60))],
    "list": ["\n".join(f"- {x}" for x in ITEMS), "\n".join(f"{i + 1}. {x}" for i, x in enumerate(ITEMS)), "\n".join(ITEMS), PROSE.split(". ")[0] + ".\n" + "\n".join(f"* {x}" for x in ITEMS), "\n".join(f"heap: {x}" for x in ITEMS)],
    "table": ["\n".join(ROWS), "\n".join(r.replace(",", "\t") for r in ROWS), "\n".join("| " + r.replace(",", " | ") + " |" for r in ROWS), "\n".join("".join(c.ljust(14) for c in r.split(",")) for r in ROWS)],
    "junk": [None, "", " \n ", "?", "~^= @=<%-/=__ !%/#@*>=%^!=>*__+/=>*!~@^+@ %@<", "jars " * 60, "\n".join(["jars"] * 40), "Home Menu Login\nLogin · Menu · Home · Next »\nMenu > Home > Login > Menu\n" * 5, "wFbp8fNfjY8SAgYBK7gmx0R6fYSlcd0SX4Av7LHddYts8n6KDh6cbAuZVrel\n" * 4, "gathers bright collects bulbs overflow invariant springs gloves wheels boxes ratio right sells bucket tall cables hollow ribbons cuts round " * 3, "0xf04830a8 0494718e .. e4\n0x99e366c0 18d5d2c6 .. af\n0x1569a429 c62c14b7 .. c7\n" * 3],
}


def test_kinds(spark):
    rows = [(f"{kind}{i}{k}", t, "x", 1) for kind, texts in DOCS.items() for i, t in enumerate(texts) for k in range(30 if kind == "prose" else 3)]
    df = spark.createDataFrame(rows, "doc string, body string, kind string, votes int")
    got = quality.text_kinds(df, "doc", "body", COMMON).collect()
    assert len(got) == len(rows)
    wrong = [(r.id, r.kind) for r in got if not r.id.startswith(r.kind)]
    assert not wrong
    assert all(0.25 <= r.certainty <= 1 for r in got)
    assert quality.text_kinds(df.limit(0), "doc", "body", COMMON).collect() == []


def test_statistics():
    s = quality.statistics("The cat is on the mat.\nIt is 12 m!", quality.Traits(COMMON))
    assert (s["n_words"], s["n_lines"], s["punctuated_lines"]) == (10, 2, 1.0)
    assert s["common_words"] == pytest.approx(6 / 10)
    assert s["mean_word_length"] == pytest.approx(sum(map(len, "the cat is on the mat it is 12 m".split())) / 10)
    assert set(quality.statistics(None, quality.Traits(COMMON))) == set(quality.STATISTICS)


def test_long_text_is_read_whole():
    s = quality.statistics(PROSE * 3000 + "zzz", quality.Traits(COMMON))
    assert s["n_chars"] == len(PROSE) * 3000 + 3


def test_fit_recovers_accuracies():
    rnd = np.random.default_rng(1)
    masks = quality._masks()
    rates = np.clip(0.5 - 0.42 * (masks[:, 0] - masks[:, 1]), 0.05, 0.95)
    kind = rnd.choice(len(quality.KINDS), 20000, p=[0.8, 0.06, 0.05, 0.03, 0.03, 0.03])
    bits = rnd.random((20000, len(rates))) < rates[:, kind].T
    patterns, counts = np.unique(bits @ (1 << np.arange(len(rates))), return_counts=True)
    posterior, accuracy = quality.fit(patterns, counts.astype(float))
    best = dict(zip(patterns.tolist(), posterior.argmax(1)))
    said = np.array([best[int(p)] for p in bits @ (1 << np.arange(len(rates)))])
    assert (said == kind).mean() > 0.97
    assert accuracy.shape == rates.shape


def test_rates_are_learned_from_many_documents():
    prose = quality.KINDS.index("prose")
    usual = sum(1 << i for i, (_, _, yes, _) in enumerate(quality.FUNCTIONS) if "prose" in yes.split())
    accuracy = quality.fit(np.array([usual, usual & ~1]), np.array([50_000.0, 50_000.0]))[1]
    assert accuracy[0, prose] == pytest.approx(0.5, abs=0.01)


def test_learned_rates_beat_the_start():
    """Functions that are far from the accuracy they are given at first mislead the start's posterior; the learned one puts them right."""
    rnd = np.random.default_rng(7)
    masks = quality._masks()
    rates = np.clip(0.5 - 0.4 * (masks[:, 0] - masks[:, 1]), 0.05, 0.95)
    prose, listed = quality.KINDS.index("prose"), quality.KINDS.index("list")
    for i in (0, 3, 5, 6, 7):
        rates[i, prose], rates[i, listed] = 0.35, 0.6
    kind = rnd.choice(len(quality.KINDS), 40000, p=[0.6, 0.3, 0.04, 0.02, 0.02, 0.02])
    bits = (rnd.random((40000, len(rates))) < rates[:, kind].T) @ (1 << np.arange(len(rates)))
    patterns, at, counts = np.unique(bits, return_inverse=True, return_counts=True)
    right = lambda rounds: (quality.fit(patterns, counts.astype(float), rounds=rounds)[0].argmax(1)[at] == kind).mean()
    assert right(40) > right(1) + 0.05 and right(40) > 0.9


def test_long_text_without_stops_takes_no_square_time():
    s = quality.statistics("jars and rods " * 40_000, quality.Traits(COMMON))
    assert s["n_words"] == 120_000 and s["sentence_words"] == 0


def test_traits_begin_anew(monkeypatch):
    monkeypatch.setattr(quality, "WORDS_KEPT", 3)
    traits = quality.Traits(COMMON)
    assert [traits[w] for w in ("the", "x1", "12", "brr", "one", "the")] == [13, 2, 0, 1, 13, 13] and len(traits) <= 3
