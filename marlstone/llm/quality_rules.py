"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept. Lines without a word are
neither judged nor counted. Equal rows get equal verdicts. Columns other than the id and the text are never read, so
extra ones with any name do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, map_texts, table
from marlstone.llm.words import mix, windows, words_of

#: Phrases of boilerplate lines (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "copyright",
    "licensed under",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "sign up for",
    "enable javascript",
    "lorem ipsum",
)
SYMBOLS = b"#*$%&|<>"
#: A line fails at this share of symbols among its characters, or of separators to its words.
MAX_SYMBOL_SHARE = 0.08
MAX_SEPARATORS_PER_WORD = 0.2
#: A line of at least MIN_SHOUT letters fails at this share of capitals.
MIN_SHOUT, MAX_UPPER_SHARE = 12, 0.7
#: A line without closing punctuation fails when it is shorter than this many words, as menu items are.
MIN_OPEN_WORDS = 3
CLOSING = tuple(".!?:;…\"'»”’)]}")
#: A document is rejected when lines holding more than this share of its word characters fail.
MAX_LOST_SHARE = 0.5

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("lost_share", T.DoubleType())]
)

WHITE = b" \t\n\r\x0b\x0c"
#: All bytes but the capitals of ASCII, and all but its small letters.
NO_CAPITAL = bytes(i for i in range(256) if not 65 <= i <= 90)
NO_SMALL = bytes(i for i in range(256) if not 97 <= i <= 122)


def shouts(line: str) -> bool:
    """Whether capitals are more than MAX_UPPER_SHARE of at least MIN_SHOUT letters."""
    raw = line.encode()
    small = len(raw.translate(None, NO_SMALL))
    most = len(raw.translate(None, NO_CAPITAL)) + (0 if len(raw) == len(line) else sum(map("\x7f".__lt__, line)))
    if most <= MAX_UPPER_SHARE * max(MIN_SHOUT, most + small):  # even if all that is not ASCII were capitals
        return False
    letters = sum(map(str.isalpha, line))
    return letters >= MIN_SHOUT and sum(map(str.isupper, line)) > MAX_UPPER_SHARE * letters


def line_fails(line: str, symbols: bool = True, phrases: bool = True) -> str | None:
    """The rule that a line with a word breaks, or None; the flags say what its text may hold at all."""
    n = len(line)
    if symbols:
        n_bars = line.count("|")
        n_symbols = n_bars + sum(line.count(c) for c in "#*$%&<>")
        if n_bars >= 2 and n_bars > MAX_SEPARATORS_PER_WORD * len(line.split()):
            return "navigation"
        if n_symbols > MAX_SYMBOL_SHARE * n:
            return "symbols"
    if shouts(line):
        return "shouting"
    if phrases:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    if not line.rstrip().endswith(CLOSING) and len(line.split()) < MIN_OPEN_WORDS:
        return "punctuation"
    return None


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the words that lie in a five-word window found twice or more in it."""
    window, at = windows(ids, doc, 5)
    key = window ^ mix(doc[at].astype(np.uint64) + np.uint64(1))  # a run in another document is another run
    order = np.argsort(key)
    run = key[order]
    same = np.zeros(len(run), bool)
    if len(run) > 1:
        eq = run[1:] == run[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    starts = np.zeros(len(ids), bool)
    starts[at[order[same]]] = True
    covered = starts.copy()
    for j in range(1, 5):
        covered[j:] |= starts[:-j]
    return np.bincount(doc[covered], minlength=n_docs)


def rules(clean: bool = False) -> Callable[[list[bytes | None]], dict]:
    """A step that measures and judges texts, and cleans those that it keeps."""

    def step(texts: list[bytes | None]) -> dict:
        n_docs = len(texts)
        out = {f.name: [0] * n_docs for f in SCHEMA}
        _, _, _, doc, ids = words_of(texts)
        counts = np.bincount(doc, minlength=n_docs)
        repeats = repeated_words(ids, doc, n_docs)
        for d, raw in enumerate(texts):
            if not raw:
                continue
            text = raw.decode()
            # all but the white space, which is ASCII, counts as characters of words
            out["word_chars"][d] = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
            out["n_symbols"][d] = n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            low = text.lower()
            phrases = any(p in low for p in BOILERPLATE)
            seen: set[str] = set()
            lost = all_chars = dup = 0
            for line in text.split("\n"):
                size = len(line) - line.count(" ")
                if not line.strip("\x20\t\n\r\x0b\x0c"):
                    continue
                all_chars += size
                if line in seen:
                    dup += 1
                    lost += size
                    continue
                seen.add(line)
                if line_fails(line, n_symbols > 0, phrases):
                    lost += size
            out["n_dup_lines"][d] = dup
            out["lost_share"][d] = lost / all_chars if all_chars else 0.0
        failed = (counts < 10) | (100 * repeats > 20 * counts)
        share = np.array(out["lost_share"], float)
        out |= {"n_words": counts, "n_repeat_words": repeats, "lost_share": share}
        out |= {"base_failed": failed, "kept": ~failed & (share <= MAX_LOST_SHARE)}
        if clean:
            # without a lost character no line fails or repeats
            out["cleaned"] = [(cleaned(raw.decode()) if lost else raw.decode()) if kept else None for raw, kept, lost in zip(texts, out["kept"], share)]
        return out

    return step


def judge(docs: DataFrame, keep: list[str], clean: bool = False) -> DataFrame:
    """`keep`, the measures of each text, base_failed, kept and the share of text that failing lines hold; on demand also cleaned,
    the text of those kept without its failing and repeated lines."""
    schema = T.StructType([*SCHEMA, T.StructField("cleaned", T.StringType())]) if clean else SCHEMA
    return map_texts(docs, keep, lambda: rules(clean), schema)


def cleaned(text: str) -> str:
    """A text without its failing and repeated lines."""
    seen: set[str] = set()
    lines = []
    for line in text.split("\n"):
        if line.strip("\x20\t\n\r\x0b\x0c") and (line in seen or line_fails(line)):
            continue
        seen.add(line)
        lines.append(line)
    return "\n".join(lines)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])
