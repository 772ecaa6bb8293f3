"""Quality rules, line first.

Each line is judged on its own: lines without letters or closing punctuation
where they have symbols or separators, navigation lines, boilerplate, shouting
and stuttering go.  Short lines without closing punctuation go where several follow each other:
those are menus, while a heading stands alone.  What is left is compared with what came: a document that lost too much of
its text is rejected, as one that fails the base rules is (too few words, too
many words inside repeated five-word windows).  Notices of rights go too, but are
no text that a document loses.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from astrolane.llm.common import table

WINDOW = 5
_SYMBOLS = b"#*$%&|<>"

#: Phrases whose lines are notices of rights, in lower case. Such lines go, but are no loss of text.
NOTICES = (
    "all rights reserved",
    "released under the",
    "licensed under",
    "this work is licensed",
    "copyright ©",
)
#: Phrases whose lines are boilerplate, in lower case.
BOILERPLATE = (
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "sign up for our newsletter",
    "click here to",
    "powered by",
)
_NOTICES = re.compile("|".join(map(re.escape, NOTICES)))
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SEPARATORS = re.compile(r"[|»›•·]|(?:^| )[>/](?= |$)")
_CLOSES = tuple(".!?…:;,\"'”’»)]")


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; the base rules are fixed by the two first."""

    min_words: int = 10
    max_repeat_pct: int = 20
    #: a line of so many separators to a word or more is navigation
    separator_ratio: float = 0.2
    #: a line of so many symbols to a word or more, or of so many shouted words, fails
    symbol_ratio: float = 0.3
    shout_ratio: float = 0.8
    #: a line of so many words or more of which such a share says the word before again fails
    stutter_words: int = 6
    stutter_ratio: float = 0.4
    #: a line of so many words or more fails if it has no lower-case letter
    shout_words: int = 4
    #: lines of so many words or fewer that close with no punctuation fail where so many or more follow each other
    menu_words: int = 3
    menu_lines: int = 5
    #: a document must keep more than this share of its words, notices of rights apart
    min_kept: float = 0.5


def count_repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Exact: windows are ranked, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    base = len(seen)
    code, top = ids, base
    for span in range(1, window):  # the code of `span` words and the next word
        if top * base > 2**62:
            values, code = np.unique(code, return_inverse=True)
            top = len(values)
        code = code[: len(words) - span] * base + ids[span:]
        top *= base
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: str, n_words: int, rules: Rules) -> bool:
    """Whether one line, of a word or more, is to go."""
    raw = line.encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    if symbols > rules.symbol_ratio * n_words:
        return True
    low = line.lower()
    if _BOILERPLATE.search(low) or _NOTICES.search(low):
        return True
    if len(_SEPARATORS.findall(line)) >= max(2, rules.separator_ratio * n_words):
        return True
    if low == line.upper():  # no letters at all
        return not any(c.isalpha() for c in line) and not line.rstrip().endswith(_CLOSES)
    if n_words >= rules.shout_words and line == line.upper():
        return sum(w.isupper() for w in line.split()) >= rules.shout_ratio * n_words
    return False


def is_item(line: str, n_words: int, rules: Rules) -> bool:
    """Whether a line may be one of a menu. Not where letters have no case: there a word can be a whole sentence."""
    return n_words <= rules.menu_words and line.lower() != line.upper() and unicodedata.category(line.rstrip()[-1])[0] != "P"


def judge(text: str | None, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words kept, clean text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup, left, notices, good = set(), 0, 0, 0, []
    items = []  # of the menu lines that follow each other: the place in good, or None if not there, and the words

    def end_menu() -> int:
        """Takes the lines out if they are a menu; the words that go."""
        gone = [x for x in items if x[0] is not None] if len(items) >= rules.menu_lines else []
        for at, _ in gone:
            good[at] = None
        items.clear()
        return sum(k for _, k in gone)

    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        count = len(own)
        if not count:
            good.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        stutters = count >= rules.stutter_words and sum(map(operator.eq, own, own[1:])) >= rules.stutter_ratio * count
        fails, item = stutters or line_fails(line, count, rules), is_item(line, count, rules)
        if fails and _NOTICES.search(line.lower()):
            notices += count
        if not item:
            left -= end_menu()
        else:
            items.append((None if fails else len(good), count))
        if not fails:
            left += count
            good.append(line)
    left -= end_menu()
    repeat = count_repeated(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
    kept = not failed and left > rules.min_kept * (n - notices)
    return n, chars, symbols, dup, repeat, failed, kept, left, "\n".join(x for x in good if x is not None)


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Row, the five counts, base_failed, kept, words_left (and clean_text with with_text).

    The row that came is in the struct column ``row``, so its columns may have any
    name.  Null text has no words and fails; an empty table gives no rows; rows
    that repeat are judged alike; a text of any length is judged whole.
    """
    frame = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_text"))
    fields = [frame.schema["row"], *(T.StructField(c, T.LongType()) for c in _NUMBERS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("words_left", T.LongType())]
    fields += [T.StructField("clean_text", T.StringType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
        for b in (whole.slice(low, 1000) for whole in batches for low in range(0, whole.num_rows, 1000)):
            cols = list(zip(*(judge(t, rules) for t in b.column("_text").to_pylist()), strict=True))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 8 + with_text]
            yield pa.RecordBatch.from_arrays([b.column("row"), *made], names=[f.name for f in fields])

    return frame.mapInArrow(run, T.StructType(fields))


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with failing lines taken out of their texts; columns as they came."""
    judged = quality(docs, rules, with_text=True).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return judged.select(*(new[c].alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.select("doc_id", "text")
    out = quality(narrow)
    return out.select(F.col("row.doc_id").alias("doc_id"), *_NUMBERS, "base_failed", "kept", "words_left")
