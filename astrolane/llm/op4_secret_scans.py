"""Secret scans with a randomness test battery, in SQL functions only.

Base patterns find what looks like a secret by its form.  The battery finds what
looks like one by its content: each long token gets an encoding (hex, base 32,
base 36 or base 64) and three tests of randomness in that encoding's alphabet,
chi-squared uniformity of its characters, runs above and below the middle of the
alphabet, and lag-one serial correlation.  Fisher's method joins their p-values.

That p is uniform for random tokens and says little about short words, so it only
rejects (below ALPHA a token is not random).  What passes is ordered by a
likelihood ratio: the log probability under the encoding's uniform law less that
under a model of the corpus's words (turns between kinds of characters, pairs of
letters), for each character.  A mean over characters spreads less the longer the
token is, so shorter words are a null for longer tokens on the safe side.

The limit is set for each length class by false-discovery control over the whole
corpus: tokens of letters alone are the null (words), and a token that mixes
letters and digits counts as a discovery where it is likelier random than a word
and the Benjamini-Hochberg rule holds for its empirical p-value among the words
of its length class and all shorter ones.  What this takes is a table of letter
pairs and one of (class, bin) cells, bounded whatever the corpus holds.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # the same as [0-9a-f]+ of 16 characters or more
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Lower ends of the length classes of tokens, and bins of the score: a tenth each, EVEN is where random and word are as likely.
CLASSES = (16, 20, 24, 32, 48, 96)
BINS = 50
EVEN = BINS // 2
#: The share of random tokens that the battery may reject.
ALPHA = 0.001
#: Symbols of the word model: all digits are 0, all marks +. Of each character's kind (lower, upper, digit, mark), the chance of the next one's; fixed, as words of letters alone say nothing of digits.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0+"
TURNS = ((0.85, 0.05, 0.05, 0.05), (0.35, 0.55, 0.05, 0.05), (0.15, 0.10, 0.60, 0.15), (0.40, 0.20, 0.30, 0.10))


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,token:string>>)"


def _kind(name: str) -> str:
    return str(KINDS.index(name))


def spans_of(text: str, pattern: str, kind: str, group_at_least: int = 0) -> str:
    """SQL: array of (start, kind, end, token) of the pattern's matches, in code points.

    What lies between matches and the matches themselves, by their lengths, give
    the positions; group_at_least drops matches whose group 2 is shorter.
    """
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    zipped = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (b, m) -> named_struct('b', b, 'm', m))"
    good = "x.m is not null"
    if group_at_least:
        zipped = f"zip_with({zipped}, regexp_extract_all({text}, {p}, 2), (x, g) -> named_struct('b', x.b, 'm', x.m, 'g', g))"
        good += f" and length(x.g) >= {group_at_least}"
    folded = f"""aggregate({zipped},
        named_struct('at', 0, 'out', {NO_SPANS}),
        (a, x) -> named_struct(
            'at', a.at + length(x.b) + coalesce(length(x.m), 0),
            'out', case when {good} then array_append(a.out, named_struct('start', a.at + length(x.b), 'kind', {_kind(kind)}, 'end', a.at + length(x.b) + length(x.m), 'token', x.m)) else a.out end),
        a -> a.out)"""
    quick = {"assign": f"(instr({text}, '=') > 0 or instr({text}, ':') > 0) and ", "access": f"instr({text}, 'AKIA') > 0 and "}.get(kind, "")
    return f"case when {quick}{text} rlike {p} then {folded} else {NO_SPANS} end"


def _upper_tail(z: str) -> str:
    """SQL: about the normal probability above z (logistic form with a cubic term)."""
    return f"1 / (1 + exp(least(700D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3))))"


def randomness(token: str = "token") -> list[tuple[str, str]]:
    """SQL columns, each from those before: the battery for one token. The last is p, small for what is not random."""
    std = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return [
        ("enc", f"case when {token} rlike '^[0-9a-f]+$' or {token} rlike '^[0-9A-F]+$' then 16 when {token} rlike '^[A-Z2-7]+$' then 32 when {token} rlike '^[a-z0-9]+$' or {token} rlike '^[A-Z0-9]+$' then 36 else 64 end"),
        ("body", f"case when enc in (16, 36) then lower({token}) else translate({token}, '-_', '+/') end"),
        ("alphabet", f"case enc when 16 then '0123456789abcdef' when 32 then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' when 36 then '0123456789abcdefghijklmnopqrstuvwxyz' else '{std}' end"),
        ("n", "cast(length(body) as double)"),
        ("codes", "transform(split(body, ''), c -> cast(instr(alphabet, c) - 1 as double))"),
        # chi-squared against equal shares, made normal by the cube root
        ("squares", "aggregate(array_distinct(codes), 0D, (a, c) -> a + pow(cast(size(filter(codes, x -> x = c)) as double), 2))"),
        ("chi2", "enc / n * squares - n"),
        ("p_uniform", _upper_tail("(pow(greatest(chi2, 0D) / (enc - 1), 1 / 3D) - (1 - 2D / (9 * (enc - 1)))) / sqrt(2D / (9 * (enc - 1)))")),
        # runs of the upper and the lower half of the alphabet
        ("half", "transform(codes, c -> case when c >= enc / 2 then 1 else 0 end)"),
        ("n1", "cast(aggregate(half, 0, (a, x) -> a + x) as double)"),
        ("runs", "aggregate(zip_with(half, slice(half, 2, size(half)), (a, b) -> case when a <> b then 1 else 0 end), 1, (a, x) -> a + coalesce(x, 0))"),
        ("runs_mean", "2 * n1 * (n - n1) / n + 1"),
        ("p_runs", f"case when n1 = 0 or n1 = n then 1e-6D else least(1D, 2 * {_upper_tail('abs(runs - runs_mean) / sqrt(greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), 1e-6D))')}) end"),
        # correlation of neighbours
        ("mean", "aggregate(codes, 0D, (a, x) -> a + x) / n"),
        ("spread", "aggregate(codes, 0D, (a, x) -> a + pow(x - mean, 2))"),
        ("lag", "aggregate(zip_with(codes, slice(codes, 2, size(codes)), (a, b) -> (a - mean) * (b - mean)), 0D, (a, x) -> a + coalesce(x, 0D))"),
        ("p_serial", f"case when spread = 0 then 1e-6D else least(1D, 2 * {_upper_tail('abs(lag / spread * sqrt(n))')}) end"),
        # Fisher's sum of three has a chi-squared law of six degrees
        ("half_sum", "-(ln(greatest(p_uniform, 1e-12D)) + ln(greatest(p_runs, 1e-12D)) + ln(greatest(p_serial, 1e-12D)))"),
        ("p", "exp(-half_sum) * (1 + half_sum + half_sum * half_sum / 2)"),
    ]


def word_costs(pairs: dict[str, int], flat: float = 0.2, prior: float = 20) -> list[float]:
    """Minus the log chance of each symbol after each other one in words, row by row, from the counts of letter pairs.

    flat: the share of letters that follow no rule; prior: the weight of a letter's own frequency against its pairs'.
    """
    seen = [[0] * 26 for _ in range(26)]
    for pair, n in pairs.items():
        a, b = (ord(c) - ord("a") for c in pair.lower())
        seen[a][b] += n
    total = sum(map(sum, seen))
    alone = [(sum(row[b] for row in seen) + 1) / (total + 26) for b in range(26)]
    kind = lambda i: min(i // 26, 2) + (i == 53)
    out = []
    for i in range(len(SYMBOLS)):
        for j in range(len(SYMBOLS)):
            if j >= 52:
                one = 1 / 10 if j == 52 else 1 / 4
            else:
                after = (seen[i % 26][j % 26] + prior * alone[j % 26]) / (sum(seen[i % 26]) + prior) if i < 52 else alone[j % 26]
                one = (1 - flat) * after + flat / 26
            out.append(-math.log(TURNS[kind(i)][kind(j)] * one))
    return out


def scores(costs: list[float], token: str = "token") -> list[tuple[str, str]]:
    """SQL columns after those of randomness(): the likelihood ratio a character, and the bin of it, 0 for what the battery rejects."""
    return [
        ("sym", f"transform(split(translate({token}, '123456789/-_', '000000000+++'), ''), c -> instr('{SYMBOLS}', c) - 1)"),
        ("as_word", f"aggregate(zip_with(slice(sym, 1, size(sym) - 1), slice(sym, 2, size(sym)), (a, b) -> element_at(array({', '.join(f'{c:.4f}D' for c in costs)}), a * {len(SYMBOLS)} + b + 1)), 0D, (a, x) -> a + x)"),
        ("ratio", "as_word / (n - 1) - ln(enc)"),
        ("bin", f"case when p < {ALPHA}D then 0 else cast(greatest(0, least({BINS - 1}, floor(ratio * 10) + {EVEN})) as int) end"),
    ]


def _scored(tokens: DataFrame, costs: list[float]) -> DataFrame:
    for name, sql in [*randomness(), *scores(costs)]:
        tokens = tokens.withColumn(name, F.expr(sql))
    return tokens


def _class(n: str) -> str:
    return "case " + " ".join(f"when {n} >= {low} then {k}" for k, low in reversed(list(enumerate(CLASSES)))) + " else 0 end"


_MIXED = "token rlike '[0-9]' and token rlike '[A-Za-z]'"
_WORD = "token rlike '^[A-Za-z]+$'"


def letter_pairs(tokens: DataFrame) -> dict[str, int]:
    """How often each pair of letters is in the words among the tokens; at most 52 x 52 counts."""
    pairs = tokens.filter(_WORD).select(F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def limits(tokens: DataFrame, costs: list[float], q: float) -> dict[int, int]:
    """The least bin that counts as a discovery, by length class; at most len(CLASSES) x BINS x 2 counts are looked at."""
    counts = _scored(tokens.filter(f"{_MIXED} or {_WORD}"), costs).select(F.expr(_class("length(token)")).alias("cls"), F.expr(_MIXED).alias("target"), "bin").groupBy("cls", "target", "bin").agg(F.count(F.lit(1)).alias("n"))
    target = [[0] * BINS for _ in CLASSES]
    null = [[0] * BINS for _ in CLASSES]
    for r in counts.collect():
        (target if r["target"] else null)[r["cls"]][r["bin"]] += r["n"]
    out = {}
    for cls in range(len(CLASSES)):
        pooled = [sum(null[c][b] for c in range(cls + 1)) for b in range(BINS)]
        d, t = sum(pooled), sum(target[cls])
        good = [b for b in range(EVEN, BINS) if t and (1 + sum(pooled[b:])) / (1 + d) <= q * sum(target[cls][b:]) / t]
        if good:
            out[cls] = min(good)
    return out


def scan(docs: DataFrame, q: float = 0.01, text_col: str = "text") -> DataFrame:
    """The rows of docs, as the struct ``row``, with ``base`` and ``found``: arrays of (start, kind, end) in order.

    base: spans of the three patterns; found: those and the tokens that the battery
    adds, where no base span overlaps.  Positions count code points, ends are
    exclusive.  q: the share of false discoveries that is accepted.  Null and empty
    texts have no spans; rows that repeat get the same; an empty table gives no
    rows.  A corpus too small for its null to support any discovery adds none.
    """
    frame = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    long_tokens = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).select(F.explode(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))).alias("token"))
    costs = word_costs(letter_pairs(long_tokens))
    low = limits(long_tokens, costs, q)
    with_base = frame
    for p, k, g in ((ASSIGN, "assign", 12), (ACCESS, "access", 0), (HEX, "hex", 0)):
        with_base = with_base.withColumn(f"by_{k}", F.expr(spans_of("t", p, k, g)))
    bare = "transform({0}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    with_base = with_base.withColumn("base", F.expr(f"array_sort({bare.format('concat(by_assign, by_access, by_hex)')})")).drop("by_assign", "by_access", "by_hex")
    if not low:
        return with_base.select("row", "base", F.col("base").alias("found"))
    least = "case " + " ".join(f"when length(x.token) >= {CLASSES[k]} then {low.get(k, BINS)}" for k in reversed(range(len(CLASSES)))) + f" else {BINS} end"
    out = with_base.withColumn("more", F.expr(spans_of("t", TOKEN, "random")))
    out = out.withColumn("more", F.expr(f"filter(more, x -> x.token rlike '[0-9]' and x.token rlike '[A-Za-z]' and {least} < {BINS} and not exists(base, y -> y.start < x.end and x.start < y.end))"))
    held = ["token"]  # the battery, step by step, in structs: SQL has no let
    out = out.withColumn("s", F.expr("transform(more, x -> named_struct('start', x.start, 'end', x.end, 'token', x.token))"))
    for name, sql in [*randomness("tok.token"), *scores(costs, "tok.token")]:
        body = sql
        for h in held:
            body = _qualify(body, h)
        out = out.withColumn("s", F.expr(f"transform(s, tok -> named_struct({', '.join(f'{chr(39)}{h}{chr(39)}, tok.{h}' for h in ['start', 'end', *held])}, '{name}', {body}))"))
        held.append(name)
    added = f"transform(filter(s, x -> x.bin >= {least}), x -> named_struct('start', x.start, 'kind', {_kind('random')}, 'end', x.end))"
    return out.select("row", "base", F.expr(f"array_sort(concat(base, {added}))").alias("found"))


def _qualify(sql: str, name: str) -> str:
    """SQL with a bare column name read from the struct tok."""
    return re.sub(rf"(?<![\w.']){name}(?![\w'(])", f"tok.{name}", sql)


def as_text(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, q: float = 0.01, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span in ``text`` replaced by the mask; overlapping spans are one. Columns as they came."""
    found = scan(docs, q)
    text = "row.text"
    hidden = f"""aggregate(found, named_struct('at', 0, 'out', ''),
        (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', case when x.start >= a.at then concat(a.out, substring({text}, a.at + 1, x.start - a.at), '{mask}') else a.out end),
        a -> concat(a.out, substring({text}, a.at + 1)))"""
    clean = found.withColumn("text", F.expr(f"case when size(found) = 0 then {text} else {hidden} end"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.expr("case when size(found) = 0 then row.n_chars else char_length(text) end").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = {_kind(kind)})) as bigint)").alias(f"n_{kind}")
    return found.select(F.col("row.doc_id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("found").alias("spans"))
