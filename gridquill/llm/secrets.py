"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Beside the patterns, every long token of an encoding's alphabet is tested for being no ordinary text, such as a name of several words,
a slug or a path.  Each test has a p value under ordinary text, conditional on how many letters and digits the token has:
chi-squared uniformity of its symbols, letters in either case; its runs, which are words, groups of digits and stretches of
capitals, far more in a random token than in one made of words; and the lag-1 serial correlation of vowels, negative in
words, which is how often vowels and consonants alternate.  The p values err to the safe side for words of any language
(the tests hold thousands of ordinary tokens against them) and are combined by Fisher's sum of logarithms.  A token
that is clearly no chance result, by runs over the halves of its alphabet or by the serial correlation of its symbols, is
taken for a pattern and never reported.  Within each stratum of lengths the Benjamini-Hochberg procedure bounds the share of
ordinary tokens among those that are reported.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns of the base kinds, in the order that sorts them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # what AKIA[A-Z0-9]+ finds, less what is under 16 characters
HEX = r"[0-9a-f]{32,}"  # what [0-9a-f]+ finds, less what is under 32 characters
KINDS = ("assign", "access", "hex", "random")
MIN_SECRET = 8

UPPER, LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets by encoding, in the order in which they are tried.
ALPHABETS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base64": UPPER + LETTERS + DIGITS + "+/", "base64url": UPPER + LETTERS + DIGITS + "-_"}
SYMBOLS = {"hex": "0-9a-f", "HEX": "0-9A-F", "base32": "A-Z2-7", "base64": "A-Za-z0-9+/", "base64url": r"A-Za-z0-9_\-"}
#: Tokens that are tested have this many characters at least.
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_\-]{{{MIN_TOKEN},}}={{0,2}}"
#: Stretches of a run that are tested each: of base64 and base64url, and between all separators.
STRETCHES = tuple(rf"[{x}]{{{MIN_TOKEN},}}={{0,2}}" for x in (r"A-Za-z0-9+/", r"A-Za-z0-9_\-", r"A-Za-z0-9+"))
#: A stretch between separators that has a narrower alphabet than its run.
NARROW = r"(?:^|[/_\-])(?:" + "|".join(f"[{SYMBOLS[x]}]{{{MIN_TOKEN},}}" for x in ("hex", "HEX", "base32")) + r")(?:$|[/_=\-])"
#: Sum of the squared shares of symbols in ordinary tokens: of digits alone in hexadecimal, of letters of a language in the others.
ORDINARY_HEX, ORDINARY_LETTERS = 0.1, 0.066
#: Runs of an ordinary token: a run of one word, of digits, of capitals; how often one ends behind a character, at most, and the
#: spread of that as a share of the binomial one, words being of more even length than chance.
PIECES = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
PIECE_ENDS, PIECE_SPREAD = 0.27, 0.6
#: How often neighbouring letters are a vowel and a consonant in ordinary words, at least; letters and pairs that a test needs.
ALTERNATE, LEAST_LETTERS = 0.5, 8
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
#: Standard deviations from chance by which a token is a pattern.
PATTERN = 3.5
#: p values from here on are not looked at for patterns; a rate has to be below.
WORTH = 0.25
#: Least p value of a test.
LEAST_P = 1e-15
#: p values are counted in bins of their logarithm, BINS_PER_DECADE to a power of ten, down to 10 ** LOWEST; what has no encoding is in the last.
BINS_PER_DECADE, LOWEST = 20, -16
LAST_BIN = -LOWEST * BINS_PER_DECADE
BLOCK = 256


def running_sum(lengths: Column) -> Column:
    """Inclusive running sums of an int array, in blocks so that long arrays stay cheap."""
    none = F.array().cast("array<int>")
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["r"], F.array(a["s"] + x)).alias("r"))
    zero = F.struct(F.lit(0).alias("s"), none.alias("r"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(lengths, k * BLOCK + 1, BLOCK), zero, step))
    totals = F.aggregate(blocks, zero, lambda a, b: step(a, b["s"]))["r"]
    shifted = F.zip_with(blocks, totals, lambda b, t: F.transform(b["r"], lambda v: v + t - b["s"]))
    return F.when(F.size(lengths) > 0, F.flatten(shifted)).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of the leftmost non-overlapping matches; places count code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    spans = F.zip_with(found, running_sum(lengths), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def encoding_of(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("string")
    for name in reversed(SYMBOLS):
        out = F.when(body.rlike(f"^[{SYMBOLS[name]}]+$"), F.lit(name)).otherwise(out)
    return out


#: Coefficients of a Chebyshev fit to the logarithm of erfc, right to seven places.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_beyond(x: Column) -> Column:
    """The share of a normal distribution beyond x >= 0 standard deviations on one side."""
    x = x / 2**0.5
    t = 1 / (1 + x / 2)
    poly = functools.reduce(lambda a, c: a * t + c, ERFC[-2::-1], F.lit(ERFC[-1]))
    return t * F.exp(poly - x * x) / 2


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal deviate is z or more, LEAST_P at least."""
    beyond = normal_beyond(F.abs(z))
    return F.greatest(F.when(z > 0, beyond).otherwise(1 - beyond), F.lit(LEAST_P))


def combined(*p: Column) -> Column:
    """One p value by Fisher: minus the sum of three logarithms has a gamma distribution of three."""
    x = -functools.reduce(lambda a, b: a + b, (F.ln(v) for v in p))
    # Named once, so that it is computed once.
    return F.element_at(F.transform(F.array(x), lambda v: F.exp(-v) * (1 + v + v * v / 2)), 1)


#: Deviates that stand for no variation at all.
NO_VARIATION = 99.0


def uneven(text: Column, n: Column, symbols: int, squares: float) -> Column:
    """The deviate of a text's chi-squared over so many symbols among those of ordinary texts of its length; far below 0 if it is too uniform for one."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.pow((F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0)))
    off, df = n * F.lit(symbols * squares - 1), symbols - 1
    return (F.lit(float(symbols)) / n * total - n - df - off) / F.sqrt(2 * (df + 2 * off))


def ordinary_p(body: Column, encoding: str) -> Column:
    """The combined p value of a token, without its padding, under ordinary text."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    least = lambda z, enough: F.when(enough, upper_tail(z)).otherwise(F.lit(1.0))
    plain = F.regexp_replace(body, "[^A-Za-z0-9]", "")
    steps = F.length(plain).cast("double") - 1
    ends = count(body, PIECES) - 1
    runs = least((ends - steps * PIECE_ENDS) / (F.sqrt(steps * (PIECE_ENDS * (1 - PIECE_ENDS))) * PIECE_SPREAD), steps >= 1)
    if encoding in ("hex", "HEX"):
        n = F.length(body).cast("double")
        return combined(upper_tail(-uneven(body, n, 16, ORDINARY_HEX)), runs, F.lit(1.0))
    letters = F.lower(F.regexp_replace(body, "[^A-Za-z]", ""))
    n = F.length(letters).cast("double")
    even = least(-uneven(letters, n, 26, ORDINARY_LETTERS), n >= LEAST_LETTERS)
    kinds = F.translate(F.lower(plain), VOWELS + CONSONANTS + DIGITS, "v" * len(VOWELS) + "c" * len(CONSONANTS) + "0" * 10)
    pairs, turns = count(kinds, "(?=[vc][vc])"), count(kinds, "(?=vc|cv)")
    serial = least((pairs * ALTERNATE - turns - 0.5) / F.sqrt(pairs * (ALTERNATE * (1 - ALTERNATE))), pairs >= LEAST_LETTERS)
    return combined(even, runs, serial)


def pattern(body: Column, encoding: str) -> Column:
    """Whether runs over the halves of the alphabet or the serial correlation of symbols are too far from chance for a random token."""
    alphabet = ALPHABETS[encoding]
    n = F.length(body).cast("double")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    half = len(alphabet) // 2
    bits = F.translate(body, alphabet, "0" * half + "1" * (len(alphabet) - half))
    ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    zeros = n - ones
    runs = F.length(F.regexp_replace(F.regexp_replace(bits, "0+", "0"), "1+", "1")).cast("double")
    mean = 2 * ones * zeros / n + 1
    var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
    z_runs = F.when(var > 0, F.abs(runs - mean) / F.sqrt(var)).otherwise(F.lit(NO_VARIATION))
    value = lambda c: F.instr(F.lit(alphabet), c).cast("double")
    start = F.struct(F.lit(None).cast("double").alias("last"), *(F.lit(0.0).alias(x) for x in ("s", "q", "p")))

    def add(a: Column, v: Column) -> Column:
        return F.struct(v.alias("last"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), (a["p"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("p"))

    def deviate(t: Column) -> Column:
        mu = t["s"] / n
        spread = t["q"] / n - mu * mu
        return F.when(spread > 0, F.abs((t["p"] / F.greatest(n - 1, F.lit(1.0)) - mu * mu) / spread * F.sqrt(n))).otherwise(F.lit(NO_VARIATION))

    z_serial = F.aggregate(F.transform(chars, value), start, add, deviate)
    return (z_runs > PATTERN) | (z_serial > PATTERN)


def token_tests(token: Column) -> Column:
    """struct<stratum,bin>: the stratum of lengths and the bin of the combined p value, the last for patterns and what has no encoding."""
    body = F.regexp_replace(token, "=+$", "")
    kind = encoding_of(token)
    p = F.lit(None).cast("double")
    for name in ALPHABETS:
        p = F.when(kind == name, ordinary_p(body, name)).otherwise(p)
    place = lambda p: F.least(F.greatest(F.floor((F.log10(p) - LOWEST) * BINS_PER_DECADE), F.lit(0)), F.lit(LAST_BIN - 1)).cast("int")
    # Only what may be reported at any rate below WORTH is looked at for patterns.
    odd = F.lit(False)
    for name in ALPHABETS:
        odd = F.when(kind == name, pattern(body, name)).otherwise(odd)
    bins = F.transform(F.array(p), lambda v: F.when(v.isNull(), F.lit(LAST_BIN)).when((v < WORTH) & odd, F.lit(LAST_BIN)).otherwise(place(v)))
    return F.struct(F.floor(F.log2(F.length(body).cast("double")) * 2).cast("int").alias("stratum"), F.element_at(bins, 1).alias("bin"))


def stretches(run: Column) -> Column:
    """array<struct<start,end,found>> of what is tested of a run of TOKEN: all of it, unless it has symbols of both base64 and
    base64url or keys of a narrower alphabet between separators; then its stretches of each alphabet, which may overlap."""
    text = run["found"]

    def parts(pattern: str) -> Column:
        long = F.filter(matches(text, pattern), lambda x: F.length(F.regexp_replace(x["found"], "=+$", "")) >= MIN_TOKEN)
        return F.transform(long, lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["found"].alias("found")))

    mixed = text.rlike("[+/]") & text.rlike(r"[_\-]")
    joined = text.rlike(r"[/_\-]") & text.rlike(NARROW)
    return F.when(mixed | joined, F.array_distinct(F.concat(*map(parts, STRETCHES)))).otherwise(F.array(run))


def thresholds(tested: DataFrame, rate: float) -> DataFrame:
    """(stratum, most): the largest bin of each stratum up to which tokens are reported, by Benjamini-Hochberg at
    this rate.  Input (stratum, bin), counted into bins before anything is compared: strata times LAST_BIN
    rows at most, whatever the corpus' size."""
    counts = tested.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("bin")
    c = counts.select("stratum", "bin", F.sum("n").over(upto).alias("found"), F.sum("n").over(Window.partitionBy("stratum")).alias("tested"))
    p = F.pow(F.lit(10.0), (F.col("bin") + 1) / F.lit(float(BINS_PER_DECADE)) + LOWEST)  # the largest of the bin
    good = (F.col("bin") < LAST_BIN) & (p * F.col("tested") <= rate * F.col("found"))
    return c.where(good).groupBy("stratum").agg(F.max("bin").alias("most"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_chars, base and spans, arrays of struct<start,kind,end> in order
    of (start, kind), kind an index into KINDS, ends exclusive, in code points; keep: further input
    columns to carry, as keep_<name>.  base has the fixed patterns' spans, spans those and the tokens
    that look random.  rate, below WORTH, bounds the share of ordinary tokens among these.  A null text is empty and has none; repeated rows each get their spans; an empty
    table gives no rows."""
    if not 0 < rate < WORTH:
        raise ValueError(f"a rate between 0 and {WORTH}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    spans = rows.select(
        "doc_id", F.length(text).alias("n_chars"), *(f"keep_{c}" for c in keep),
        matches(text, ASSIGN).alias("a"), matches(text, ACCESS).alias("k"), matches(text, HEX).alias("h"), matches(text, TOKEN).alias("t"),
    )
    long_enough = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= MIN_SECRET
    as_span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    found = spans.select(
        "doc_id", "n_chars", *(f"keep_{c}" for c in keep),
        F.array_sort(F.concat(F.transform(F.filter("a", long_enough), as_span(0)), F.transform("k", as_span(1)), F.transform("h", as_span(2)))).alias("base"),
        F.transform("t", lambda run: F.transform(stretches(run), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), token_tests(m["found"]).alias("test")))).alias("tests"),
    )
    found = cut(found, "secret-tests")
    limits = thresholds(found.select(F.explode(F.flatten("tests")).alias("x")).select("x.test.*"), rate)
    # A row for each stratum of lengths, two to each doubling: fewer than 64.
    limits = limits.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "most"))).alias("limits"))
    passed = lambda run: F.filter(run, lambda t: F.coalesce(t["test"]["bin"] <= F.element_at("limits", t["test"]["stratum"]), F.lit(False)))
    within = lambda t, o: (o["start"] <= t["start"]) & (o["end"] >= t["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
    # Of stretches of a run that lie in each other the longest is reported.
    longest = lambda run: F.filter(run, lambda t: ~F.exists(run, lambda o: within(t, o)))
    random = F.flatten(F.transform(F.transform("tests", passed), longest))
    joined = found.crossJoin(F.broadcast(limits))  # one row
    more = F.transform(random, as_span(3))
    return joined.select("doc_id", "n_chars", *(f"keep_{c}" for c in keep), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by a mark; overlapping spans make one stretch."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        parts = F.when(fresh, F.concat(a["parts"], F.array(gap, F.lit(mark)))).otherwise(a["parts"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
