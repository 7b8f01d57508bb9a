"""Secret scans: fixed patterns plus a battery of randomness tests with false-discovery control (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from math import atanh, log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import free_name, materialize, text_or_empty

#: Fixed patterns of the base rule; letter case is open in the key words of ``assign`` only.
_KEY = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters fails; as runs are taken whole, the least length can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the tests look at: runs of letters and digits of the usual encodings.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED = 12
#: False-discovery rate of the spans that the tests add.
RATE = 0.001
#: Signs of the encodings, and the characters of each encoding ("l": in lower case; looked up in upper case).
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_UPPER = SIGNS[:26]
ENCODINGS = {"hex": "0123456789ABCDEF", "base32": _UPPER + "234567", "base32l": _UPPER + "234567", "base36": _UPPER + "0123456789", "base36l": _UPPER + "0123456789", "letters": SIGNS[:52], "alnum": SIGNS[:62], "base64": SIGNS}
#: What text has, from words and identifiers of sf0.1 and of Python's library: -4 log2 of the share of the second letter
#: after the first (a row for each letter, base 36, a tenth of it even), and how often classes (lower, upper, digit,
#: sign) follow each other.
LETTER_PAIRS = "pnijmtorhvsfj9pmvefbhqqtrw htps8uvwkiw7uvfrwmotgwwwgv fvquftv8dwiitubuvmqflvvwqw gotm6tsmcvwkvmcvwljjkvqusw fqkgkmsqjvugnbnos9egoqrmsr erqpghsrawujus8rwdmhhutwrv eosv7vnggwujrhjtwhdjjsqwws antw6wtjgwtmvkgtwmkgrtowvt nqinfimtrwvjl7dpunedvqvswq 5wqv7wwwpwsvwwepwvnvgwwwvw ktsr3tptfwvkvlrqvpgtpvgwsw ettn7dvwewweuuhswukmlvvwdw alus5swwewvpmtfewulrmwvwuw gnjbdqdljvrmslfrtnhapqpwuu qolisgrwlvrnk7pmvbjjdrosww 9vrqbhvrgwvfvvdiweofltuwlw vwvvwwwwwwwtwrvuvttw1wwwww eoop6tmmgvqoohesvihgnrqwnu lsht8uqdguspmqjlsqh8kvswpw grrtcuv7bwtquqgswhljkurvoo klosanqqlwugjbljtchftstfwu 9vvw4vwvawvvtuivwvvvuwvwww cvvqivw59wwquljvwinvvwtvww fnaoemwugwwmkvjfplq8vovoov jlqtduvjhwwkngfbwhcbutkwuv inms9uophsqoouiqsrnm5qwwur".split()
CLASS_PAIRS = ((0.875, 0.025, 0.003, 0.097), (0.146, 0.745, 0.004, 0.105), (0.053, 0.013, 0.739, 0.196), (0.732, 0.213, 0.029, 0.027))
#: Of the class changes this part is taken as even, for text unlike that sample.
EVEN_PART = 0.1
#: Families for the false-discovery control: an encoding and a band of lengths that starts at one of these.
LENGTH_BANDS = (24, 32, 48, 64, 128)
#: Steps of -log10 p, in hundredths, up to the largest that counts.
P_STEPS, P_MOST = 100, 40
#: Least correlation of neighbouring code points in what counts as a sequence.
SEQUENCE = 0.9


def matches(body: Column, pattern: str) -> Column:
    """``array<struct<m, gap>>``: all leftmost non-overlapping matches, each with the length of the piece before it.

    Pieces between matches and matches alternate.
    """
    pieces = F.split(body, pattern, -1)
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(pieces, 1, F.greatest(F.size(found), F.lit(1))), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    return F.when(body.rlike(pattern), F.filter(pairs, lambda p: p["m"].isNotNull())).otherwise(F.array().cast("array<struct<m:string,gap:int>>"))


#: Least number of items that are added up one by one.
RUN = 32


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """``array<int>``: ``join`` (sum or maximum, from 0) of the values up to each item, the item included.

    ``items`` must be a column of the step before, as it stands in a lambda. Items are taken in runs of about the root of
    their number, and runs in turn: appending to an array copies it, so one pass would be quadratic in the items.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(RUN)).cast("int")
    runs = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / size).cast("int")), lambda r: F.slice(items, r * size + 1, size)), lambda run: F.size(run) > 0)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        now = join(acc["at"], value(x))
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    inside = F.transform(runs, lambda run: F.aggregate(run, zero, step))
    before = F.aggregate(inside, zero, lambda acc, x: F.struct(join(acc["at"], x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    return F.flatten(F.zip_with(inside, before, lambda x, start: F.transform(x["out"], lambda v: join(start, v))))


def spans_of_matches(found: Column) -> Column:
    """``array<struct<s, e, m>>``: code point ranges and texts of ``matches``, a column of the step before."""
    ends = running(found, lambda p: p["gap"] + F.length(p["m"]), lambda x, y: x + y)
    return F.zip_with(found, ends, lambda p, e: F.struct((e - F.length(p["m"])).alias("s"), e.alias("e"), p["m"].alias("m")))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def text_ratios(encoding: str) -> list[list[float]]:
    """-log10 of P(text) / P(random) of the second character after the first, for all pairs of ``SIGNS``.

    Text is a chain over the encoding's own characters, so that each row of P(text) sums to 1; 0 outside these.
    """
    chars = ENCODINGS[encoding]
    classes = sorted({_class(c) for c in chars})
    share = lambda x, y: 2.0 ** (-int(LETTER_PAIRS[ord(x.lower()) - 97][ord(y.lower()) - 97], 36) / 4)
    table = [[0.0] * len(SIGNS) for _ in SIGNS]
    for x in chars:
        k = _class(x)
        row = {j: CLASS_PAIRS[k][j] for j in classes}
        for j in classes:
            change = (1 - EVEN_PART) * row[j] / sum(row.values()) + EVEN_PART / len(classes)
            after = [y for y in chars if _class(y) == j]
            chained = x.isalpha() and after[0].isalpha() and (k, j) != (0, 1)  # a capital after a small letter starts a word
            weight = {y: share(x, y) if chained else 1.0 for y in after}
            for y in after:
                table[SIGNS.index(x)][SIGNS.index(y)] = -log(change * weight[y] / sum(weight.values()) * len(chars)) / log(10)
    return table


def encoding_of(token: Column) -> Column:
    """A name of ``ENCODINGS``, by the characters that occur; null where nothing fits a secret (one class only)."""
    digit, upper, lower = token.rlike("[0-9]"), token.rlike("[A-Z]"), token.rlike("[a-z]")
    return (
        F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$") & digit & token.rlike("[A-Fa-f]"), "hex")
        .when(token.rlike(r"^[A-Z2-7]+=*$") & digit & upper, "base32")
        .when(token.rlike(r"^[a-z2-7]+=*$") & digit & lower, "base32l")
        .when(token.rlike(r"^[A-Z0-9]+$") & digit & upper, "base36")
        .when(token.rlike(r"^[a-z0-9]+$") & digit & lower, "base36l")
        .when(token.rlike(r"^[A-Za-z]+$") & upper & lower, "letters")
        .when(token.rlike(r"^[A-Za-z0-9]+$") & digit & upper & lower, "alnum")
        .when(token.rlike(r"^[A-Za-z0-9+/_-]+=*$") & digit & upper & lower, "base64")
    )


def text_chain(encoding: str) -> list[float]:
    """Shares of an encoding's characters in a long text of the text model (its chain's stationary distribution)."""
    chars = [SIGNS.index(c) for c in ENCODINGS[encoding]]
    table = text_ratios(encoding)
    chance = [[10 ** -table[x][y] / len(chars) for y in chars] for x in chars]
    share = [1 / len(chars)] * len(chars)
    for _ in range(200):
        share = [sum(share[i] * chance[i][j] for i in range(len(chars))) for j in range(len(chars))]
    return share


def unevenness(encoding: str) -> float:
    """What each character of a text adds to chi-squared against an even alphabet, over what a random one adds."""
    share = text_chain(encoding)
    return len(share) * sum(p * p for p in share) - 1


def _upper_tail(x: Column) -> Column:
    """P(normal > x) for x >= 0, within 0.3 % at any x (Borjesson and Sundberg's bound)."""
    return F.exp(-x * x / 2) / (sqrt(2 * pi) * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))


def battery(token: Column, encoding: Column) -> Column:
    """The p-value of "this is no secret" for a token of the encoding, from three tests of randomness.

    * Runs: the likelihood ratio of text to random characters over a chain of character classes (how runs of a class
      end) and of letter pairs. Under text, a ratio of p or less has probability p at most, whatever the length.
    * Chi-squared of the character counts against the encoding's even alphabet. Under text it is about normal with the
      mean and spread of a noncentral chi-squared; less than that speaks for a random string.
    * Serial correlation of neighbouring code points. Under "a sequence" it is ``SEQUENCE`` or more; Fisher's
      transform of it is about normal.

    The first two have one null and depend on each other: their p-values are combined by Cauchy's rule, where one near 1
    outweighs a small one, so a string that is less even than text is none. A secret is neither text nor a sequence, so
    the p-value of the whole is the larger of that and the third.
    """
    plain = F.rtrim(token, F.lit("="))
    chars = F.split(plain, "")
    n = F.size(chars)
    of_encoding = lambda value: sum((F.when(encoding == name, value(name)).otherwise(0) for name in ENCODINGS), F.lit(0)).cast("double")
    size = of_encoding(lambda name: len(ENCODINGS[name]))
    sorted_chars = F.sort_array(chars)
    same = F.aggregate(sorted_chars, F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("sq")), lambda a, x: F.struct(x.alias("c"), F.when(a["c"] == x, a["k"] + 1).otherwise(1).alias("k"), (a["sq"] + F.when(a["c"] == x, 2 * a["k"] + 1).otherwise(1)).alias("sq")))["sq"]
    shift = n * of_encoding(unevenness)
    chi = (same * size / n - n - (size - 1) - shift) / F.sqrt(2 * (size - 1) + 4 * shift)
    ratios = F.split(F.lit(",".join(f"{x:.4g}" for name in ENCODINGS for row in text_ratios(name) for x in row)), ",").cast("array<double>")
    part = sum((F.when(encoding == name, i * len(SIGNS) ** 2).otherwise(0) for i, name in enumerate(ENCODINGS)), F.lit(0))
    folded = F.when(encoding.isin("hex", "base32l", "base36l"), F.upper(plain)).otherwise(plain)
    places = F.transform(F.split(folded, ""), lambda c: F.instr(F.lit(SIGNS), c) - 1)
    chain = F.struct(part.alias("part"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    text = F.aggregate(places, chain, lambda a, c: F.struct(a["part"].alias("part"), c.alias("last"), (a["sum"] + F.when(a["last"] >= 0, F.get(ratios, a["part"] + a["last"] * len(SIGNS) + c)).otherwise(0.0)).alias("sum")))["sum"]
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("first", "last", "sx", "sxx", "sxy")))

    def step(a, c):
        v = F.ascii(c).cast("double")
        return F.struct(F.when(a["first"] == 0, v).otherwise(a["first"]).alias("first"), v.alias("last"), (a["sx"] + v).alias("sx"), (a["sxx"] + v * v).alias("sxx"), (a["sxy"] + a["last"] * v).alias("sxy"))

    def correlation(a):
        mean = a["sx"] / n
        spread = F.greatest(a["sxx"] / n - mean * mean, F.lit(1e-9)) * (n - 1)
        return F.least(F.abs(a["sxy"] - (a["sx"] - a["last"]) * (a["sx"] - a["first"]) / (n - 1)) / spread, F.lit(0.999999))

    serial = F.aggregate(chars, zero, step, correlation)
    made = F.array(F.struct(F.greatest(text, F.lit(0.0)).alias("text"), chi.alias("chi"), ((F.atanh(serial) - atanh(SEQUENCE)) * F.sqrt((n - 3).cast("double"))).alias("serial")))
    return F.get(F.transform(made, p_value), F.lit(0))


def p_value(z: Column) -> Column:
    """The combined p-value of struct(text: -log10 p, chi: normal under text, serial: normal under a sequence)."""
    # the cotangent of pi * p is what Cauchy's rule averages
    of_text = 1 / F.tan(pi * F.pow(F.lit(10.0), -F.least(z["text"], F.lit(300.0))))
    of_chi = F.when(z["chi"] < 0, 1.0).otherwise(-1.0) / F.tan(pi * F.greatest(_upper_tail(F.abs(z["chi"])), F.lit(1e-300)))
    mean = (of_text + of_chi) / 2
    text_or_uneven = F.when(mean > 1, F.atan(1 / mean) / pi).otherwise(0.5 - F.atan(mean) / pi)
    sequence = F.when(z["serial"] < 0, _upper_tail(-z["serial"])).otherwise(1 - _upper_tail(z["serial"]))
    return F.greatest(text_or_uneven, sequence, F.lit(1e-300))


def scan(df: DataFrame, text: str, out: str = "_found") -> DataFrame:
    """Adds ``out``: struct of ``base`` (array of kind, order, s, e), ``counts`` and ``candidates`` (e, family, step)."""
    body = text_or_empty(text)
    a, x, h, t = (free_name(df, f"_scan{i}") for i in range(4))
    df = df.withColumns({a: matches(body, ASSIGN), x: matches(body, ACCESS), h: matches(body, HEX), t: matches(body, TOKEN)})
    df = df.withColumns({c: spans_of_matches(F.col(c)) for c in (a, x, h, t)})
    long_enough = F.filter(a, lambda m: F.length(F.regexp_extract(m["m"], ASSIGN, 2)) >= MIN_ASSIGNED)
    named = lambda arr, i: F.transform(arr, lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e")))
    base = F.sort_array(F.concat(named(long_enough, 0), named(F.col(x), 1), named(F.col(h), 2)))
    typed = F.filter(F.transform(t, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["m"].alias("m"), encoding_of(m["m"]).alias("enc"))), lambda m: m["enc"].isNotNull())
    df = df.withColumns({a: base, x: typed}).drop(h, t)
    tested = F.transform(x, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["enc"].alias("enc"), battery(m["m"], m["enc"]).alias("p")))
    df = df.withColumn(x, tested)
    band = lambda m: sum((F.when(m["e"] - m["s"] >= b, 1).otherwise(0) for b in LENGTH_BANDS), F.lit(0))
    step_of = lambda m: F.least(F.lit(P_MOST * P_STEPS), F.floor(-F.log10(m["p"]) * P_STEPS)).cast("int")
    candidates = F.transform(x, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.concat_ws("/", m["enc"], band(m).cast("string")).alias("family"), step_of(m).alias("step")))
    return df.withColumn(out, F.struct(F.col(a).alias("base"), candidates.alias("candidates"))).drop(a, x)


def discovery_steps(found: DataFrame, column: str, rate: float = RATE) -> dict[str, int]:
    """Family (encoding / length band) -> least step of -log10 p that Benjamini and Hochberg's rule accepts.

    Candidates are counted by family and step, so p-values of parts merge by addition; one number for each of at most
    eight encodings by six length bands reaches the driver.
    """
    # an outer explode: for an inner one the optimizer adds a filter on the array and computes all that made it once more
    each = found.select(F.explode_outer(F.col(column)["candidates"]).alias("c")).filter("c.family IS NOT NULL")
    counts = each.groupBy("c.family", "c.step").agg(F.count(F.lit(1)).alias("n"))
    family = Window.partitionBy("family")
    ranked = counts.withColumns({"m": F.sum("n").over(family), "k": F.sum("n").over(family.orderBy(F.desc("step")))})
    ok = ranked.filter((F.pow(F.lit(10.0), -F.col("step") / P_STEPS) <= F.col("k") * rate / F.col("m")) & (F.col("step") > 0))
    return {r["family"]: r["least"] for r in ok.groupBy("family").agg(F.min("step").alias("least")).collect()}


def spans_of(column: str, least: dict[str, int]) -> Column:
    """All spans (s, kind number, e): the base ones, and accepted candidates that no base span overlaps."""
    found = F.col(column)
    passed = F.lit(False)

    def accepted(c):
        ok = passed
        for family, step in sorted(least.items()):
            ok = ok | ((c["family"] == family) & (c["step"] >= step))
        return ok & ~F.exists(found["base"], lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    added = F.transform(F.filter(found["candidates"], accepted), lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    return F.sort_array(F.concat(found["base"], added))


def joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    Null and empty texts have no span. Whole texts are read once; what is stored between the passes are spans.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = materialize(scan(slim, "_text").drop("_text"), "secret-candidates")
    least = discovery_steps(found, "_found")
    base = F.col("_found.base")
    count = lambda i: F.size(F.filter(base, lambda b: b["k"] == i)).cast("long")
    return found.select(F.col("_key").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans_of("_found", least)).alias("spans"))


def redact(df: DataFrame, *, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask``; overlapping spans become one. Null stays null."""
    columns = df.columns
    packed = df.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text"))
    # texts are scanned twice rather than stored once more
    found = scan(packed, "_text")
    least = discovery_steps(found, "_found")
    cut = found.withColumn("_spans", spans_of("_found", least))
    body = F.col("_text")
    # where a text has spans, its characters are sliced: counting code points from its start for each span is quadratic
    cut = cut.withColumns({"_ends": running(F.col("_spans"), lambda x: x["e"], F.greatest), "_chars": F.when(F.size("_spans") > 0, F.split(body, ""))})
    before = lambda i: F.coalesce(F.get(F.col("_ends"), i - 1), F.lit(0))

    def piece(x, i):
        gap = F.array_join(F.slice(F.col("_chars"), before(i) + 1, F.greatest(x["s"] - before(i), F.lit(0))), "")
        return F.when(x["s"] > before(i), F.concat(gap, F.lit(mask))).when((x["s"] == before(i)) & (i == 0), F.lit(mask)).otherwise("")

    tail = F.array_join(F.slice(F.col("_chars"), F.element_at("_ends", -1) + 1, F.size("_chars")), "")
    clean = F.concat(F.array_join(F.transform("_spans", piece), ""), tail)
    fixed = cut.withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(body))
    return fixed.select(*((F.col("_clean") if c == text else F.col("_row")[c]).alias(c) for c in columns))
