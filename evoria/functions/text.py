"""Text scalars as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\u4e00-\u9fff]+"
#: Legal-form endings and business words that entity keys drop, in the order in which they are tried.
LEGAL_ENDINGS = ("股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "集团公司", "集团", "控股公司", "控股", "科技公司", "技术有限公司", "技术公司", "汽车公司", "公司", "inc", "ltd", "corp", "co")
BUSINESS_WORDS = ("汽车", "科技", "智能", "新能源", "数字", "云计算")
#: Fixed value: characters that entity keys drop.
KEY_PUNCTUATION = "[\\s·•・'’\u200b()（）【】\\[\\]-]+"
#: Sentence ends in the order in which a cut prefers them.
SENTENCE_ENDS = ("。", "！", "？", "；", ".", "!", "?", "\n")
#: Endings that tell an entity's type.
COMPANY_END = r"(公司|集团|银行|基金|事务所|Inc|Corp|Ltd)$"
PERSON_END = r"(CEO|董事长|总裁|创始人|总监|经理|博士|先生|女士)$"


def tokenize(text: Column, *, normalized: bool = False) -> Column:
    """Han runs as interleaved characters and pairs (c0, c0c1, c1, ...), then all Latin words, lower case, repeats kept.

    Texts are brought to NFKC first, in Arrow batches that hold nothing but the texts that NFKC can change;
    ``normalized``: the text is in NFKC, no Python runs. Null and empty texts have no token.
    """
    body = F.coalesce(text, F.lit(""))
    if not normalized:
        body = F.coalesce(nfkc(F.when(body.rlike(unstable()), body)), body)
    lower = F.lower(body)
    runs = F.regexp_extract_all(lower, F.lit(f"({HAN})"), F.lit(1))

    def grams(run):
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.filter(F.array(F.substring(run, i, F.lit(1)), F.when(i < F.length(run), F.substring(run, i, F.lit(2)))), lambda x: x.isNotNull())))

    words = F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.concat(F.flatten(F.transform(runs, grams)), words)


@lru_cache(maxsize=1)
def unstable() -> str:
    """A pattern for the characters that NFKC changes or may join with the one before."""
    from unicodedata import combining, is_normalized

    joins = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    found = sorted({c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (not is_normalized("NFKC", chr(c)) or combining(chr(c)))} | set(joins))
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    # the engine asks range by range: all of ASCII is turned away by the first question
    return "[\\x{80}-\\x{10ffff}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]]"


def nfkc(text: Column) -> Column:
    """NFKC normalization; an Arrow UDF, for texts with compatibility characters only. Null stays null."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    @pandas_udf("string", PandasUDFType.SCALAR)
    def normal(s):
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return normal(text)


def normalize_body(text: Column) -> Column:
    """CRLF to LF, runs of blanks to one space, three or more line ends to two, white space trimmed."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[ \\t\u3000]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def lineage_key(normalized: Column, prefix: int = 2000) -> Column:
    """Group key of reprints: hash of the first code points of the normalized body."""
    return F.substring(F.sha2(F.substring(normalized, 1, prefix).cast("binary"), 256), 1, 16)


def match_form(text: Column) -> Column:
    """Without format, separator and control characters other than line ends; other white space runs as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cf}\p{Zs}\p{Cc}&&[^\n]]", ""), r"(?U)\s+", " ")


def quote_span(text: Column, quote: Column, least: int = 6, middle: int = 40, compat: bool = False) -> Column:
    """struct(start, end) of a quote in ``match_form`` coordinates, null where it isn't found.

    A long quote that does not occur whole is found by its middle ``middle`` characters; the span then reaches out to
    where the quote would begin (``compat``: begins at the middle).
    """
    t, q = match_form(text), match_form(quote)
    n = F.length(q)
    half = F.floor(n / 2).cast("int") - middle // 2
    whole, part = find(t, q), find(t, F.substring(q, half + 1, F.lit(middle)))
    start = part if compat else F.greatest(part - half, F.lit(0))
    at = F.when(whole >= 0, whole).when((n > middle) & (part >= 0), start)
    return F.when((n >= least) & at.isNotNull(), F.struct(at.alias("start"), (at + n).alias("end")))


def find(text: Column, sub: Column) -> Column:
    """0-based place of ``sub`` in ``text``, -1 if it isn't there."""
    return F.position(sub, text) - 1


def sentence_cut(text: Column, limit: int = 800) -> Column:
    """At most ``limit`` characters, cut after the last of the first kind of sentence end that stands past the middle."""
    cut = F.substring(text, 1, limit)
    out = cut
    for end in reversed(SENTENCE_ENDS):
        last = limit - F.position(F.lit(end), F.reverse(cut))  # 0-based place of the last one, ``limit`` if none
        out = F.when((last < limit) & (last > limit // 2), F.substring(cut, F.lit(1), last + 1)).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def fixed_chunks(text: Column, size: int = 1200, step: int | None = None) -> Column:
    """array<struct<start, body>>: windows of ``size`` characters every ``step``."""
    step = step or size
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("body")))


def best_window(text: str, tokens: Sequence[str], width: int, step: int) -> int:
    """Start of the first window (one each ``step``) that holds the most of the distinct ``tokens``.

    Each token is looked for from one window that lacks it to the next place where it is, so a text is read once for a token.
    """
    n = max(len(text) - width - 1, 0) // step + 1
    change = [0] * (n + 1)
    for token in set(tokens):
        w = 0
        while w < n and (at := text.find(token, w * step)) >= 0:
            first, last = max(w, -(-(at + len(token) - width) // step)), min(at // step, n - 1)
            if first <= last:
                change[first] += 1
                change[last + 1] -= 1
            # windows up to ``at`` hold the token here or, where it is too long for them, nowhere
            w = max(last, at // step) + 1
    best = start = hits = 0
    for w in range(n):
        hits += change[w]
        if hits > best:
            best, start = hits, w
    return start * step


def _best_window(text: Column, tokens: Column, width: int, step: int) -> Column:
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    @pandas_udf("int", PandasUDFType.SCALAR)
    def run(texts, tokens):
        import pandas as pd

        found = (None if x is None else 0 if ws is None else best_window(x, [w for w in ws if w is not None], width, step) for x, ws in zip(texts, tokens))
        return pd.Series(list(found), dtype="Int32")

    return run(text, tokens)


def best_snippet(text: Column, tokens: Column, width: int = 220, step: int = 60, shown: int = 200) -> Column:
    """The first window that contains the most of the distinct ``tokens``, line ends as spaces. Texts of one window stay in the JVM."""
    best = F.coalesce(_best_window(F.when(F.length(text) > width, text), tokens, width, step), F.lit(0))
    snippet = F.replace(F.substring(text, best + 1, F.lit(width)), F.lit("\n"), F.lit(" "))
    return F.when(F.length(snippet) > shown, F.concat(F.substring(snippet, 1, shown), F.lit("…"))).otherwise(snippet)


def entity_key(name: Column) -> Column:
    """Lower case without punctuation, all legal-form endings (two characters stay) and one business word."""
    key = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "(?U)" + KEY_PUNCTUATION, "")
    key = F.regexp_replace(key, f"^(.{{2,}}?)(?:{'|'.join(LEGAL_ENDINGS)})+$", "$1")
    words = "|".join(BUSINESS_WORDS)
    # a doubled business word stays
    return F.when(key.rlike(f"({words})\\1$"), key).otherwise(F.regexp_replace(key, f"^(.{{2,}}?)(?:{words})$", "$1"))


def entity_type(name: Column) -> Column:
    return F.when(name.rlike(COMPANY_END), "company").when(name.rlike(PERSON_END), "person").otherwise("other")


def event_type(raw: Column, kinds: Sequence[str], mapping: Mapping[str, str]) -> Column:
    """A controlled kind: itself, by the map, by the first map key it contains, by the first kind it contains, else other."""
    r = F.lower(F.trim(raw))
    out = F.when(r.isin(*kinds), r)
    for k, v in mapping.items():
        out = out.when(r == k, v)
    for k, v in mapping.items():
        out = out.when(r.contains(k), v)
    for k in kinds:
        out = out.when(r.contains(k), k)
    return F.when(raw.isNull() | (raw == ""), "other").otherwise(out.otherwise("other"))


def frame_text(kind: Column, phase: Column, actors: Column, objects: Column, action: Column, scope: Column, lower: Column, upper: Column) -> Column:
    """One labelled line for an event mention."""
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, "、")).otherwise("未知")
    when = F.when(lower.isNull() & upper.isNull(), "时间未知").otherwise(F.concat(F.coalesce(F.substring(lower, 1, 10), F.lit("?")), F.lit("~"), F.coalesce(F.substring(upper, 1, 10), F.lit("?"))))
    scoped = F.array_join(F.transform(F.map_entries(scope), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "、")
    return F.concat(F.lit("类型:"), F.coalesce(kind, F.lit("其他")), F.lit(" 阶段:"), F.coalesce(phase, F.lit("unknown")), F.lit(" 主体:"), listed(actors), F.lit(" 对象:"), listed(objects), F.lit(" 动作:"), F.coalesce(action, F.lit("")), F.lit(" "), F.when(F.coalesce(F.size(scope), F.lit(0)) > 0, F.concat(F.lit("范围:"), scoped)).otherwise(""), F.lit(" 时间:"), when)


def judge_frame(frame: Column, kind: Column, time: Column, evidence: Column) -> Column:
    """``frame [kind] (time) 证据“...”``; empty parts are left out."""
    some = lambda c: F.when(c != "", c)
    quotes = F.array_join(F.filter(evidence, lambda q: q != ""), "；")
    return F.concat_ws(" ", some(frame), F.concat(F.lit("["), some(kind), F.lit("]")), F.concat(F.lit("("), some(time), F.lit(")")), F.concat(F.lit("证据“"), some(quotes), F.lit("”")))


def canonical_map(m: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def number_of(s: Column) -> Column:
    """A number out of a money or percent string, null if it is none."""
    return F.regexp_replace(s, "[,元%]", "").try_cast("double")


def values_equal(a: Column, b: Column) -> Column:
    x, y = number_of(a), number_of(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(F.trim(a) == F.trim(b))


def loose_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", ""))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], exclude: str | None = None) -> Column:
    """Label of the first pattern that matches, null if none or if ``exclude`` does."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out if exclude is None else F.when(~text.rlike(exclude), out)


def only_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the only pattern that matches, null if none or several do."""
    hits = F.filter(F.array(*(F.when(text.rlike(p), F.lit(label)) for p, label in rules)), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, hits[0])


#: The words that tell what a question is after, in the order in which they are tried.
INTENTS = ((r"当时(系统)?(知道|了解|认为)|当时已知", "as_of"), (r"变化|变过|几次|历程|演化|历史|一路|以来|趋势|对比|比较|之前和现在|多少钱.*现在", "evolution"), (r"当前|现在|目前|最新|如今的?|现状", "current"))


def intent(query: Column) -> Column:
    """as_of, evolution, current or exploration, by the first group of words that occurs."""
    return F.coalesce(first_rule(query, INTENTS), F.lit("exploration"))


def as_list(x: Column) -> Column:
    """A null is an empty list, a scalar a list of one."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def shown(s: Column, length: int) -> Column:
    return F.substring(s, 1, length)


def event_card(kind: Column, actors: Column, objects: Column, action: Column, lower: Column, upper: Column, facts: Column, groups: Column, reports: Column) -> Column:
    """A card of labelled lines: at most four actors and objects and six facts, each sorted and once."""
    few = lambda a, n: F.array_join(F.slice(F.array_sort(F.array_distinct(a)), 1, n), "、")
    parts = [F.concat(F.lit("type: "), kind), F.concat(F.lit("actors: "), few(actors, 4)), F.concat(F.lit("objects: "), few(objects, 4)), F.concat(F.lit("action: "), action), F.concat(F.lit("time: "), F.coalesce(lower, F.lit("?")), F.lit("~"), F.coalesce(upper, F.lit("?"))), F.concat(F.lit("facts: "), few(facts, 6)), F.concat(F.lit("sources: "), groups.cast("string"), F.lit(" reports: "), reports.cast("string"))]
    return F.concat_ws("\n", *parts)
