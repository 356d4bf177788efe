"""Column expressions over text: all are evaluated in the JVM, none calls Python."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the legal domain that results depend on.
CAUSES = ("租賃", "租金", "押租金", "房屋", "不動產買賣", "買賣價金", "返還租賃", "瑕疵擔保", "所有權移轉", "解除契約", "返還押租")
CAUSE_GROUPS = (
    ("押金返還與時效", ("押租金", "押金")), ("物之瑕疵擔保", ("瑕疵",)), ("契約解除", ("解除",)), ("買賣價金(含分期)", ("買賣價金", "分期", "價金", "買賣")),
    ("不動產所有權移轉", ("所有權移轉", "移轉登記", "塗銷")), ("租賃終止/遷讓返還", ("遷讓", "返還租賃", "返還房屋", "返還租賃物", "交還房屋", "返還房地")), ("租金給付", ("租金",)),
)
OTHER_GROUP = "其他(租賃/買賣相關)"
RISK_SIGNALS = (
    ("high", ("顯失公平", "無效", "不得記載", "違反強制", "違反強行", "牴觸", "排除擔保")),
    ("medium", ("酌減", "酌定", "催告", "審閱期", "過高", "減少價金", "得解除", "瑕疵擔保")),
    ("low", ("預告", "償還", "改良費")),
)
CLAUSE_MARKERS = ("系爭契約", "系爭租賃", "系爭買賣", "系爭條款", "兩造約定", "契約約定", "定型化", "約定")
LAWS = ("民法總則施行法", "民法債編施行法", "民法物權編施行法", "民事訴訟法施行法", "民事訴訟法", "消費者保護法", "民法")
BOILERPLATE_NUMBERS = (*range(1, 16), *range(75, 86))
PII = ((r"[A-Z][12][0-9]{8}", "[身分證]"), (r"09[0-9]{2}[-\s]?[0-9]{3}[-\s]?[0-9]{3}", "[手機]"), (r"0[0-9]{1,2}[-\s]?[0-9]{6,8}", "[電話]"))

NUMERAL = "[一二三四五六七八九十百千零〇○0-9０-９]+"
#: A reference to an article: law (may be missing), number, sub-number before or after the word for article.
ARTICLE = f"({'|'.join(LAWS)})?[ 　]*第[ 　]*({NUMERAL})[ 　]*(?:[-之－][ 　]*({NUMERAL}))?[ 　]*條(?:[ 　]*之[ 　]*({NUMERAL}))?"
CLAUSE_LABEL = "第[ 　]*[一二三四五六七八九十百千零〇○0-9]+[ 　]*條(?:[ 　]*之[ 　]*[一二三四五六七八九十0-9]+)?"
SPACE = r"[\s　  -     \x0b\x1c-\x1f\x85]"


def clean(c: Column) -> Column:
    """White space runs to one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip(c: Column) -> Column:
    """No white space at the ends. One parameter only: transform() would give a second one the index."""
    return strip_of(SPACE, c)


def strip_of(chars: str, c: Column) -> Column:
    return F.regexp_replace(c, f"^{chars}+|{chars}+$", "")


def layout(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more line breaks to two, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def mask_pii(c: Column) -> Column:
    """National ids, mobile and landline numbers masked, in this order."""
    for pattern, mask in PII:
        c = F.regexp_replace(c, pattern, mask)
    return c


def date(c: Column) -> Column:
    """YYYY-MM-DD of seven digits (years of the republic) or eight, `/` and `.` as `-`; others as they are, null as ''."""
    s = F.trim(F.translate(F.coalesce(c, F.lit("")), "/.", "--"))
    dashed = lambda y, at: F.concat_ws("-", y, F.substring(s, at, 2), F.substring(s, at + 2, 2))
    year = F.lpad((F.substring(s, 1, 3).try_cast("int") + 1911).cast("string"), 4, "0")
    return F.when(s.rlike("^[0-9]{7}$"), dashed(year, 4)).when(s.rlike("^[0-9]{8}$"), dashed(F.substring(s, 1, 4), 5)).otherwise(s)


def month(c: Column) -> Column:
    """YYYY-MM of a date in any of the forms of `date`, else `unknown`."""
    d = date(c)
    return F.when(d.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.substring(d, 1, 7)).otherwise(F.lit("unknown"))


def contains_any(c: Column, words) -> Column:
    """Whether one of the words occurs: one alternation, so the text is read once."""
    return F.coalesce(c.rlike("|".join(words)), F.lit(False))


def first_group(c: Column, groups, other: str) -> Column:
    """Name of the first group of (name, words) with a word in the text."""
    out = None
    for name, words in groups:
        hit = contains_any(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def sentences(c: Column, marks: str = "。！？") -> Column:
    """Sentences with their end marks; blank ones left out."""
    return F.filter(F.split(c, f"(?<=[{marks}])"), lambda s: F.trim(s) != "")


def packed(parts: Column, limit: int) -> Column:
    """Greedy packing of consecutive parts into strings of at most `limit` characters; a longer part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(state, part):
        full = (F.length(state["buf"]) + F.length(part) > limit) & (state["buf"] != "")
        return F.struct(F.when(full, F.concat(state["out"], F.array(state["buf"]))).otherwise(state["out"]).alias("out"), F.when(full, part).otherwise(F.concat(state["buf"], part)).alias("buf"))

    return F.aggregate(parts, start, add, lambda s: F.filter(F.transform(F.concat(s["out"], F.array(s["buf"])), strip), lambda x: x != ""))


def section_chunks(c: Column, limit: int = 800) -> Column:
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(packed(sentences(c), limit))


def numeral(c: Column) -> Column:
    """Digits of a numeral in Arabic, full-width, positional (四二五) or unit notation (四百二十五); leading zeros dropped."""
    d = F.translate(c, "〇○零一二三四五六七八九０１２３４５６７８９", "0001234567890123456789")
    units = F.aggregate(
        F.filter(F.split(d, ""), lambda x: x != ""),
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("now")),
        lambda s, x: F.when(
            x.isin("十", "百", "千"),
            F.struct((s["total"] + F.when(s["now"] < 0, 1).otherwise(s["now"]) * F.when(x == "十", 10).when(x == "百", 100).otherwise(1000)).cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("now")),
        ).otherwise(F.struct(s["total"].alias("total"), x.try_cast("bigint").alias("now"))),
        lambda s: s["total"] + F.greatest(s["now"], F.lit(0)),
    )
    return F.when(d.rlike("^[0-9]+$"), F.regexp_replace(d, "^0+(?=[0-9])", "")).when(d.rlike("^[0-9十百千]+$"), units.cast("string"))


def article_list(c: Column, default_law: str | None = None) -> Column:
    """Canonical articles `law第N[-M]條` in order of first occurrence; references without a law are left out, or get `default_law`."""
    group = lambda i: F.regexp_extract_all(c, F.lit(ARTICLE), F.lit(i))
    found = F.arrays_zip(group(1).alias("law"), group(2).alias("n"), group(3).alias("m"), group(4).alias("k"))

    def canonical(x):
        law = F.when(x["law"] != "", x["law"]).otherwise(F.lit(default_law))
        sub = first_nonempty(x["m"], x["k"])
        return F.concat(law, F.lit("第"), numeral(x["n"]), F.coalesce(F.concat(F.lit("-"), numeral(sub)), F.lit("")), F.lit("條"))

    return F.array_distinct(F.filter(F.transform(found, canonical), lambda x: x.isNotNull()))


def article_key(canonical: Column) -> Column:
    """`law__第_N_條`, the id form, of a canonical article."""
    return F.regexp_replace(canonical, "^(.*)第([0-9-]+)條$", "$1__第_$2_條")


def is_boilerplate(canonical: Column) -> Column:
    """Articles 1 to 15 and 75 to 85 of the civil code, which every judgement cites."""
    return canonical.isin(*(f"民法第{n}條" for n in BOILERPLATE_NUMBERS))


_HEADERS = (("主文", r"主\s*文"), ("事實", r"事\s*實(?:及理由)?"), ("理由", r"(?:理\s*由|得心證之理由)"))


def sections(c: Column) -> Column:
    """[(label, body)] of a judgement's sections by the first place of each header; the whole text where there is none."""
    starts = F.array(*(F.struct((F.length(F.regexp_extract(c, f"(?s)^(.*?){p}", 1)) + 1).alias("at"), c.rlike(p).alias("there"), F.lit(name).alias("label")) for name, p in _HEADERS))
    found = F.array_sort(F.filter(starts, lambda s: s["there"]))
    bodies = F.transform(found, lambda s, i: F.struct(s["label"].alias("label"), clean(F.substring(c, s["at"], F.coalesce(F.get(found, i + 1)["at"], F.length(c) + 1) - s["at"])).alias("body")))
    return F.when(F.size(found) == 0, F.array(F.struct(F.lit("全文").alias("label"), clean(c).alias("body")))).otherwise(bodies)


def clauses(c: Column, least: int = 10) -> Column:
    """[(label, body, at)] of the clauses of a contract by their labels; bodies shorter than `least` are dropped; `at` counts from 0."""
    t = layout(c)
    labels = F.regexp_extract_all(t, F.lit(f"({CLAUSE_LABEL})"), F.lit(1))
    parts = F.split(t, f"(?={CLAUSE_LABEL})")
    # a part of the split that begins with a label is a clause; the preamble before the first one isn't
    ends = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x))).alias("at")))
    own = F.filter(ends, lambda x: x["p"].rlike(f"^{CLAUSE_LABEL}"))
    made = F.transform(F.arrays_zip(own.alias("o"), labels.alias("label")), lambda x: F.struct(x["label"].alias("label"), strip_of("[ \n　：:]", F.substring(x["o"]["p"], F.length(x["label"]) + 1, F.length(x["o"]["p"]))).alias("body"), x["o"]["at"].alias("at")))
    return F.filter(made, lambda x: F.length(x["body"]) >= least)


def paragraphs(c: Column, limit: int = 600) -> Column:
    """Paragraphs split at blank lines, long ones packed by sentence; blank ones left out."""
    parts = F.filter(F.transform(F.split(layout(c), "\n\n"), strip), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > limit, packed(sentences(p, "。！？!?."), limit)).otherwise(F.array(p))))


def robust_json(c: Column, schema: str) -> Column:
    """A struct of the text's JSON, else of what lies between its first `{` and last `}`; null if neither parses."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = lambda x: F.from_json(x, f"{schema}, _bad string", options)
    direct, inner = read(c), read(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.when(c.isNull(), None).when(direct["_bad"].isNull() & F.trim(c).startswith("{"), direct).when(inner["_bad"].isNull() & c.rlike(r"(?s)\{.*\}"), inner)


def bigrams_and_words(c: Column) -> Column:
    """Tokens for keyword search, in no order: words of letters and digits, pairs of neighbouring ideographs, ideographs that stand alone."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = F.regexp_extract_all(low, F.lit("(?=([一-鿿]{2}))"), F.lit(1))
    alone = F.regexp_extract_all(low, F.lit("(?<![一-鿿])([一-鿿])(?![一-鿿])"), F.lit(1))
    return F.concat(words, pairs, alone)


def kappa_level(k: Column) -> Column:
    """Landis and Koch's words for a kappa."""
    return F.when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{SPACE}+", "")


def digits_only(c: Column) -> Column:
    """Digits and hyphens of an article number."""
    return F.regexp_replace(c, "[^0-9-]", "")


def short_label(canonical: Column) -> Column:
    """民425-1 and 消保11 for articles of the two main statutes; others lose only the words around the number."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(canonical, "^民法第", "民"), "^消費者保護法第", "消保"), "條$", "")


def number_label(canonical: Column) -> Column:
    """429 and 消11-1: the number alone, with a mark for the consumer protection act."""
    number = F.regexp_replace(F.regexp_replace(canonical, "民法第|消費者保護法第", ""), "條$", "")
    return F.when(canonical.startswith("消費者保護法第"), F.concat(F.lit("消"), number)).otherwise(number)


def repro_key(canonical: Column) -> Column:
    """民法247-1 and 消保法11: the form two sets of articles are compared in; other statutes stay."""
    return F.regexp_replace(F.regexp_replace(canonical, "^消費者保護法第(.*)條$", "消保法$1"), "^民法第(.*)條$", "民法$1")


def bare_number(canonical: Column) -> Column:
    """`N` or `N-M` of a canonical article, '' without."""
    return F.regexp_extract(canonical, "第([0-9-]+)條$", 1)


def first_rule(c: Column, rules) -> Column:
    """Name of the first of (words, name) rules of which the text holds a word; '' for none, null for null."""
    out = F.when(c.isNull(), None)
    for words, name in rules:
        out = out.when(c.rlike("|".join(words)), name)
    return out.otherwise("")


def quantity(c: Column, before: str, unit: str) -> Column:
    """The first number in digits between a term and a unit (patterns), null without."""
    found = F.regexp_extract(c, f"{before}([0-9]{{1,9}}){unit}", 1)
    return F.when(found != "", found.cast("int"))


def alias_law(c: Column) -> Column:
    """The usual short name of the consumer protection act written out."""
    return F.regexp_replace(c, "消保法", "消費者保護法")


def reason(anchor: Column, candidate: Column, weight: Column) -> Column:
    """Sentence that says why an article is suggested."""
    return F.format_string("%s is cited together with %s in %d cases", candidate, anchor, weight)


def binary(c: Column, positive: tuple[str, ...]) -> Column:
    """1 where the cleaned label is one of the positive ones, 0 for other labels, null for blanks."""
    label = F.lower(F.regexp_replace(c, r"^[\s.]+|[\s.]+$", ""))
    return F.when(label != "", label.isin(*positive).cast("int"))


def widen_marks(c: Column) -> Column:
    """Half-width marks between ideographs as full-width ones; code spans in backticks and formulas in $ stay."""
    pairs = {",": "，", ";": "；", ":": "：", "?": "？", "!": "！"}
    keep = "(?:`[^`]*`|\\$[^$]*\\$)"
    for half, full in pairs.items():
        h = "\\" + half
        c = F.regexp_replace(c, f"({keep})|(?<=[一-鿿])[ ]*{h}[ ]*(?=[一-鿿])", f"$1\u0001{half}")
        # a protected span was matched whole: put nothing after it; a mark was matched: put the wide one
        c = F.regexp_replace(F.regexp_replace(c, f"(`|\\$)\u0001{h}", "$1"), f"\u0001{h}", full)
    return c


# Ideographs and full-width marks, next to which half-width marks are widened.
_WIDE = "㐀-鿿豈-\ufaff\u3000-〿\uff00-\uffef"


def _styled_line(line: Column) -> Column:
    pieces = F.regexp_extract_all(line, F.lit("(`[^`]*`|\\$[^$]*\\$|[^`$]+|[`$])"), F.lit(1))

    def styled(piece):
        bare = F.replace(piece, F.lit("**"), F.lit(""))
        marked = F.regexp_replace(bare, f"(?<=[{_WIDE}])([,;:])|([,;:])(?=[{_WIDE}])", "\u0001$1$2")
        for half, full in ((",", "，"), (";", "；"), (":", "：")):
            marked = F.replace(marked, F.lit("\u0001" + half), F.lit(full))
        return F.when(piece.rlike(r"(?s)^(`.*`|\$.*\$)$"), piece).otherwise(marked)

    return F.array_join(F.transform(pieces, styled), "")


def styled(c: Column) -> Column:
    """Text without bold marks and with full-width commas, semicolons and colons next to ideographs; code spans, formulas and fenced code stay."""
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def add(state, line):
        fence = F.ltrim(line).startswith("```")
        return F.struct((state["code"] != fence).alias("code"), F.concat(state["out"], F.array(F.when(fence | state["code"], line).otherwise(_styled_line(line)))).alias("out"))

    return F.aggregate(F.split(c, "\n"), start, add, lambda state: F.array_join(state["out"], "\n"))
