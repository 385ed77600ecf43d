"""Text columns: codes, titles, keyword classes, event keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from barloom.functions.numeric import as_col, clip

# Title keywords per announcement class, first match wins in this order.
ANNOUNCEMENT_CLASSES = {
    "earnings": ("业绩", "预告", "快报", "年度报告", "季度报告", "半年报"),
    "holding": ("增持", "减持", "回购"),
    "inquiry": ("问询", "关注函", "监管函"),
    "risk": ("处罚", "立案", "诉讼", "仲裁", "违规"),
    "capital_action": ("重组", "并购", "收购", "定增", "非公开发行"),
    "dividend": ("分红", "权益分派", "利润分配"),
}
# Title keywords that make a news item major.
MAJOR_NEWS_WORDS = (
    "停牌", "复牌", "立案", "处罚", "减持", "增持", "回购", "重组",
    "并购", "收购", "重大合同", "中标", "业绩预告", "亏损", "暴雷",
    "退市", "风险警示", "澄清", "事故", "制裁",
)
# Punctuation ignored when names are compared.
NAME_NOISE = r"[\s`~!@#$%^&*()_+\-=\[\]{};:'\",.<>/?\\|，。！？、：；（）【】《》]+"


def pad_code(c: Column | str, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes stay whole (lpad alone would cut them)."""
    c = F.trim(as_col(c).cast("string"))
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def six_digits(c: Column | str, standalone: bool = False) -> Column:
    """First run of six digits, null if there is none. ``standalone`` refuses longer runs."""
    pattern = r"(?<!\d)(\d{6})(?!\d)" if standalone else r"(\d{6})"
    return F.nullif(F.regexp_extract(as_col(c).cast("string"), pattern, 1), F.lit(""))


def exchange(code: Column | str) -> Column:
    """sh / bj / sz from the first digit."""
    first = F.substring(as_col(code), 1, 1)
    return F.when(first.isin("6", "5"), "sh").when(first.isin("8", "4"), "bj").otherwise("sz")


def exchange_id(code: Column | str) -> Column:
    code = as_col(code)
    return F.concat_ws(".", code, F.upper(exchange(code)))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), r"\s+", " "))


def plain_text(c: Column | str, limit: int | None = 120) -> Column:
    """Markup removed, whitespace collapsed, cut to a display length."""
    text = squeeze(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"<[^>]+>", ""))
    return text if limit is None else F.substring(text, 1, limit)


def clean_title(c: Column | str, limit: int | None = None) -> Column:
    """Title with highlight tags removed; a limit is for display only."""
    title = squeeze(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"</?em>", ""))
    return title if limit is None else F.substring(title, 1, limit)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def comparable_name(c: Column | str) -> Column:
    """Name for matching: compatibility form, upper case, no markup, no punctuation. Unicode
    compatibility folding has no JVM-side function, so it is the one Python step here."""
    text = F.upper(_nfkc(F.coalesce(as_col(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), NAME_NOISE, "")


def keyword_class(title: Column | str, classes: dict[str, tuple[str, ...]] | None = None,
                  other: str = "other") -> Column:
    """First class with a keyword in the title."""
    title = F.coalesce(as_col(title), F.lit(""))
    chain = None
    for name, words in (classes or ANNOUNCEMENT_CLASSES).items():
        hit = title.rlike("|".join(words))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(other)


def is_major_news(title: Column | str, score: Column | str | None = None,
                  words: tuple[str, ...] = MAJOR_NEWS_WORDS, threshold: float = 0.8) -> Column:
    by_title = F.coalesce(as_col(title), F.lit("")).rlike("|".join(words))
    if score is None:
        return by_title
    return by_title | F.coalesce(F.abs(as_col(score)) >= threshold, F.lit(False))


def item_key(*parts: Column | str) -> Column:
    """md5 of the parts joined by a bar; missing parts count as empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts]))


def news_key(code: Column | str, ts: Column | str, title: Column | str) -> Column:
    return F.concat(F.lit("news:"), item_key(code, ts, title))


def last_number(line: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    """Last number in a line of free text, clamped; 0 when there is none."""
    line = as_col(line)
    found = F.regexp_extract_all(line, F.lit(r"(-?(?:\d+(?:\.\d+)?|\.\d+))"), 1)
    number = F.try_element_at(found, F.lit(-1)).try_cast("double")
    return clip(F.coalesce(F.trim(line).try_cast("double"), number, F.lit(0.0)), low, high)


def json_items(text: Column | str, n: int) -> Column:
    """First n strings of a JSON list; unreadable text gives an empty list."""
    items = F.from_json(as_col(text), ArrayType(StringType()))
    return F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n)
