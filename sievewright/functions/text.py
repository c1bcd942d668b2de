"""Tokens, negation cues and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
ENGLISH_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would "
    "shall should may might can could about above after again against all am and "
    "any at below between both but by down during each few for from further get "
    "got had has have he her here hers herself him himself his how i if in into "
    "is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own s same she so some such t "
    "than that the their theirs them themselves then there these they this those "
    "through to too under until up very we were what when where which while who "
    "whom why with you your yours yourself yourselves"
).split()
CHINESE_STOPWORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 "
    "看 好 自己 这 他 她 它 们 那 里 后 与 及 其 但 而 或 对 被 从 把 能 让 向 "
    "之 以 所 为 于 用 可 已 而且 然后 如果 因为 所以 但是 虽然 不过 还是 只是 "
    "这个 那个 什么 怎么 哪 多 少 大 小 中 更 最 该"
).split()
# Cues that a statement denies or contrasts.
NEGATORS = "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot shouldn't couldn't".split()
CONTRASTS = "however but contrary opposite disagree incorrect false wrong myth misconception debunk".split()
CHINESE_CUES = "不是 没有 不会 不能 并非 相反 错误 误解 否认 反驳 反对".split()
# Labels of credibility levels.
LABELS = {"HIGH": "高可信度", "MEDIUM": "中等可信度", "LOW": "低可信度"}
UNKNOWN_LABEL = "未知"

LATIN, HAN = r"[a-zA-Z]{2,}", r"[\x{4e00}-\x{9fff}]"
STOPWORDS = sorted({*ENGLISH_STOPWORDS, *CHINESE_STOPWORDS})


def whole_word(words: list[str]) -> str:
    """A pattern for any of the words with no letter, digit or underscore around, in Java and RE2 alike."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)"


NEGATION = (whole_word(NEGATORS), whole_word(CONTRASTS), "(" + "|".join(CHINESE_CUES) + ")")


def tokens(text: Column) -> Column:
    """Latin words of two letters and more, lower-cased, then single Han characters."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(LATIN), F.lit(0)), lambda x: F.lower(x))
    return F.concat(latin, F.regexp_extract_all(text, F.lit(HAN), F.lit(0)))


def filtered_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


def has_negation(text: Column) -> Column:
    found = F.lit(False)
    for pattern in NEGATION:
        found |= text.rlike(pattern)
    return found


def shorten(text: Column, n: int, more: str = "") -> Column:
    """The first n code points, with `more` behind if any are left."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def credibility_label(level: Column) -> Column:
    out = F.lit(UNKNOWN_LABEL)
    for name, label in LABELS.items():
        out = F.when(level == name, label).otherwise(out)
    return out


def anchor(heading: Column) -> Column:
    return F.replace(heading, F.lit(" "), F.lit("-"))


def next_patch(version: Column) -> Column:
    """The version with its last dotted part one higher; null counts as 0.0.0."""
    parts = F.split(F.coalesce(version, F.lit("0.0.0")), r"\.")
    last = F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(0)) + 1
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last.cast("string"))), ".")
