"""Rules over labels, URIs, model responses and texts, as Spark columns. All are null-safe: null in, null (or the stated default) out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


#: Digits of any script, superscript and circled ones alone too; or such numbers joined by points.
NUMBER = r"^(\p{Nd}+(\.\p{Nd}+)+|[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]+)$"


def any_contains(label: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in words], F.lit(False))


def is_valid_point(label: Column, labels=rules.NON_POINT_LABELS, prefixes=rules.NON_POINT_PREFIXES) -> Column:
    """neither blank, a listed label, a listed prefix, an example ("例3"), a chapter, a section number
    ("1.2.3") nor digits alone."""
    t = F.trim(label)
    bad = t.isin(*labels) | reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in prefixes], F.lit(False))
    return F.coalesce((t != "") & ~bad & ~t.rlike(r"^例[0-9]") & ~t.rlike(r"^第[一二三四五六七八九十0-9]+章") & ~t.rlike(NUMBER), F.lit(False))


def clean_section(label: Column) -> Column:
    """struct(label, order_in_book): number prefix taken off, one trailing colon and runs of white space deleted, full width to half."""
    prefix = r"^([0-9]+(?:\.[0-9]+){0,2})-(.+)$"
    order = F.regexp_extract(label, prefix, 1)
    t = F.when(order != "", F.regexp_extract(label, prefix, 2)).otherwise(label)
    t = F.regexp_replace(F.regexp_replace(t, r"[:：]$", ""), r"(^\s+)|(\s+$)|(\s{2,})", "")
    t = F.trim(F.translate(t, "０１２３４５６７８９　", "0123456789 "))
    return F.struct(t.alias("label"), F.when(order != "", order).alias("order_in_book"))


def has_suffix(label: Column, suffixes=rules.GENERIC_SUFFIXES) -> Column:
    """the label ends in one of the generic suffixes."""
    return reduce(lambda a, b: a | b, [F.endswith(label, F.lit(s)) for s in suffixes], F.lit(False))


def quality_issues(label: Column) -> Column:
    """array of the issues of a label, in order."""
    found = [(label.rlike("[０-９　]"), "full_width"), (label.rlike(r"\s{2,}"), "extra_space"), (label.rlike(r"\s$"), "trailing_space")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in found]))


def first_keyword(label: Column, groups: Mapping[str, Iterable[str]], default: str) -> Column:
    """the first group, in order, one of whose words the label contains."""
    out = None
    for name, words in groups.items():
        hit = any_contains(label, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def difficulty(label: Column, grade: Column, base: Mapping[str, int] = rules.GRADE_DIFFICULTY, harder=rules.HARDER, easier=rules.EASIER, default: int = 3) -> Column:
    """F8: base of the grade plus one per harder word, less one per easier word, within 1..5."""
    start = F.coalesce(F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[grade], F.lit(default)) if base else F.lit(default)
    hits = lambda words: reduce(lambda a, b: a + b, [F.coalesce(F.contains(label, F.lit(w)).cast("int"), F.lit(0)) for w in words], F.lit(0))
    return F.greatest(F.lit(1), F.least(F.lit(5), start + hits(harder) - hits(easier)))


def subject_of_uri(uri: Column) -> Column:
    """the part after ``instance/``; ``unknown`` if there is none."""
    s = F.regexp_extract(uri, r"instance/([^/#]+)[/#]", 1)
    return F.when(s == "", "unknown").otherwise(F.coalesce(s, F.lit("unknown")))


def normal_label(label: Column) -> Column:
    """trimmed, lower case, without half and full spaces, brackets of one form; null gives ''."""
    return F.coalesce(F.translate(F.lower(F.trim(label)), "（）【】 　", "()[]"), F.lit(""))


def uri_parts(uri: Column) -> Column:
    """struct(domain, suffix, name): host, what follows it, and the last path part up to a hyphen."""
    return F.struct(
        F.regexp_extract(uri, "://([^/]+)/", 1).alias("domain"),
        F.regexp_extract(uri, "://[^/]+/(.*)", 1).alias("suffix"),
        F.element_at(F.split(F.element_at(F.split(uri, "/"), -1), "-"), 1).alias("name"),
    )


def is_entity(node: Column, prefixes: Iterable[str], names: Iterable[str] = ()) -> Column:
    """one of ``names``, or it starts with one of ``prefixes``."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(node, F.lit(p)) for p in prefixes], node.isin(*names) if names else F.lit(False)), F.lit(False))


def without_punctuation(text: Column) -> Column:
    """F16: ASCII and CJK punctuation removed."""
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~，。、；：？！“”‘’（）《》【】…—·]+", "")


def uri_safe(label: Column) -> Column:
    """spaces, commas, colons and slashes become _, brackets, quotes and line ends go, outer _ go."""
    t = F.translate(F.translate(label, " ，、：:/\\", "_______"), "()（）\"'\n\r", "")
    return F.regexp_replace(t, "^_+|_+$", "")


def coded(value: Column, codes: Mapping[str, str]) -> Column:
    """the code of a value, or the value itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[value], value)


def textbook_id(publisher: Column, grade: Column, semester: Column) -> Column:
    """{publisher}-{grade}{semester}."""
    return F.concat(coded(publisher, rules.PUBLISHER_CODES), F.lit("-"), coded(grade, rules.GRADE_CODES), F.coalesce(coded(semester, rules.SEMESTER_CODES), F.lit("")))


def child_id(parent: Column, order: Column) -> Column:
    """{parent}-{order}, for chapters and sections alike."""
    return F.concat_ws("-", parent, order.cast("string"))


def point_uri(prefix: str, stage: Column, seq: Column) -> Column:
    """the point's URI, with a sequence number of five digits."""
    return F.concat(F.lit(f"{prefix}#textbook-"), stage, F.lit("-"), F.lpad(seq.cast("string"), 5, "0"))


def parse_textbook_id(tb: Column) -> Column:
    """struct(publisher, grade, semester) back from an id."""
    body = r"^(.+)-((?:g[0-9])|(?:bixiu[0-9]))([sx]?)$"
    return F.struct(*[F.regexp_extract(tb, body, k + 1).alias(n) for k, n in enumerate(("publisher", "grade", "semester"))])


def is_core_concept(label: Column, words=rules.NON_CORE_WORDS, least: int = 1, most: int = 20) -> Column:
    """none of the words, and a length within the bounds."""
    return F.coalesce(~any_contains(label, words) & F.char_length(label).between(least, most), F.lit(False))


def confidence(value: Column) -> Column:
    """a number as it is, high/medium/low as 0.9/0.6/0.3, anything else 0.5."""
    named = F.create_map(*[F.lit(x) for kv in {"high": 0.9, "medium": 0.6, "low": 0.3}.items() for x in kv])
    return F.coalesce(value.try_cast("double"), named[F.lower(F.trim(value))], F.lit(0.5))


def tolerant_json(content: Column, schema: str) -> Column:
    """the whole text, else the first flat {...}, else what a fence holds, else single quotes turned to double ones."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    flat = F.regexp_extract(content, r"(?s)(\{[^{}]*\})", 1)
    swapped = F.translate(flat, "'", '"')
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{"), F.from_json(c, schema))
    return F.coalesce(ok(F.trim(content)), ok(flat), ok(F.trim(fenced)), ok(swapped))


def short_hash(text: Column, n: int = 16) -> Column:
    """the first digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def dataset_checksum(*cols: Column) -> Column:
    """an aggregate over rows that no order changes."""
    return F.bit_xor(F.xxhash64(*cols))


def band(conf: Column, limits: Mapping[str, float], otherwise: str) -> Column:
    """the first band whose limit the confidence reaches."""
    out = None
    for name, least in limits.items():
        out = F.when(conf >= least, name) if out is None else out.when(conf >= least, name)
    return out.otherwise(otherwise)


def school_stage(title: Column) -> Column:
    """stage words first, then the number before 年级; null if neither is there."""
    low = F.lower(title)
    return (
        F.when(title.contains("小学") | low.contains("primary"), "primary")
        .when(title.contains("初中") | low.contains("middle"), "middle")
        .when(title.contains("高中") | low.contains("high") | title.contains("必修") | title.contains("选修"), "high")
        .when(title.rlike("[一二三四五六]年级"), "primary")
        .when(title.rlike("[七八九]年级"), "middle")
    )


def grade_of_url(url: Column) -> Column:
    """struct(stage, grade, semester) from the number of a page's name (19-30 primary, 31-36 middle)."""
    n = F.regexp_extract(url, r"/([0-9]+)\.html", 1).try_cast("int")
    primary, middle = n.between(19, 30), n.between(31, 36)
    k = F.when(primary, n - 19).when(middle, n - 31)
    return F.struct(
        F.when(primary, "primary").when(middle, "middle").alias("stage"),
        F.when(k.isNotNull(), F.concat((F.floor(k / 2) + F.when(primary, 1).otherwise(7)).cast("string"), F.lit("年级"))).alias("grade"),
        F.when(k % 2 == 0, "上册").when(k % 2 == 1, "下册").alias("semester"),
    )


def heading_kind(text: Column) -> Column:
    """chapter ("第N章", "N." not followed by a digit), subsection ("N.N"), else other."""
    return F.when(text.rlike(r"^第[一二三四五六七八九十0-9]+章"), "chapter").when(text.rlike(r"^[0-9]+\.[0-9]+"), "subsection").when(text.rlike(r"^[0-9]+[.、\s　][^0-9]"), "chapter").otherwise("other")


def heading_name(text: Column) -> Column:
    """the heading without its number."""
    a = F.regexp_extract(text, r"^第[一二三四五六七八九十0-9]+章\s*(.+)$", 1)
    b = F.regexp_extract(text, r"^[0-9]+[.、\s　](.+)$", 1)
    return F.trim(F.when(a != "", a).when(b != "", b).otherwise(text))


def spans(text: Column) -> Column:
    """F32: the text cut at 。，. and line ends, blanks left out."""
    return F.filter(F.transform(F.split(text, "[。，.\n]"), lambda x: F.trim(x)), lambda x: x != "")


def char_overlap(a: Column, b: Column) -> Column:
    """Distinct characters of ``a`` that ``b`` has too, over those of ``a``."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.size(F.array_intersect(chars(a), chars(b))) / F.size(chars(a))


def version_tag(uri: Column, marks: Mapping[str, str], default: str = "none") -> Column:
    """the first version, in order, whose mark the URI contains."""
    return first_keyword(uri, {version: [mark] for version, mark in marks.items()}, default)


def alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)
