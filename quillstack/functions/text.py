"""Text predicates and scalars. Lengths are code points; white space includes Unicode separators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

# Markers of generated tables of contents.
NOISE_WHOLE = ("[TOC]", "[TOC] [TOC]", "[目录]", "[[TOC]]")
NOISE_PARTS = ("[TOC]", "[toc]", "[目录]")

# Question prefixes dropped from titles, tried in this order.
QUESTION_PREFIXES = (
    "请(帮我?|你|问|告诉我|解释|介绍|描述|总结|概括|梳理|列举|列出|比较|分析|说明)",
    "(帮我|你来|麻烦你?|能不能|可以|可不可以|能否)(帮我?|你)?",
    "(如何|怎么|怎样|怎么样|为什么|什么是?|是什么|是谁|哪个|哪一[个种])",
    "((我想(知道|了解|问|要|看看|查|查询|搜索|找))|(我要(知道|了解|问|查|搜索)))",
    "(告诉我|解释一下|讲一下|说一下|描述一下|介绍一下)",
    "(请?)(搜索|查找|查询|帮我查|帮我搜索)",
    "(关于|对于|针对|有关)",
)
TITLE_END = "[？?！!。，,、；;：:….]+$"
TITLE_LENGTH = 18

# Media types by format.
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
LEGACY_PPT = "application/vnd.ms-powerpoint"
MARKDOWN = "text/markdown"
PLAIN = "text/plain"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False))


def first_nonempty(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def is_noise(text: Column) -> Column:
    """Blank, a table-of-contents marker, or nothing but such markers."""
    rest = reduce(lambda t, part: F.replace(t, F.lit(part), F.lit("")), NOISE_PARTS, text)
    whole = "|".join(f"\\Q{w}\\E" for w in NOISE_WHOLE)
    marked = text.rlike(rf"(?i)^[\s\p{{Z}}]*(?:{whole})[\s\p{{Z}}]*$") | is_blank(rest)
    # most texts end at the first test: they have no bracket
    return is_blank(text) | (F.contains(text, F.lit("[")) & marked)


def cut(text: Column, n: int, mark: str = "") -> Column:
    short = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(short, F.lit(mark))).otherwise(text) if mark else short


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot; empty without one, and for names that begin or end with their only dot."""
    last = F.regexp_extract(F.coalesce(filename, F.lit("")), "([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(last, r".(\.[^.]+)$", 1))


def safe_extension(filename: Column) -> Column:
    ext = extension(filename)
    sound = ext.rlike(r"^\.[\p{L}\p{N}]+$") & (F.length(ext) <= 16)
    return F.when(sound, ext).otherwise(".bin")


def document_format(filename: Column, content_type: Column) -> Column:
    """By media type or suffix, the first that fits of pdf, docx, pptx, markdown, txt; else null."""
    ext, kind = extension(filename), F.coalesce(content_type, F.lit(""))
    return (
        F.when((kind == PDF) | (ext == ".pdf"), "pdf")
        .when((kind == DOCX) | (ext == ".docx"), "docx")
        .when((kind == PPTX) | (ext == ".pptx"), "pptx")
        .when((kind == MARKDOWN) | ext.isin(".md", ".markdown"), "markdown")
        .when((kind == PLAIN) | (ext == ".txt"), "txt")
    )


def content_type_allowed(filename: Column, content_type: Column, allowed: list[str]) -> Column:
    """No type, a listed type, or the legacy presentation type for a .pptx name where presentations are listed."""
    kind = F.coalesce(content_type, F.lit(""))
    legacy = (kind == LEGACY_PPT) & (safe_extension(filename) == ".pptx") & F.lit(PPTX in allowed)
    return (kind == "") | kind.isin(*allowed) | legacy


def safe_path(key: Column) -> Column:
    """Whether a storage key stays below its root: not empty, not absolute, no ``..`` part, more than dots."""
    parts = F.filter(F.split(key, "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce((F.size(parts) > 0) & ~F.array_contains(parts, "..") & ~F.startswith(key, F.lit("/")), F.lit(False))


def title(message: Column) -> Column:
    """A title from a first message: white space folded, one question prefix and closing punctuation dropped, cut."""
    folded = strip(F.regexp_replace(message, r"[\s\p{Z}]+", " "))
    rest = F.coalesce(*[F.when(folded.rlike(f"^{p}"), strip(F.regexp_replace(folded, f"^{p}", ""))) for p in QUESTION_PREFIXES], folded)
    return cut(strip(F.regexp_replace(rest, TITLE_END, "")), TITLE_LENGTH, "…")


def file_size(n: Column) -> Column:
    tenth = lambda c, unit: F.concat(F.format_string("%.1f", c), F.lit(unit))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, tenth(n / 1024.0, " KB"))
        .when(n < 1024**3, tenth(n / 1024.0**2, " MB"))
        .otherwise(tenth(n / 1024.0**3, " GB"))
    )


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit(" s")))


def initials(name: Column) -> Column:
    return F.upper(F.substring(strip(name), 1, 2))


def utc_iso(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def csv_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def mask_password(url: Column) -> Column:
    return F.regexp_replace(url, r"(://[^:/@]+):[^@]+@", "$1:***@")
