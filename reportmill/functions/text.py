"""Text cleanup as column expressions. (?U) classes are Unicode, (?d) ends lines at line feeds only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and patterns that decide what the cleaned text is.
TRUNCATED = "[… truncated]"
IMAGE = "[image]"
CODE_LINES = 5
MEDIA_EXTENSIONS = "png|jpe?g|gif|bmp|svg|webp|mp4|mov|webm|avi"
COMMENT = r"(?s)<!--.*?-->"
STRUCK = r"(?s)~~(?:(?!\n[ \t]*\n).)+?~~"
TAGS = r"^\s*(?:\[[^\]]*\]\s*)+"
MEDIA = (
    r"(?i)!\[[^\]]*\]\([^)\s]*\)(?:\{[^}\n]*\})?|<img\b[^>]*>|https://github\.com/user-attachments/assets/[\w-]+"
    rf"|!(?:https?://[^!\s]+|(?=[^!\s])[^!\n]*?\.(?:{MEDIA_EXTENSIONS})(?:\?[^!|\n]*)?)(?:\|[^!\n]*)?!|\[\^[^\]\n]+\]"
)
URL = r"<?https?://([^/\s<>\"'()]+)(?:[^\s<>\"']*[^\s<>\"'.,;:!?)\]])?>?"


def line_feeds(c: Column) -> Column:
    """Null is empty, carriage returns are line feeds."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def without_comments(c: Column) -> Column:
    """P3."""
    return F.regexp_replace(c, COMMENT, "")


def without_struck(c: Column) -> Column:
    """May wrap lines, never crosses a blank one."""
    return F.regexp_replace(c, STRUCK, "")


def without_tags(summary: Column) -> Column:
    """P5: leading [Tag] groups go; a ``Word:`` stays."""
    return trimmed(F.regexp_replace(F.coalesce(summary, F.lit("")), TAGS, ""))


def media_marked(c: Column) -> Column:
    """One pass for every form of an attachment."""
    return F.regexp_replace(c, MEDIA, IMAGE)


def links_marked(c: Column) -> Column:
    """A link keeps its label and host; a label that is a URL counts once."""
    own = F.regexp_replace(c, r"\[(https?://[^\]\n]+)\]\((https?://[^)\s]+)\)", "$2")
    labelled = F.regexp_replace(own, r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", "$1 $2")
    return F.regexp_replace(labelled, URL, "[link: $1]")


def fences_cut(c: Column) -> Column:
    """A fence of more than five lines keeps five and a mark. Marks around the rest tell short fences apart."""
    line, close = r"[^\n]*\n", r"[ \t]*```[ \t]*$"
    short = rf"((?:^[ \t]*```[^`\n]*\n)(?:{line}){{0,{CODE_LINES}}}?{close})"
    long = rf"(^[ \t]*```[^`\n]*\n(?:{line}){{{CODE_LINES}}})(?s:(.+?))(\n{close})"
    marked = F.regexp_replace(c, rf"(?dm){short}|{long}", "$1$2\u0001$3\u0002$4")
    return F.regexp_replace(F.regexp_replace(marked, "\u0001\u0002", ""), "(?s)\u0001.+?\u0002", TRUNCATED)


def blank_lines_joined(c: Column) -> Column:
    """At most one blank line, none at the ends."""
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def without_skipped_answers(c: Column) -> Column:
    """A line that is only an issue form's mark for no answer is emptied."""
    return F.regexp_replace(c, r"(?dm)^_No response_[ \t]*$", "")
