"""Text expressions: all are columns on columns, inside Spark's own functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, longest first: CR LF, then any of the single line-breaking characters.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Characters that fold to ASCII letters under compatibility decomposition.
_FOLDED = {c: d for c in map(chr, range(0xA0, 0x250)) if len(d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
_DROPPED = "".join(c for c in map(chr, range(0xA0, 0x250)) if c not in _FOLDED and not unicodedata.normalize("NFKD", c).encode("ascii", "ignore"))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line; an empty text is one empty line."""
    parts = F.split(text, LINE_END)
    n = F.size(parts)
    return F.when((n > 1) & (F.get(parts, n - 1) == ""), F.slice(parts, 1, F.greatest(n - 1, F.lit(1)))).otherwise(parts)


def normalize_text(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def clean_snippet(s: Column) -> Column:
    """Without the "12: " that numbers a line, and without space around it all."""
    return F.regexp_replace(F.array_join(F.transform(split_lines(s), lambda x: F.regexp_replace(x, r"^\s*\d+:\s*", "")), "\n"), r"(?U)^\s+|\s+$", "")


def number_lines(s: Column) -> Column:
    return F.array_join(F.transform(split_lines(s), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def slugify(s: Column) -> Column:
    """ASCII letters, digits, _ and single hyphens, in lower case. Accents of Latin letters are folded away; other characters go."""
    out = F.translate(s, "".join(_FOLDED), "".join(_FOLDED.values()))
    out = F.regexp_replace(F.regexp_replace(out, r"[^\x00-\x7F]", ""), r"[^\w\s-]", "")
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))), r"[-\s]+", "-")


def slug(s: str) -> str:
    """The same on the driver."""
    s = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
    return re.sub(r"[-\s]+", "-", s.strip().lower())


def clean_text(s: Column) -> Column:
    """Without [n] references, spaces collapsed, first letter upper and the rest lower."""
    out = normalize_text(F.regexp_replace(s, r"\[\d+\]", ""))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substring(out, 2, 2147483646)))


def title_and_description(s: Column) -> tuple[Column, Column]:
    """The two sides of the first hyphen or dash with spaces around it; without one, all is title."""
    parts = F.split(s, r"\s+[-–—]\s+", 2)
    return clean_text(F.get(parts, F.lit(0))), F.when(F.size(parts) > 1, clean_text(F.get(parts, F.lit(1)))).otherwise("")


def is_space_token(token: Column) -> Column:
    """Empty once every word-start mark is taken out."""
    return F.replace(token, F.lit("▁"), F.lit("")) == ""


def token_id(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(50000))


def last_element(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def char_to_byte(text: Column, chars: Column) -> Column:
    """Bytes of UTF-8 in the first `chars` characters."""
    return F.octet_length(F.left(text, chars))


def word_place(text: Column, word: Column) -> Column:
    """Place of the first whole-word occurrence, from 0, in characters; null if none. Letters and digits of any script and _ make up words."""
    parts = F.split(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])")), 2)
    return F.when(F.size(parts) == 2, F.length(F.get(parts, F.lit(0))))


def code_place(line: Column, code: Column) -> tuple[Column, Column]:
    """Place and length of the trimmed first line of code in line; else those of its first word as a whole word; nulls if neither is there or code is blank."""
    first = F.trim(F.get(F.split(F.trim(code), "\n"), F.lit(0)))
    word = F.nullif(F.regexp_extract(first, r"[A-Za-z_]\w*", 0), F.lit(""))
    at = F.call_function("instr", line, first)
    whole = (first != "") & (at > 0)
    by_word = word_place(line, word)
    return F.when(whole, at - 1).otherwise(by_word), F.when(whole, F.length(first)).when(by_word.isNotNull(), F.length(word))


def json_object(s: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.regexp_substr(s, F.lit(r"(?s)\{.*\}"))


def filled(*values: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def normalize_label(a, concept: Column | None = None):
    """A label struct (category, label, label_type, confidence, evidence) from a model's answer a (pattern, idiom, paradigm, label, category, confidence, evidence).

    The label is the first of pattern, idiom, paradigm, label that isn't empty; its type goes by which of these the answer has at all.
    """
    kind = F.when(a["pattern"].isNotNull(), "pattern").when(a["idiom"].isNotNull(), "idiom").when(a["paradigm"].isNotNull(), "paradigm").otherwise("label")
    return F.struct(
        F.coalesce(a["category"], *([concept] if concept is not None else [])).alias("category"), filled(a["pattern"], a["idiom"], a["paradigm"], a["label"]).alias("label"), kind.alias("label_type"),
        F.coalesce(a["confidence"], F.lit("low")).alias("confidence"), F.coalesce(a["evidence"], F.lit("")).alias("evidence"),
    )


def normalize_label_kept(a):
    """As normalize_label(), for annotations read back: the label may also stand under concept, a label_type is kept, and nothing gets a default."""
    kind = F.when(a["pattern"].isNotNull(), "pattern").when(a["idiom"].isNotNull(), "idiom").when(a["paradigm"].isNotNull(), "paradigm").otherwise("label")
    return F.struct(
        a["category"].alias("category"), filled(a["label"], a["pattern"], a["idiom"], a["paradigm"], a["concept"]).alias("label"), F.coalesce(a["label_type"], kind).alias("label_type"),
        a["confidence"].alias("confidence"), a["evidence"].alias("evidence"),
    )


def chat_messages(system: Column, taxonomy: Column, instructions: Column, template: Column, code: Column) -> Column:
    """System and user message; {code} in the template is replaced by the numbered code, whose own braces stay as they are."""
    part = F.split(template, r"\{code\}", 2)
    user = F.concat(F.get(part, F.lit(0)), number_lines(code), F.coalesce(F.get(part, F.lit(1)), F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.concat_ws("\n\n", system, taxonomy, instructions)), message("user", user))


def folder_language(path: Column) -> Column:
    """The folder right above the file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
