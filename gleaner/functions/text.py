"""String and date expressions; all run in the JVM."""

from __future__ import annotations

import sys
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() and str.split() see it.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Both ends without Unicode white space; a text without any at its ends is not searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(rf"(?U){SPACE}"), F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")).otherwise(text)


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD})"), 1), F.array().cast("array<string>"))


#: Lower-case letters that fold to others, by Unicode's case folding as Python has it.
FOLDS = {low: fold for c in map(chr, range(sys.maxunicode + 1)) if len(low := c.lower()) == 1 and (fold := c.casefold()) != low}
_ONE = {a: b for a, b in FOLDS.items() if len(b) == 1}
_MORE = {a: b for a, b in FOLDS.items() if len(b) > 1}


def folded(text: Column) -> Column:
    """Case-folded: lower case, and letters that differ from it in form only are those they stand for."""
    out = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    table = F.create_map(*(F.lit(x) for pair in _MORE.items() for x in pair))
    longer = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(out.rlike(f"[{''.join(_MORE)}]"), longer).otherwise(out)


def entity_name(name: Column) -> Column:
    """Stripped, case-folded, inner white space collapsed, so surface forms join."""
    return F.regexp_replace(folded(strip(name)), rf"(?U){SPACE}+", " ")


def concept_key(name: Column) -> Column:
    """``concept::<name>``, null for a blank name."""
    plain = entity_name(name)
    return F.when(plain != "", F.concat(F.lit("concept::"), plain))


def org_name(name: Column) -> Column:
    return strip(F.lower(name))


def citation_path(article: Column, clause: Column, point: Column) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in (article, clause, point)]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("(document-level)"))


#: The phrase that states the day a law takes force.
FORCE = r"Luật này có hiệu lực thi hành từ ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"


def effective_date(content: Column) -> Column:
    """The one valid date that the force phrase names; null for none, or several."""
    day, month, year = (F.regexp_extract_all(content, F.lit(f"(?iuU){FORCE}"), i) for i in (1, 2, 3))
    text = F.transform(F.arrays_zip(year.alias("y"), month.alias("m"), day.alias("d")), lambda p: F.concat_ws("-", p["y"], p["m"], p["d"]))
    valid = F.transform(text, lambda s: F.try_to_date(s, "yyyy-M-d"))
    found = F.array_distinct(F.filter(valid, lambda d: d.isNotNull()))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def status_as_of(effective: Column, as_of: date | Column) -> Column:
    """``future`` if the effective date is after as_of, otherwise ``unknown``."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.when(effective > day, "future").otherwise("unknown")


def unfenced(content: Column) -> Column:
    """A model's answer without a Markdown code fence and its language label."""
    text = strip(content)
    body = F.when(text.contains("\n"), F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")).otherwise(F.substr(text, F.lit(4)))
    body = strip(F.when(body.endswith("```"), F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body))
    body = F.when(F.lower(body).startswith("json"), strip(F.substr(body, F.lit(5)))).otherwise(body)
    return F.when(text.startswith("```"), body).otherwise(text)
